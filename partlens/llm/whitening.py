"""Whitening of vectors along their leading principal components, by Chebyshev-filtered subspace iteration.

The covariance V of the vectors is never formed. A block Q of a few directions passes over all centred vectors X as
X'(XQ)/n, one Spark job a pass. A Chebyshev polynomial of V, applied by its three-term recurrence, one pass a degree,
damps the unwanted part of the spectrum; QR makes the block orthonormal again, and Rayleigh-Ritz turns it to
eigenvectors. This goes on until the residuals |Vq - eq| certify the wanted ones. Each round one column of the
block is drawn anew, so a direction that the start lacked comes to light.

A task holds one block of vectors and the sums of a pass (dimensions times columns). Sums are added up by Spark; the
driver gets one such table a pass, whose size depends on the dimensions alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, plain
from .topk import usable

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Further columns of the block: the more, the wider the gap between the wanted eigenvalues and the damped ones.
GUARD = 16
#: Highest degree of the polynomial between two orthogonalisations.
DEGREE = 10
#: Residual, as a share of the largest eigenvalue, at which an eigenvector is certified; where rounding keeps the residual
#: from falling further, ``WORST`` must hold.
TOLERANCE, WORST = 1e-13, 1e-10
ROUNDS = 200
#: Entries beyond this are held to it: all its whole numbers are doubles.
LARGEST = 2**52
ROWS = 4096  #: vectors worked on at once


def _matrix(lists: pa.Array, width: int, missing: float) -> np.ndarray:
    """Vectors as rows; shorter ones end in ``missing``."""
    ends = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    sizes = np.diff(ends)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.full((len(sizes), width), missing, flat.dtype)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, x = floor(1024 c) + 100000 of every vector without null or non-finite entries."""
    given = plain(vectors, "vec_id", "embedding").where(usable(F.col("embedding")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            c = lists.values.to_numpy(zero_copy_only=False).astype(float)
            x = np.clip(np.floor(SCALE * c), -LARGEST, LARGEST).astype(np.int64) + SHIFT
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.ListArray.from_arrays(lists.offsets, pa.array(x))], names=["vec_id", "x"])

    return given.mapInArrow(run, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, x array<long>")


def summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], width: int, shape: tuple[int, int], whole: bool = False) -> np.ndarray:
    """The sum over all vectors of ``part``, which gets some of them as rows and gives a table of the shape. Each task adds
    up its own; whole numbers stay exact."""
    kind = np.int64 if whole else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(shape, kind)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                sums += part(_matrix(batch.column("x").slice(i, ROWS), width, SHIFT))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0])), *[pa.array(c) for c in sums.T]], names=["line", *[f"s{j}" for j in range(shape[1])]])

    names = [f"s{j}" for j in range(shape[1])]
    parts = rows.select("x").mapInArrow(run, "line long, " + ", ".join(f"{n} {'long' if whole else 'double'}" for n in names))
    total = parts.groupBy("line").agg(*[F.expr(f"sum({f'CAST({n} AS DECIMAL(38, 0))' if whole else n}) AS {n}") for n in names])
    out = np.zeros(shape, object if whole else float)
    for r in total.collect():
        out[r[0]] = [int(v) for v in r[1:]] if whole else r[1:]
    return out


def _orthonormal(block: np.ndarray) -> np.ndarray:
    return np.linalg.qr(block / np.maximum(np.linalg.norm(block, axis=0), 1e-300))[0]


def _ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz: values, falling, and the block and its product turned to their vectors."""
    small = q.T @ vq
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return values[::-1], q @ turn[:, ::-1], vq @ turn[:, ::-1]


def leading(product: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, guard: int = GUARD, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, of V, their unit eigenvectors as columns and the residuals;
    ``product`` gives VQ of a block Q, and V is symmetric without negative eigenvalues."""
    rng = np.random.default_rng(seed)
    wanted, k = min(wanted, d), min(d, wanted + guard)
    q = _orthonormal(rng.normal(size=(d, k)))
    vq = product(q)
    low, high = 0.0, 0.0
    if k < d:
        # the space of the block and its product gives the first bounds of the spectrum
        q = _orthonormal(np.hstack([q, vq]) if np.abs(vq).max() > 0 else q)
        values, q, vq = _ritz(q, product(q))
        low = max(0.0, values[-1] - float(np.linalg.norm(vq[:, -1] - values[-1] * q[:, -1])))
        high = values[min(k, len(values) - 1)]
        q, vq = q[:, :k], vq[:, :k]
    best, stuck = np.inf, 0
    for _ in range(ROUNDS):
        values, q, vq = _ritz(q, vq)
        residual = np.linalg.norm(vq - q * values, axis=0)[:wanted]
        worst = float(residual.max() / values[0]) if values[0] > 0 else 0.0
        best, stuck = (worst, 0) if worst < 0.5 * best else (best, stuck + 1)
        if worst <= TOLERANCE or k == d or (stuck >= 3 and worst <= WORST):
            return values[:wanted], q[:, :wanted], residual
        # damp from the lowest eigenvalue seen to the block's last, and in any case to a little below the last wanted one
        low = max(0.0, min(low, values[-1]))
        high = min(max(high, values[-2]), low + 0.95 * (values[wanted - 1] - low))
        centre, half = (high + low) / 2, max((high - low) / 2, 1e-12 * values[0])
        growth = float(np.arccosh(max(1.0 + 1e-9, (values[0] - centre) / half)))
        degree = int(np.clip(23 / growth, 2, DEGREE))  # the largest grows by e^23 = 10^10 at most
        before, now = q, (vq - centre * q) / half
        for _ in range(degree - 1):
            before, now = now, 2 * (product(now) - centre * now) / half - before
        now[:, -1] = rng.normal(size=d)
        q = _orthonormal(now)
        vq = product(q)
        high = 0.0
    raise RuntimeError(f"no certified eigenvectors after {ROUNDS} rounds; the residual is {worst:.1e} of the largest eigenvalue")


@dataclass
class Whitening:
    n: int
    sums: list[int]  # of x, by dimension
    values: np.ndarray  # eigenvalues of x's covariance, falling
    axes: np.ndarray  # (dimensions, components); unit columns
    known: np.ndarray  # components whose eigenvalue is told from zero
    explained: np.ndarray
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates on the known components."""
        return (x - self.mean) @ (self.axes[:, self.known] / np.sqrt(self.values[self.known]))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Fits on all ``rows`` of ``integers``."""
    n, d = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    d = d or 0
    if d == 0:
        return Whitening(n, [], np.zeros(0), np.zeros((0, 0)), np.zeros(0, bool), np.zeros(0))
    high, low = summed(rows, lambda x: np.stack([(x >> 24).sum(0), (x & 0xFFFFFF).sum(0)], 1), d, (d, 2), whole=True).T
    sums = [int(h) * 2**24 + int(s) for h, s in zip(high, low, strict=True)]
    mean = np.array([s / n for s in sums])

    def product(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ q)

        return summed(rows, part, d, q.shape) / n

    trace = summed(rows, lambda x: ((x - mean) ** 2).sum(0)[:, None], d, (d, 1)).sum() / n
    values, axes, residual = leading(product, d, components)
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    known = values > np.maximum(4 * residual, 1e-12 * max(values[0], 0.0))
    out = Whitening(n, sums, values, axes, known, values / trace if trace > 0 else np.zeros_like(values))
    k = int(known.sum())
    if k:

        def part(x: np.ndarray) -> np.ndarray:
            w = out.project(x)
            return np.column_stack([w.T @ w, w.sum(0)])

        got = summed(rows, part, d, (k, k + 1)) / n
        covariance = got[:, :k] - np.outer(got[:, k], got[:, k])
        out.identity_error = float(np.abs(covariance - np.eye(k)).max())
    return out


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Sum over dimensions of (n x - S)^2, exact; beyond 64 bits held to the largest long."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if most < 2**62:
        t = n * x - np.array(sums, np.int64)
        top = int(np.abs(t).max(initial=0))
        if top * top * max(1, x.shape[1]) < 2**63:
            return (t * t).sum(1)
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    return np.array([min(v, 2**63 - 1) for v in exact], np.int64)


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row and component."""
    k, d = len(model.values), len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows if k else 0, ROWS):
                some = batch.slice(i, ROWS)
                x = _matrix(some.column("x"), d, SHIFT)
                w = np.full((len(x), k), np.nan)
                w[:, model.known] = model.project(x)
                places = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("vec_id").take(places), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, model.n)),
                        pa.array(np.repeat(_deviation(x, model.n, model.sums), k)), pa.array(w.ravel(), from_pandas=True), pa.array(np.tile(model.explained, len(x))),
                        pa.array([model.identity_error] * (len(x) * k), pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op11_whitening(vectors: DataFrame) -> DataFrame:
    """Each usable vector's coordinates on the first 8 components.

    Vectors that are null or hold null or non-finite entries go. Null and repeated ids and repeated rows are rows of their own.
    The longest vector gives the dimensions, and what a shorter one lacks counts as an entry of 0; entries beyond 2^52 after
    scaling are held to that. Fewer dimensions than 8 give as many components. A component whose eigenvalue cannot be told
    from zero (all vectors equal, say) has no whitened value (null); if there is none but such, identity_error is null.
    Further columns play no part; an empty table gives no rows.
    """
    rows = materialize(integers(vectors), "vectors")
    return whiten(rows, fit(rows))
