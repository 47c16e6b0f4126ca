"""Ranked values of neighbourhoods.

Small neighbourhoods are collected and sorted in the JVM. For larger ones each tile keeps a histogram for every column of
the window's height, moved down a row at a time by one cell in and one out. Running counts of those along the row give
any window's histogram as a difference of two, first of 16 coarse bins, then of the 16 fine ones where the rank falls; so
the work of a cell is the same at any window. Tiles are bounded, and so is what a task holds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from . import tiles as T

#: Cells up to which sorting a neighbourhood is cheaper than keeping histograms (timed; see the README).
SMALL = 9
FINE = 16


def rank_of(n: Column, p: int) -> Column:
    """Place, from 0, of the p-th hundredth among n sorted values."""
    return F.least(n - 1, F.floor(n * p / 100)).cast("int")


def ranked(df: DataFrame, kx: int, ky: int, ranks: dict[str, int], gather: Callable[[DataFrame, int, int], DataFrame]) -> DataFrame:
    """Adds, for each name, the value at that hundredth of the sorted neighbourhood, at least 1. kx and ky are odd."""
    if kx * ky <= SMALL:
        got = gather(df, kx, ky)
        got = got.withColumn("_sorted", F.array_sort(F.transform("near", lambda n: n["v"]))).drop("near")
        return got.select("*", *[F.greatest(F.lit(1), F.get("_sorted", rank_of(F.size("_sorted"), p))).alias(n) for n, p in ranks.items()]).drop("_sorted")
    places = lambda n, p: np.minimum(n - 1, n * p // 100)

    def values(h: Histograms) -> list[np.ndarray]:
        return [np.maximum(1, h.value(places(h.n, p))) for p in ranks.values()]

    return by_histogram(df, kx, ky, list(ranks), values)


class Histograms:
    """The histograms of the windows around the cells of one row of a tile."""

    def __init__(self, distinct: np.ndarray, upto: np.ndarray, first: np.ndarray, last: np.ndarray):
        self.distinct, self.upto, self.first, self.last = distinct, upto, first, last  # upto: counts of the columns before each, by bin
        bins = upto.shape[1]
        coarse = upto.reshape(len(upto), bins // FINE, FINE).sum(2)
        self.coarse = np.cumsum(coarse[last] - coarse[first], 1)
        self.n = self.coarse[:, -1]

    def value(self, place: np.ndarray) -> np.ndarray:
        """The value at each window's place, counted from 0."""
        c = np.minimum((self.coarse <= place[:, None]).sum(1), self.coarse.shape[1] - 1)
        below = np.where(c > 0, np.take_along_axis(self.coarse, np.maximum(c - 1, 0)[:, None], 1)[:, 0], 0)
        bins = c[:, None] * FINE + np.arange(FINE)
        fine = np.cumsum(self.upto[self.last[:, None], bins] - self.upto[self.first[:, None], bins], 1)
        f = np.minimum((fine <= (place - below)[:, None]).sum(1), FINE - 1)
        return self.distinct[np.minimum(c * FINE + f, len(self.distinct) - 1)]

    def counts(self) -> np.ndarray:
        """All bins of all windows."""
        return self.upto[self.last] - self.upto[self.first]


def tile_values(x: np.ndarray, y: np.ndarray, v: np.ndarray, own: np.ndarray, rx: int, ry: int, values: Callable[[Histograms], list[np.ndarray]], width: int) -> np.ndarray:
    """A line of results for each own cell of a tile, in the order of the cells; ``values`` gets one row's windows at a time."""
    distinct, code = np.unique(v, return_inverse=True)
    bins = -(-len(distinct) // FINE) * FINE
    x0 = int(x.min())
    across = int(x.max()) - x0 + 1
    order = np.argsort(y, kind="stable")
    rows, starts = np.unique(y[order], return_index=True)
    ends = np.append(starts[1:], len(order))
    out = np.zeros((len(x), width), np.int64)
    columns = np.zeros((across, bins), np.int32)
    entering = leaving = 0
    for r, row in enumerate(rows.tolist()):
        while entering < len(rows) and rows[entering] <= row + ry:
            some = order[starts[entering] : ends[entering]]
            np.add.at(columns, (x[some] - x0, code[some]), 1)
            entering += 1
        while rows[leaving] < row - ry:
            some = order[starts[leaving] : ends[leaving]]
            np.subtract.at(columns, (x[some] - x0, code[some]), 1)
            leaving += 1
        here = order[starts[r] : ends[r]]
        here = here[own[here]]
        if len(here):
            upto = np.concatenate([np.zeros((1, bins), np.int32), np.cumsum(columns, 0, dtype=np.int32)])
            at = x[here] - x0
            got = values(Histograms(distinct, upto, np.maximum(at - rx, 0), np.minimum(at + rx + 1, across)))
            out[here] = np.stack(got, 1)
    return out


def by_histogram(df: DataFrame, kx: int, ky: int, names: list[str], values: Callable[[Histograms], list[np.ndarray]]) -> DataFrame:
    """Adds columns of whole numbers computed from each cell's histogram, tile by tile."""
    rx, ry = kx // 2, ky // 2
    given = df.columns

    def run(table: pa.Table) -> pa.Table:
        x, y, v = (table.column(c).to_numpy() for c in ("x", "y", "v"))
        own = table.column("_own").to_numpy(zero_copy_only=False)
        got = tile_values(x, y, v, own, rx, ry, values, len(names)) if own.any() else np.zeros((len(x), len(names)), np.int64)
        out = table.select(given)
        for i, n in enumerate(names):
            out = out.append_column(n, pa.array(got[:, i].astype(np.int32)))
        return out.filter(pa.array(own))

    schema = StructType([*df.schema.fields, *[StructField(n, IntegerType()) for n in names]])
    return T.tiled(df, rx, ry).groupBy(*T.AT).applyInArrow(run, schema)


def knees(h: Histograms) -> list[np.ndarray]:
    """The value two places after the first largest second difference of each sorted window.

    Second differences are told from the occupied bins: over two equal values and the next one (the step up), over a single
    value and its neighbours, over a value and two equal ones above it (the step down), and over three equal ones (none)."""
    n = h.counts()
    w, bins = n.shape
    u = np.append(h.distinct, np.full(bins - len(h.distinct), h.distinct[-1])).astype(np.int64)
    there = n > 0
    ids = np.where(there, np.arange(bins), bins)
    after = np.minimum.accumulate(ids[:, ::-1], 1)[:, ::-1]
    nxt = np.concatenate([after[:, 1:], np.full((w, 1), bins)], 1)  # the next occupied bin
    second = np.take_along_axis(np.concatenate([nxt, np.full((w, 1), bins)], 1), nxt, 1)  # and the one after that
    has1, has2 = there & (nxt < bins), there & (second < bins)
    at1, at2 = np.minimum(nxt, bins - 1), np.minimum(second, bins - 1)
    n1 = np.take_along_axis(n, at1, 1)
    before = np.cumsum(n, 1) - n
    place = before + n - 2  # of the last two equal values
    best, base = np.full(w, np.iinfo(np.int64).min), np.zeros(w, np.int64)
    kinds = [
        (there & (n >= 3), np.zeros((w, bins), np.int64), before, np.broadcast_to(u, (w, bins))),
        (has1 & (n >= 2), u[at1] - u, place, u[at1]),
        (has2 & (n1 == 1), u[at2] - 2 * u[at1] + u, place + 1, u[at2]),
        (has1 & (n1 >= 2), u - u[at1], place + 1, u[at1]),
    ]
    for ok, d, i, value in kinds:
        key = np.where(ok, d * (1 << 32) - i, np.iinfo(np.int64).min)
        j = key.argmax(1)[:, None]
        top = np.take_along_axis(key, j, 1)[:, 0]
        better = top > best
        best = np.where(better, top, best)
        base = np.where(better, np.take_along_axis(value, j, 1)[:, 0], base)
    short = h.n < 3  # no second difference: the last value
    last = np.where(there, np.arange(bins), -1).max(1)
    return [np.where(short, u[last], base)]

