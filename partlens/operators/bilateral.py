"""N21, bilateral half: means weighted by nearness in place and in value.

The direct form shifts a tile over itself, once for each offset of the square. The grid form is linear in the cells at any width: cells are spread
over the nodes of a coarse lattice in x, y and value, half a sigma apart (splat), the lattice is blurred along its three
axes (blur), and each cell reads its mean between the nodes around it (slice). Each tile builds the part of the lattice
that its halo covers; nodes are placed by the grid's own coordinates, so results do not depend on the tiles.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, StructField, StructType

from . import tiles as T

#: Nodes of the lattice to a sigma, and sigmas after which weights are left out.
NODES, REACH = 2, 3


def direct_means(x: np.ndarray, y: np.ndarray, v: np.ndarray, sigma: float, value_sigma: float) -> np.ndarray:
    """Means of cells over the squares around them, one shift of the whole tile at a time; holes have no weight."""
    r = math.ceil(REACH * sigma)
    at_y, at_x = y.astype(np.int64) - int(y.min()) + r, x.astype(np.int64) - int(x.min()) + r
    shape = int(at_y.max()) + r + 1, int(at_x.max()) + r + 1
    there, value = np.zeros(shape), np.zeros(shape)
    np.add.at(there, (at_y, at_x), 1.0)
    value[at_y, at_x] = v
    inner = value[r : shape[0] - r, r : shape[1] - r]
    sums, weights = np.zeros(inner.shape), np.zeros(inner.shape)
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            rows, cols = slice(r + dy, shape[0] - r + dy), slice(r + dx, shape[1] - r + dx)
            near = value[rows, cols]
            w = np.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma) - (near - inner) ** 2 / (2 * value_sigma * value_sigma)) * there[rows, cols]
            sums += w * near
            weights += w
    return sums[at_y - r, at_x - r] / weights[at_y - r, at_x - r]


def _by_tile(df: DataFrame, halo: int, means: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Rounded means of the tiles' own cells."""

    def run(table: pa.Table) -> pa.Table:
        own = table.column("_own").to_numpy(zero_copy_only=False)
        out = table.select(["grid_id", "x", "y"])
        x, y, v = (table.column(c).to_numpy() for c in ("x", "y", "v"))
        got = np.floor(means(x, y, v) + 0.5 + 1e-9) if own.any() else np.zeros(len(x))
        return out.append_column("v", pa.array(got.astype(np.int32))).filter(pa.array(own))

    fields = [df.schema[c] for c in ("grid_id", "x", "y")]
    return T.tiled(df.select("grid_id", "x", "y", "v"), halo, halo).groupBy(*T.AT).applyInArrow(run, StructType([*fields, StructField("v", IntegerType())]))


def direct(df: DataFrame, sigma: float, value_sigma: float) -> DataFrame:
    """Weights exp(-d^2 / 2 sigma^2 - dv^2 / 2 value_sigma^2) over the square of ``REACH`` sigmas."""
    return _by_tile(df, math.ceil(REACH * sigma), lambda x, y, v: direct_means(x, y, v, sigma, value_sigma))


def _bell() -> np.ndarray:
    """Blur between nodes. Spreading and reading between nodes each widen a kernel by a sixth of a node's square."""
    variance = NODES * NODES - 1 / 3
    d = np.arange(-REACH * NODES, REACH * NODES + 1)
    return np.exp(-d * d / (2 * variance))


def _between(c: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """The node before each coordinate, and the share of the node after it."""
    at = c / step
    low = np.floor(at).astype(np.int64)
    return low, at - low


def _blurred(lattice: np.ndarray, bell: np.ndarray, axis: int) -> np.ndarray:
    """The lattice blurred along an axis, one shift of all its lines at a time."""
    lines, r = np.moveaxis(lattice, axis, 0), len(bell) // 2
    out = np.zeros(lines.shape)
    for d, weight in enumerate(bell, -r):
        n = len(lines) - abs(d)
        if n > 0:
            out[max(0, d) : max(0, d) + n] += weight * lines[max(0, -d) : max(0, -d) + n]
    return np.moveaxis(out, 0, axis)


def lattice_means(x: np.ndarray, y: np.ndarray, v: np.ndarray, sigma: float, value_sigma: float) -> np.ndarray:
    """Means of cells from the lattice over all of them."""
    axes = [_between(x, sigma / NODES), _between(y, sigma / NODES), _between(v, value_sigma / NODES)]
    first = [int(low.min()) for low, _ in axes]
    shape = tuple(int(low.max()) - f + 2 for (low, _), f in zip(axes, first, strict=True))
    corners = []
    for corner in range(8):
        at, weight = [], np.ones(len(x))
        for axis, ((low, share), f) in enumerate(zip(axes, first, strict=True)):
            up = corner >> axis & 1
            at.append(low - f + up)
            weight = weight * (share if up else 1 - share)
        corners.append((np.ravel_multi_index(at, shape), weight))
    size = math.prod(shape)
    bell = _bell()
    sums = []
    for value in (np.ones(len(x)), v.astype(float)):
        lattice = sum(np.bincount(at, weight * value, size) for at, weight in corners).reshape(shape)
        for axis in range(3):
            lattice = _blurred(lattice, bell, axis)
        flat = lattice.ravel()
        sums.append(sum(weight * flat[at] for at, weight in corners))
    return sums[1] / sums[0]


def by_lattice(df: DataFrame, sigma: float, value_sigma: float) -> DataFrame:
    """The grid form: within a few gray levels of the direct form (see the tests for figures)."""
    halo = math.ceil((REACH * NODES + 2) * sigma / NODES)
    return _by_tile(df, halo, lambda x, y, v: lattice_means(x, y, v, sigma, value_sigma))
