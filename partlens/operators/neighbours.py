"""Neighbourhoods of cells.

Grids are dealt out in tiles with halos (see ``tiles``), by one exchange; windows by row and by column of a tile need no
other. Separable kernels are two window passes, and sums come from prefix sums, so their work does not grow with the
kernel; ranks come from column histograms. What is left collects each cell's neighbours into its row, so nothing is multiplied
and joined back. Neighbours off the grid, and in its holes, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from partlens.functions.curves import gamma_value

from . import ranks as R
from . import tiles as T

KEY = ["grid_id", "x", "y"]


def odd(k: int) -> int:
    return k if k % 2 else k + 1


def separable(df: DataFrame, kx: int, ky: int, **aggs: tuple[Callable[[Column], Column], Column]) -> DataFrame:
    """Adds aggregates over the kx by ky neighbourhood, each (function, column), by row and then by column; sums are of whole
    numbers."""
    rx, ry = odd(kx) // 2, odd(ky) // 2
    got = T.filled(T.tiled(df, rx, ry))
    aggs = {n: (f, F.when(F.col("_there"), c)) for n, (f, c) in aggs.items()}
    sums = {n: (c, rx, ry) for n, (f, c) in aggs.items() if f is F.sum}
    if sums:
        got = T.box_sums(got, sums)
    rest = {n: fc for n, fc in aggs.items() if n not in sums}
    if rest:
        got = got.select("*", *[f(c).over(T.row().rangeBetween(-rx, rx)).alias(f"_{n}") for n, (f, c) in rest.items()])
        got = got.select("*", *[f(F.col(f"_{n}")).over(T.col().rangeBetween(-ry, ry)).alias(n) for n, (f, _) in rest.items()])
    return T.kept(got).drop(*[f"_{n}" for n in rest])


def collected(tiled: DataFrame, kx: int, ky: int) -> DataFrame:
    """Adds near to cells in filled tiles: array of (dx, dy, v) of the kx by ky neighbourhood, the cell itself included."""
    rx, ry = odd(kx) // 2, odd(ky) // 2
    rows = tiled.withColumn("_row", F.collect_list(F.when(F.col("_there"), F.struct("x", "y", "v"))).over(T.row().rangeBetween(-rx, rx)))
    rows = rows.withColumn("_all", F.flatten(F.collect_list("_row").over(T.col().rangeBetween(-ry, ry)))).drop("_row")
    near = F.transform("_all", lambda n: F.struct((n["x"] - F.col("x")).alias("dx"), (n["y"] - F.col("y")).alias("dy"), n["v"].alias("v")))
    return rows.withColumn("near", near).drop("_all")


def gather(df: DataFrame, kx: int, ky: int) -> DataFrame:
    """Adds near to every cell."""
    return T.kept(collected(T.filled(T.tiled(df, odd(kx) // 2, odd(ky) // 2)), kx, ky))


def ranked(df: DataFrame, kx: int, ky: int, **ranks: int) -> DataFrame:
    """Adds the values at some hundredths of the sorted neighbourhood: n p / 100, counted from 0, held to the array."""
    return R.ranked(df, odd(kx), odd(ky), ranks, gather)


def total(a: Column, f: Callable[[Column], Column]) -> Column:
    return F.aggregate(F.transform(a, lambda n: f(n).cast("double")), F.lit(0.0), lambda s, x: s + x)


def values(near: Column) -> Column:
    return F.transform(near, lambda n: n["v"])


def mean(df: DataFrame, kx: int, ky: int) -> DataFrame:
    """Adds m, the whole mean of the neighbourhood, with its sum s and count n."""
    out = separable(df, kx, ky, s=(F.sum, F.col("v")), n=(F.sum, F.lit(1)))
    return out.withColumn("m", F.floor(F.col("s") / F.col("n")).cast("int"))


def out(df: DataFrame, v: Column) -> DataFrame:
    return df.select(*KEY, v.cast("int").alias("v"))


def clamped(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), v))


def box_mean(df: DataFrame, kx: int, ky: int) -> DataFrame:
    """N01."""
    return out(mean(df, kx, ky), F.col("m"))


def extreme(df: DataFrame, kx: int, ky: int, dilate: bool = False) -> DataFrame:
    """The least (erode: darker) or greatest value around."""
    return out(separable(df, kx, ky, e=(F.max if dilate else F.min, F.col("v"))), F.col("e"))


def open_close(df: DataFrame, kx: int, ky: int, close: bool = False) -> DataFrame:
    """N03."""
    return extreme(extreme(df, kx, ky, close), kx, ky, not close)


def filtered_extreme(df: DataFrame, kx: int, ky: int, cut: int, dilate: bool = False, avoid_black: bool = True) -> DataFrame:
    """N02 for cells above (or, avoiding white, below) the cut only; erosion passes over cells up to 32, dilation
    over cells from 250."""
    counted = F.when(F.col("v") < 250, F.col("v")) if dilate else F.when(F.col("v") > 32, F.col("v"))
    got = separable(df, kx, ky, e=(F.max if dilate else F.min, counted))
    touched = F.col("v") > cut if avoid_black else F.col("v") < cut
    return out(got, F.when(touched, F.coalesce("e", "v")).otherwise(F.col("v")))


def rank_filter(df: DataFrame, kx: int, ky: int, p: int = 50) -> DataFrame:
    """N05."""
    return out(ranked(df, kx, ky, r=p), F.col("r"))


def local_contrast(df: DataFrame, kx: int, ky: int) -> DataFrame:
    """Stretched between the extremes around, after a mean of the same size."""
    got = separable(box_mean(df, kx, ky), kx, ky, lo=(F.min, F.col("v")), hi=(F.max, F.col("v")))
    return out(got, F.floor(F.lit(255) * (F.col("v") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))))


def ratio_gamma(v: Column, base: Column, power: int = 1, most: float = 7.0) -> Column:
    """A tone by its ratio to a base value."""
    r = v / F.greatest(base.cast("double"), F.lit(1.0))
    g = r
    for _ in range(power - 1):
        g = g * r
    return gamma_value(v, F.least(F.lit(most), g))


def mean_gamma(df: DataFrame, kx: int, ky: int, power: int = 1) -> DataFrame:
    """Gamma by the value's ratio to the mean around it."""
    return out(mean(df, kx, ky), ratio_gamma(F.col("v"), F.col("s") / (odd(kx) * odd(ky)), power))


def percentile_gamma(df: DataFrame, kx: int, ky: int, p: int, binary: bool = False) -> DataFrame:
    """Gamma by the cubed ratio to a ranked value around, or the comparison with it."""
    got = ranked(df, kx, ky, base=p)
    if binary:
        return out(got, F.when(F.col("v") >= F.col("base"), 255).otherwise(0))
    r = F.least(F.lit(1.999), F.round(F.col("v") / F.col("base"), 3))
    return out(got, gamma_value(F.col("v"), F.least(F.lit(7.0), r * r * r)))


def scaled_gamma(df: DataFrame, kx: int, ky: int, share: float, black: int = -1, white: int = 256) -> DataFrame:
    """Gamma by the cubed ratio to a point between the extremes around; cells outside the cuts stay."""
    valid = F.when((F.col("v") > black) & (F.col("v") < white), F.col("v"))
    got = separable(df, kx, ky, lo=(F.min, valid), hi=(F.max, valid), n=(F.sum, valid.isNotNull().cast("int")))
    base = F.col("lo") + (F.col("hi") - F.col("lo")) * share
    r = F.least(F.lit(1.999), F.coalesce(F.try_divide(F.col("v") - F.col("lo"), base - F.col("lo")), F.lit(1.0)))
    outside = (F.col("v") <= black) | (F.col("v") >= white) | (F.col("n") <= 2)
    return out(got, F.when(outside, F.col("v")).otherwise(gamma_value(F.col("v"), F.least(F.lit(7.0), r * r * r))))


def tolerant_gamma(df: DataFrame, kx: int, ky: int, tolerance: float) -> DataFrame:
    """Cubed mean gamma where the value lies outside mean (1 +- tolerance)."""
    got = mean(df, kx, ky).withColumn("a", F.col("s") / F.col("n"))
    inside = F.col("v").between(F.col("a") * (1 - tolerance), F.col("a") * (1 + tolerance)) | (F.col("v") > 242) | (F.col("v") < 16)
    return out(got, F.when(inside, F.col("v")).otherwise(ratio_gamma(F.col("v"), F.col("a"), 3)))


def skip_white_gamma(df: DataFrame, kx: int, ky: int, cut: int, power: int = 2) -> DataFrame:
    """Gamma by the mean of the darker cells around, if there are five."""
    dark = F.col("v") < cut
    got = separable(df, kx, ky, s=(F.sum, F.when(dark, F.col("v")).otherwise(0)), n=(F.sum, dark.cast("int")))
    return out(got, F.when(F.col("n") < 5, F.col("v")).otherwise(ratio_gamma(F.col("v"), F.try_divide(F.col("s"), F.col("n")), power)))


def equalise(df: DataFrame, kx: int, ky: int, low: float, high: float) -> DataFrame:
    """Near the mean the value moves half way to it, else its cubed ratio is its gamma."""
    got = mean(df, kx, ky).withColumn("a", F.col("s") / F.col("n"))
    ratio = F.coalesce(F.try_divide("v", "a"), F.lit(1.0))
    return out(got, F.when(ratio.between(low, high), F.floor((F.col("v") + F.col("m")) / 2)).otherwise(ratio_gamma(F.col("v"), F.col("a"), 3)))


def step_gamma(df: DataFrame, kx: int, ky: int, tolerance: float) -> DataFrame:
    """Gamma in thousandths by the ratio to mean + 1, moved by 200 outside the tolerance, cubed."""
    got = mean(df, kx, ky)
    k = F.floor(F.col("v") * 1000 / (F.col("m") + 1))
    k = F.when(k > 1000 * (1 + tolerance), k + 200).when(k < 1000 * (1 - tolerance), F.greatest(F.lit(0), k - 200)).otherwise(k)
    r = k / 1000.0
    return out(got, gamma_value(F.col("v"), F.least(F.lit(7.0), r * r * r)))


def sigmoid_gamma(df: DataFrame, kx: int, ky: int, p: int, slope: float) -> DataFrame:
    """The value is pulled to its ranked base by a logistic share of its distance, then N08's gamma."""
    got = ranked(df, kx, ky, base=p, hi=60, lo=40)
    width = F.greatest(F.lit(8), F.least(F.lit(32), F.col("hi") - F.col("lo")))
    share = F.lit(1.0) / (F.lit(1.0) + F.exp(-slope * (F.abs(F.col("v") - F.col("base")) - width)))
    got = got.withColumn("u", F.floor(F.col("base") + (F.col("v") - F.col("base")) * share + 1e-6).cast("int"))
    r = F.least(F.lit(1.999), F.round(F.col("u") / F.col("base"), 3))
    return out(got, gamma_value(F.col("u"), F.least(F.lit(7.0), r * r * r)))


def harmonic_mean(df: DataFrame, kx: int, ky: int, order: int, power: int, cut: int) -> DataFrame:
    """(contra)harmonic mean of the cells below the cut, weighted by nearness; five are needed."""
    r = odd(kx) // 2
    got = gather(df, kx, ky).withColumn("near", F.filter("near", lambda n: n["v"] < cut))
    w = lambda n: F.pow(F.lit(float(r)) - F.greatest(F.abs(n["dx"]), F.abs(n["dy"])) + 1, F.lit(float(power)))
    v = lambda n: F.greatest(n["v"], F.lit(1)).cast("double")
    e = float(order)
    value = total(F.col("near"), lambda n: w(n) * F.pow(v(n), F.lit(e + 1))) / total(F.col("near"), lambda n: w(n) * F.pow(v(n), F.lit(e)))
    return out(got, F.when(F.size("near") < 5, F.col("v")).otherwise(clamped(F.floor(value + 1e-6))))


SOBEL = {
    "vertical": lambda dx, dy: F.signum(dx) * F.when(dy == 0, 2).otherwise(1),
    "horizontal": lambda dx, dy: F.signum(dy) * F.when(dx == 0, 2).otherwise(1),
    "nesw": lambda dx, dy: F.signum(dx + dy) * 2,
    "nwse": lambda dx, dy: F.signum(dx - dy) * 2,
}


def sobel(df: DataFrame, kind: str, k: int = 3) -> DataFrame:
    """Signed weights across a direction; both signs, held to 0..255, joined by bits."""
    got = gather(df, k, k)
    e = total(F.col("near"), lambda n: SOBEL[kind](n["dx"], n["dy"]) * n["v"]).cast("int")
    return out(got, clamped(e).bitwiseOR(clamped(-e)))


def laplacian(df: DataFrame, kx: int, ky: int) -> DataFrame:
    """N17."""
    return out(mean(df, kx, ky), clamped(F.col("n") * F.col("v") - F.col("s")))


def composite_edges(df: DataFrame, with_laplacian: bool = False) -> DataFrame:
    """The four directions (and the Laplacian) joined by the greatest."""
    got = gather(df, 3, 3)
    parts = [F.abs(total(F.col("near"), lambda n, k=k: SOBEL[k](n["dx"], n["dy"]) * n["v"])).cast("int") for k in SOBEL]
    if with_laplacian:
        parts.append((F.size("near") * F.col("v") - total(F.col("near"), lambda n: n["v"])).cast("int"))
    return out(got, clamped(F.greatest(*parts)))


def convolve(df: DataFrame, kernel: list[list[float]]) -> DataFrame:
    """Any kernel; cells off the grid count as nothing."""
    h, w = len(kernel), len(kernel[0])
    weights = F.array(*[F.lit(float(x)) for row in kernel for x in row])
    got = gather(df, w, h)
    at = lambda n: F.get(weights, (n["dy"] + h // 2) * w + n["dx"] + w // 2)
    return out(got, clamped(F.floor(total(F.col("near"), lambda n: at(n) * n["v"]) + 0.5 + 1e-9)))


def _bell(radius: int) -> list[float]:
    """Weights of a Gaussian of sigma radius / 3 at offsets -radius .. radius."""
    sigma = max(radius, 1) / 3
    return [math.exp(-d * d / (2 * sigma * sigma)) for d in range(-radius, radius + 1)]


def _bell_sums(df: DataFrame, radius: int) -> DataFrame:
    """Adds g, the Gaussian mean: weighted sums along the row, then of those along the column, each by one window, so
    the work grows with the radius and not with its square."""
    weights = list(enumerate(_bell(radius), -radius))

    def along(w: WindowSpec, at: Column) -> Column:
        return sum((F.coalesce(F.max(at).over(w.rangeBetween(d, d)), F.lit(0.0)) * b for d, b in weights), F.lit(0.0))

    got = T.filled(T.tiled(df, radius, radius))
    got = got.withColumn("_s", along(T.row(), F.col("v").cast("double"))).withColumn("_w", along(T.row(), F.when(F.col("_there"), F.lit(1.0))))
    got = got.withColumn("g", along(T.col(), F.col("_s")) / along(T.col(), F.col("_w")))
    return T.kept(got).drop("_s", "_w")


def gaussian(df: DataFrame, radius: int, unsharp: float | None = None, threshold: int = 1) -> DataFrame:
    """Normalised Gaussian of sigma radius / 3; with ``unsharp`` the detail beyond the threshold is amplified."""
    got = _bell_sums(df, radius).withColumn("g", F.floor(F.col("g") + 0.5 + 1e-9).cast("int"))
    if unsharp is None:
        return out(got, F.col("g"))
    diff = F.col("v") - F.col("g")
    return out(got, F.when(F.abs(diff) >= threshold, clamped(F.floor((4 * unsharp + 1) * diff + F.col("g") + 1e-9))).otherwise(F.col("v")))


def edge_keeping_blur(df: DataFrame, radius: int, tolerance: int) -> DataFrame:
    """Gaussian mean of the cells within a tolerance of the centre. Which cells count differs from cell to cell, so
    the sums are not separable; the weights are constants."""
    k, bell = 2 * radius + 1, _bell(radius)
    weights = F.array(*[F.lit(a * b) for a in bell for b in bell])
    weight = lambda n: F.get(weights, (n["dy"] + radius) * k + n["dx"] + radius)
    got = gather(df, k, k).withColumn("near", F.filter("near", lambda n: F.abs(n["v"] - F.col("v")) <= tolerance))
    return out(got, F.floor(total(F.col("near"), lambda n: weight(n) * n["v"]) / total(F.col("near"), weight) + 0.5 + 1e-9))


def sauvola(df: DataFrame, k: int, factor: float) -> DataFrame:
    """Threshold mean (1 + factor (deviation / 128 - 1))."""
    got = separable(df, k, k, s=(F.sum, F.col("v")), q=(F.sum, F.col("v") * F.col("v")), n=(F.sum, F.lit(1)))
    m = F.col("s") / F.col("n")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - m * m))
    return out(got, F.when(F.col("v") <= F.round(m * (1 + factor * (sd / 128 - 1)), 6), 0).otherwise(255))


def kernel_background(df: DataFrame, k: int, target: int, bright: int = 8) -> DataFrame:
    """In flat bright neighbourhoods, cells below the mean take the target value."""
    got = ranked(separable(df, k, k, s=(F.sum, F.col("v")), n=(F.sum, F.lit(1)), bright=(F.sum, (F.col("v") >= 128).cast("int"))), k, k, median=50)
    m, median = F.floor(F.col("s") / F.col("n")), F.col("median")
    flat = (F.col("bright") >= bright) & (median <= m) & (m <= median + 5) & (m <= target)
    return out(got, F.when(flat & (F.col("v") < m), target).otherwise(F.col("v")))


def add_layer(df: DataFrame, n: int, direction: str, cut: int) -> DataFrame:
    """Dark cells are copied n steps in a direction; a cell takes the darkest that reaches it."""
    row, col = T.row(), T.col()
    w = {"E": row.rangeBetween(-n, 0), "W": row.rangeBetween(0, n), "S": col.rangeBetween(-n, 0), "N": col.rangeBetween(0, n)}[direction]
    across = direction in "EW"
    dark = F.min(F.when(F.col("v") < cut, F.col("v"))).over(w)
    got = T.kept(T.tiled(df, n if across else 0, 0 if across else n).withColumn("dark", dark))
    return out(got, F.least(F.col("v"), F.coalesce("dark", "v")))


def drop_diagonals(df: DataFrame, k: int, cut: int = 128) -> DataFrame:
    """A dark cell turns white if one of its diagonal arms is all bright."""
    got = gather(df, k, k)
    arms = [lambda n: (n["dx"] == n["dy"]) & (n["dx"] != 0), lambda n: (n["dx"] == -n["dy"]) & (n["dx"] != 0)]
    bright = F.lit(False)
    for arm in arms:
        cells = F.filter("near", arm)
        bright = bright | ((F.size(cells) > 0) & F.forall(cells, lambda n: n["v"] >= cut))
    return out(got, F.when((F.col("v") < cut) & bright, 255).otherwise(F.col("v")))


def join_bridges(df: DataFrame, cut: int = 128) -> DataFrame:
    """The upper left cell of a 2 by 2 chequer turns dark."""
    row, col = T.row().rangeBetween(1, 1), T.col().rangeBetween(1, 1)
    got = T.tiled(df, 1, 1).withColumn("d", F.col("v") < cut).withColumn("e", F.max("d").over(row)).withColumn("s", F.max("d").over(col)).withColumn("se", F.max("e").over(col))
    return out(T.kept(got), F.when(~F.col("d") & F.col("e") & F.col("s") & ~F.col("se"), 0).otherwise(F.col("v")))


def lighten_centre(df: DataFrame, k: int, axis: str = "y") -> DataFrame:
    """A cell brighter than the means of both sides along an axis gets gamma (v / lesser side)^3."""
    w, r = T.col() if axis == "y" else T.row(), odd(k) // 2
    tiled = T.tiled(df, 0, r) if axis == "y" else T.tiled(df, r, 0)
    got = T.kept(tiled.withColumn("a", F.avg("v").over(w.rangeBetween(-r, -1))).withColumn("b", F.avg("v").over(w.rangeBetween(1, r))))
    brighter = (F.col("v") > F.col("a")) & (F.col("v") > F.col("b"))
    return out(got, F.when(brighter, ratio_gamma(F.col("v"), F.least("a", "b"), 3)).otherwise(F.col("v")))


def clear_trails(df: DataFrame, kx: int, ky: int | None = None, cut: int = 128) -> DataFrame:
    """Where the border of a kx by ky box has no dark cell, its inside turns white. Sides may be even; the box of a
    cell then reaches one further to the right and down."""
    ky = ky or kx
    (x0, x1), (y0, y1) = ((-((k - 1) // 2), k // 2) for k in (kx, ky))
    if min(kx, ky) < 3:
        return df.select(*KEY, "v")  # such boxes have no inside
    # a cell is inside the boxes of cells up to x1 - 1 and y1 - 1 away, whose borders are x1 and y1 away from those
    got = T.tiled(df, 2 * x1, 2 * y1)

    def boxes(name: str, c: Column, xs: tuple[int, int], ys: tuple[int, int]) -> DataFrame:
        rows = got.withColumn("_r", T.sum_within(c, T.row(), *xs))
        return rows.withColumn(name, T.sum_within(F.col("_r"), T.col(), *ys)).drop("_r")

    dark = (F.col("v") < cut).cast("int")
    got = boxes("n", F.lit(1), (x0, x1), (y0, y1))
    got = boxes("dark", dark, (x0, x1), (y0, y1))
    got = boxes("inside", dark, (x0 + 1, x1 - 1), (y0 + 1, y1 - 1))
    got = got.withColumn("clear", ((F.col("n") == kx * ky) & (F.col("dark") == F.col("inside"))).cast("int"))
    got = boxes("any", F.col("clear"), (1 - x1, -1 - x0), (1 - y1, -1 - y0))
    return out(T.kept(got), F.when(F.col("any") > 0, 255).otherwise(F.col("v")))


def salt_pepper(df: DataFrame, sizes: tuple[int, ...] = (3, 4, 5, 7)) -> DataFrame:
    """Isolated dark blobs inside white rings go."""
    for k in sizes:
        df = clear_trails(df, k)
    return df


#: Fixed values of N31: the least side of the window, and the greatest value that marks a found ring.
RING_SIDE, RING_MARK = 11, 8


def ring_detector(df: DataFrame, side: int, mark: int, ratio: float, skip: Column | None = None) -> DataFrame:
    """Small dark discs in brighter rings, marked.

    A window of ``side`` cells has two rings, each two cells thick, around an inner square. It is a hit if it lies on the grid,
    holds neither white cells nor such of the mark's value, its centre does not meet ``skip``, and the mean of the outer ring,
    of the inner ring or of both exceeds ``ratio`` times the mean of the inner square. All sums are differences of the
    same boxes. Every cell of a hit's inner square takes the value ``mark``; hits do not depend on each other."""
    side, mark = odd(max(side, RING_SIDE)), min(mark, RING_MARK)
    r = side // 2
    v, barred = F.col("v"), ((F.col("v") == mark) | (F.col("v") == 255)).cast("int")
    radii = {0: r, 1: r - 2, 2: r - 4}
    got = T.tiled(df, r + radii[2], r + radii[2])
    got = T.box_sums(got, {"barred": (barred, r, r), **{f"s{i}": (v, q, q) for i, q in radii.items()}, **{f"n{i}": (F.lit(1), q, q) for i, q in radii.items()}})
    c = {n: F.col(n).cast("double") for n in ("s0", "s1", "s2", "n0", "n1", "n2")}
    inner = ratio * c["s2"] / c["n2"]
    outer, middle, both = (c["s0"] - c["s1"]) / (c["n0"] - c["n1"]), (c["s1"] - c["s2"]) / (c["n1"] - c["n2"]), (c["s0"] - c["s2"]) / (c["n0"] - c["n2"])
    whole = (F.col("n0") == side * side) & (F.col("barred") == 0)
    # the means stand under the guard of a whole window, as no box of theirs is empty there
    hit = F.when(whole, (outer > inner) | (middle > inner) | (both > inner)).otherwise(False)
    if skip is not None:
        hit = hit & ~skip
    got = T.box_sums(got.withColumn("hit", hit.cast("int")), {"marked": (F.col("hit"), radii[2], radii[2])})
    return out(T.kept(got), F.when(F.col("marked") > 0, mark).otherwise(F.col("v")))


def greenish(r: Column, g: Column, b: Column) -> Column:
    """Centres that are passed over. Fixed values."""
    return (b <= g + 20) & (g - r >= 30)
