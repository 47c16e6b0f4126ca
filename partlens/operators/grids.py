"""Aggregates of whole grids and tiles: histograms, thresholds, stretches, tones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partlens.functions.curves import gamma_value

from . import neighbours as N
from . import ranks as R
from . import tiles as T

KEY = ["grid_id", "x", "y"]


def histogram(df: DataFrame, bucket: int = 1) -> DataFrame:
    """Cells by value div bucket."""
    return df.groupBy("grid_id", F.floor(F.col("v") / bucket).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def min_max_histogram(df: DataFrame) -> DataFrame:
    """Bins rescaled to 0..255; a grid of one value is bin 128."""
    h = histogram(df)
    grid = Window.partitionBy("grid_id")
    lo, hi = F.min("bin").over(grid), F.max("bin").over(grid)
    scaled = F.when(hi == lo, 128).otherwise(F.floor((F.col("bin") - lo) * 255 / F.greatest(hi - lo, F.lit(1))))
    return h.withColumn("s", scaled.cast("int")).groupBy("grid_id", F.col("s").alias("bin")).agg(F.sum("n").alias("n"))


def otsu(df: DataFrame, keys: list[str], experimental: bool = False) -> DataFrame:
    """One threshold for each key, from bins of three of the rescaled histogram; the first best bin wins.
    Only counts by bin are windowed (86 for a key at most). The experimental form gives -1 for "use N08"."""
    h = df.groupBy(*keys, "v").agg(F.count("*").alias("n"))
    group = Window.partitionBy(*keys)
    h = h.withColumn("lo", F.min("v").over(group)).withColumn("hi", F.max("v").over(group))
    scaled = F.when(F.col("hi") == F.col("lo"), 128).otherwise(F.floor((F.col("v") - F.col("lo")) * 255 / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))))
    bins = h.withColumn("b", F.floor(scaled / 3).cast("int")).groupBy(*keys, "lo", "hi", "b").agg(F.sum("n").alias("n"))
    upto = group.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("wb", F.sum("n").over(upto)).withColumn("sb", F.sum(F.col("n") * F.col("b")).over(upto))
    bins = bins.withColumn("w", F.sum("n").over(group)).withColumn("s", F.sum(F.col("n") * F.col("b")).over(group))
    wf = F.col("w") - F.col("wb")
    gap = F.col("sb") / F.col("wb") - F.try_divide(F.col("s") - F.col("sb"), wf)
    bins = bins.withColumn("var", F.round(F.coalesce(F.col("wb") * wf * gap * gap, F.lit(0.0)), 6))
    best = bins.groupBy(*keys, "lo", "hi", "w").agg(F.max_by(F.struct("b", "wb"), F.struct(F.col("var"), (-F.col("b")).alias("nb"))).alias("t"))
    span = F.col("hi") - F.col("lo")
    raw = F.col("lo") + F.floor((3 * F.col("t.b") + 1) * span / 255).cast("int")
    best = best.withColumn("raw", raw).withColumn("covered", F.col("t.wb") / F.col("w")).withColumn("place", F.coalesce(F.try_divide(F.col("raw") - F.col("lo"), span), F.lit(0.0)))
    half = F.floor(F.col("lo") / 2)
    if experimental:
        final = F.when(F.col("covered") >= 0.45, half).when(F.col("covered") >= 0.35, F.lit(-1)).when(F.col("place") < 0.35, F.col("raw")).otherwise(F.col("raw") - F.floor(span * 5 / 100))
    else:
        final = (
            F.when(F.col("covered") >= 0.6, half).when(F.col("place") < 0.1, F.col("raw") + F.floor(span * 15 / 100)).when(F.col("place") < 0.15, F.col("raw") + F.floor(span * 75 / 1000))
            .when(F.col("place") < 0.3, F.col("raw")).otherwise(F.col("raw") - F.floor(span * 5 / 100))
        )
    return best.select(*keys, F.col("raw").alias("raw"), final.cast("int").alias("threshold"))


def tile(df: DataFrame, dx: int, dy: int) -> DataFrame:
    return df.withColumn("tx", F.floor(F.col("x") / dx).cast("int")).withColumn("ty", F.floor(F.col("y") / dy).cast("int"))


TILE = ["grid_id", "tx", "ty"]


def local_otsu(df: DataFrame, dx: int, dy: int, experimental: bool = False) -> DataFrame:
    """Cells against their tile's threshold; tiles marked -1 use N08 at 30 %."""
    tiled = tile(df, dx, dy)
    t = otsu(tiled, TILE, experimental).select(*TILE, "threshold")
    out = tiled.join(t, TILE)
    plain = F.when(F.col("v") <= F.col("threshold"), 0).otherwise(255)
    if not experimental:
        return out.select(*KEY, plain.alias("v"))
    ranked = N.percentile_gamma(df, 3, 3, 30, True).select(*KEY, F.col("v").alias("u"))
    return out.join(ranked, KEY).select(*KEY, F.when(F.col("threshold") == -1, F.col("u")).otherwise(plain).alias("v"))


def mean_gray(df: DataFrame) -> DataFrame:
    """A06."""
    return df.groupBy("grid_id").agg(F.floor(F.avg("v")).cast("int").alias("mean"))


#: (mean below, gamma): the bright, the strict and the array form. Fixed values.
GAMMA_STEPS = {
    "standard": ((20, 2.0), (40, 1.6), (60, 1.4), (80, 1.2), (100, 1.0), (120, 0.8), (140, 0.6), (160, 0.4), (180, 0.3), (200, 0.2), (220, 0.1), (256, 0.05)),
    "strict": ((32, 2.0), (64, 1.5), (96, 1.0), (128, 0.7), (160, 0.4), (192, 0.2), (224, 0.05), (256, 0.01)),
    "array": ((64, 4.0), (96, 3.0), (128, 2.0), (160, 1.5), (256, 1.0)),
}


def gamma_for_mean(mean: Column, table: str) -> Column:
    """Gamma by steps of the mean."""
    steps = GAMMA_STEPS[table]
    out = F.lit(steps[-1][1])
    for below, g in reversed(steps[:-1]):
        out = F.when(mean < below, g).otherwise(out)
    return out


def stretched(v: Column, lo: Column, hi: Column) -> Column:
    return F.when((hi == lo) | ((lo == 0) & (hi == 255)), v).otherwise(F.floor(F.lit(255) * (v - lo) / F.greatest(hi - lo, F.lit(1)))).cast("int")


def stretch(df: DataFrame, keys: list[str], white_cut: int | None = None) -> DataFrame:
    """Values stretched to 0..255 within each key; with a cut, brighter cells turn white and do not count."""
    counted = F.col("v") if white_cut is None else F.when(F.col("v") <= white_cut, F.col("v"))
    span = df.groupBy(*keys).agg(F.min(counted).alias("lo"), F.max(counted).alias("hi"))
    out = stretched(F.col("v"), F.col("lo"), F.col("hi"))
    if white_cut is not None:
        out = F.when(F.col("v") > white_cut, 255).otherwise(out)
    return df.join(span, keys).select(*KEY, out.alias("v"))


def dominant_bucket_gamma(df: DataFrame, width: int = 10, cut: int = 240) -> DataFrame:
    """A10: tones by the middle p of the most frequent bucket of cells up to the cut; none if p > 180."""
    b = df.where(F.col("v") <= cut).groupBy("grid_id", F.floor(F.col("v") / width).cast("int").alias("b")).agg(F.count("*").alias("n"))
    top = b.groupBy("grid_id").agg(F.max_by("b", F.struct(F.col("n"), (-F.col("b")).alias("nb"))).alias("b"))
    p = F.col("b") * width + width // 2
    gamma = F.least(F.lit(400.0) / p, F.lit(7.0))
    return df.join(top, "grid_id", "left").select(*KEY, F.when((p > 180) | (F.col("v") > 240) | p.isNull(), F.col("v")).otherwise(gamma_value(F.col("v"), gamma)).alias("v"))


def global_gamma(df: DataFrame, power: int = 1, cut: int | None = None, least: int = 10) -> DataFrame:
    """Gamma by the value's ratio to its grid's mean (of cells below the cut), to a power, 7 at most."""
    counted = F.col("v") if cut is None else F.when(F.col("v") < cut, F.col("v"))
    m = df.groupBy("grid_id").agg(F.avg(counted).alias("m"), F.count(counted).alias("n"))
    out = F.when(F.col("n") < least, F.col("v")).otherwise(N.ratio_gamma(F.col("v"), F.col("m"), power))
    return df.join(m, "grid_id").select(*KEY, out.cast("int").alias("v"))


def normalise_tiles(df: DataFrame, dx: int, dy: int) -> DataFrame:
    """Tiles moved to the grid's mean."""
    tiled = tile(df, dx, dy)
    t = tiled.groupBy(*TILE).agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    g = Window.partitionBy("grid_id")
    t = t.withColumn("move", F.floor(F.sum("s").over(g) / F.sum("n").over(g)) - F.floor(F.col("s") / F.col("n")))
    return tiled.join(t.select(*TILE, "move"), TILE).select(*KEY, N.clamped(F.col("v") + F.col("move")).cast("int").alias("v"))


def tile_colour_peak(df: DataFrame, percent: int, dx: int, dy: int) -> DataFrame:
    """Dark where all three colours reach their tile's peak less some percent."""
    tiled = tile(df, dx, dy)
    peak = tiled.groupBy(*TILE).agg(*[F.max(c).alias(f"m{c}") for c in "rgb"])
    hit = F.lit(True)
    for c in "rgb":
        hit = hit & (F.col(c) * 100 >= F.col(f"m{c}") * (100 - percent))
    return tiled.join(peak, TILE).select(*KEY, F.when(hit, 0).otherwise(255).alias("v"))


def skew_angle(df: DataFrame, angles: tuple[int, ...], cut: int = 128) -> DataFrame:
    """The angle whose projection of dark cells has the greatest sum of squared rows. The angles are a short
    list in each row, and counts meet by (grid, angle, row)."""
    dark = df.where(F.col("v") < cut).withColumn("angle", F.explode(F.array(*[F.lit(a) for a in angles])))
    slope = F.round(F.tan(F.radians(F.col("angle").cast("double"))), 9)
    rows = dark.groupBy("grid_id", "angle", F.floor(F.col("y") + 0.5 - F.col("x") * slope).cast("int").alias("row")).agg(F.count("*").alias("n"))
    score = rows.groupBy("grid_id", "angle").agg(F.sum(F.col("n") * F.col("n")).alias("score"))
    best = F.max_by(F.struct("angle", "score"), F.struct(F.col("score"), (-F.abs("angle")).alias("a"), F.col("angle")))
    return score.groupBy("grid_id").agg(best.alias("b")).select("grid_id", "b.angle", "b.score")


def smooth_histogram(df: DataFrame, period: int = 5, turns: int = 2) -> DataFrame:
    """s[i] = int((1 - k) s[i-1] + k h[i]) over the 256 counts, k = 2 / (period + 1), repeated. A fold over an array
    of fixed size; exact in whole numbers, as k is a fraction."""
    counts = df.groupBy("grid_id", "v").agg(F.count("*").alias("n"))
    counts = counts.groupBy("grid_id").agg(F.map_from_entries(F.collect_list(F.struct("v", "n"))).alias("m"))
    h = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0)).cast("long"))
    out = counts.select("grid_id", h.alias("h"))

    def ema(a: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("p"), F.array().cast("array<bigint>").alias("s"))

        def step(s: Column, x: Column) -> Column:
            p = F.floor(((period - 1) * s["p"] + 2 * x) / (period + 1)).cast("long")
            return F.struct(p.alias("p"), F.concat(s["s"], F.array(p)).alias("s"))

        return F.aggregate(a, start, step, lambda s: s["s"])

    for _ in range(turns):
        out = out.withColumn("h", ema(F.col("h")))
    return out.withColumnRenamed("h", "s")


def valley_threshold(df: DataFrame, period: int = 3, turns: int = 1, below: int = 225) -> DataFrame:
    """The least smoothed count strictly between the first two of the four greatest bins, by value (between the
    second and third where the grid's mean is over 200)."""
    s = smooth_histogram(df, period, turns).join(df.groupBy("grid_id").agg(F.avg("v").alias("mean")), "grid_id")
    bins = F.transform(F.slice("s", 1, below), lambda n, i: F.struct(n.alias("n"), (-i).alias("i")))
    top = F.array_sort(F.transform(F.slice(F.reverse(F.array_sort(bins)), 1, 4), lambda b: -b["i"]))
    first = F.when(F.col("mean") > 200, 1).otherwise(0)
    out = s.withColumn("top", top).withColumn("a", F.get("top", first)).withColumn("b", F.get("top", first + 1))
    between = F.transform(F.slice("s", F.col("a") + 2, F.greatest(F.col("b") - F.col("a") - 1, F.lit(0))), lambda n, i: F.struct(n.alias("n"), (i + F.col("a") + 1).alias("i")))
    return out.select("grid_id", "a", "b", F.coalesce(F.array_min(between)["i"], F.col("a")).cast("int").alias("cut"))


def thin_strip_gamma(df: DataFrame, dx: int, dy: int) -> DataFrame:
    """Tones by W02's cut of each tile."""
    tiled = tile(df, dx, dy).withColumn("_g", F.col("grid_id"))
    keyed = tiled.withColumn("grid_id", F.struct("_g", "tx", "ty"))
    cuts = valley_threshold(keyed).select("grid_id", "cut")
    r = F.col("v") / F.greatest(F.col("cut"), F.lit(1))
    return keyed.join(cuts, "grid_id").select(F.col("_g").alias("grid_id"), "x", "y", gamma_value(F.col("v"), F.least(F.lit(6.95), r * r * r)).alias("v"))


def knee_base(df: DataFrame, k: int = 3) -> DataFrame:
    """Base is two values after the largest second difference of the sorted neighbourhood; tone v / (base + 1),
    moved by 0.1, cubed."""
    k = N.odd(k)
    if k * k > R.SMALL:
        got = R.by_histogram(df, k, k, ["base"], R.knees)
        base = F.col("base")
    else:
        got = N.gather(df, k, k).withColumn("a", F.array_sort(N.values(F.col("near"))))
        second = F.transform(F.sequence(F.lit(0), F.greatest(F.size("a") - 3, F.lit(0))), lambda i: F.coalesce(F.get("a", i + 2) - 2 * F.get("a", i + 1) + F.get("a", i), F.lit(0)))
        got = got.withColumn("d", second)
        base = F.get("a", F.least(F.array_position("d", F.array_max("d")).cast("int") + 1, F.size("a") - 1))
    r = F.col("v") / (base + 1.0)
    r = F.when(r > 1, r + 0.1).otherwise(F.greatest(r - 0.1, F.lit(0.0)))
    return N.out(got, gamma_value(F.col("v"), F.least(F.lit(7.0), r * r * r)))


def bridge_fill(df: DataFrame, gap: int, cut: int = 128, white: bool = False, axis: str = "x", down_to: int | None = None) -> DataFrame:
    """Cells between two bright (or dark) ones gap + 1 apart in their row (``axis`` x) or column (y) take the
    ends' mean; the least of overlapping fills wins, or the greatest for white bridges. ``down_to``: the iterative form,
    over gaps from ``gap`` down to this one."""
    if down_to is not None:
        for g in range(gap, down_to - 1, -1):
            df = bridge_fill(df, g, cut, white, axis)
        return df
    w = T.row() if axis == "x" else T.col()
    at = lambda d: F.max("v").over(w.rangeBetween(d, d))
    ok = (lambda c: F.col(c) < cut) if white else (lambda c: F.col(c) > cut)
    got = T.tiled(df, gap, 0) if axis == "x" else T.tiled(df, 0, gap)
    fills = []
    for before in range(1, gap + 1):
        got = got.withColumn(f"l{before}", at(-before)).withColumn(f"r{before}", at(gap + 1 - before))
        fills.append(F.when(ok(f"l{before}") & ok(f"r{before}"), F.floor((F.col(f"l{before}") + F.col(f"r{before}")) / 2)))
    best = (F.greatest if white else F.least)(*fills) if len(fills) > 1 else fills[0]
    return N.out(T.kept(got.withColumn("best", best)), F.coalesce("best", "v"))


def lighten_intermediates(df: DataFrame) -> DataFrame:
    """One or two cells over 16 between cells under 8 become 180, rows and then columns."""
    for w, halo in ((T.row(), (2, 0)), (T.col(), (0, 2))):
        p1, p2, n1, n2 = (F.max("v").over(w.rangeBetween(d, d)) for d in (-1, -2, 1, 2))
        hit = (F.col("v") > 16) & (((p1 < 8) & (n1 < 8)) | ((p1 < 8) & (n1 > 16) & (n2 < 8)) | ((p2 < 8) & (p1 > 16) & (n1 < 8)))
        df = N.out(T.kept(T.tiled(df, *halo).withColumn("hit", hit)), F.when(F.col("hit"), 180).otherwise(F.col("v")))
    return df


def whiten_long_runs(df: DataFrame, k: int, bright: int = 200, share: float = 0.1) -> DataFrame:
    """The row frames of k around dark cells with few bright ones turn white."""
    r = N.odd(k) // 2
    got = T.tiled(df, 2 * r, 0).withColumn("n", T.sum_within((F.col("v") > bright).cast("int"), T.row(), -r, r)).withColumn("all", T.sum_within(F.lit(1), T.row(), -r, r))
    got = got.withColumn("dark", ((F.col("v") < 128) & (F.col("n") <= F.col("all") * share)).cast("int"))
    got = got.withColumn("hit", T.sum_within(F.col("dark"), T.row(), -r, r))
    return N.out(T.kept(got), F.when(F.col("hit") > 0, 255).otherwise(F.col("v")))
