"""Character boxes and text lines.

Greedy, order-dependent groupings of boxes are replaced by order-free ones: pairs that belong together are
linked, and linked boxes form a line. All joins carry grid_id, so no pair crosses grids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dealing import dealt

LINE = ["grid_id", "line_id"]


def overlap(a: str, b: str, side: str, length: str) -> Column:
    """Common length of two boxes along one side, 0 if apart."""
    low = F.greatest(F.col(f"{a}.{side}"), F.col(f"{b}.{side}"))
    high = F.least(F.col(f"{a}.{side}") + F.col(f"{a}.{length}"), F.col(f"{b}.{side}") + F.col(f"{b}.{length}"))
    return F.greatest(F.lit(0), high - low)


def area(a: str = "a", b: str = "b") -> Column:
    """J02's measure."""
    return overlap(a, b, "x", "w") * overlap(a, b, "y", "h")


def box_pairs(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of different boxes of a key, each once. Boxes that overlap share a cell of a coarse grid in x, so the
    join meets only neighbours: each box stands in the cells it touches, and a pair counts in the first it shares."""
    width = 64
    cells = boxes.withColumn("cell", F.explode(F.sequence(F.floor(F.col("x") / width), F.floor((F.col("x") + F.col("w")) / width))))
    a, b = cells.alias("a"), cells.alias("b")
    on = F.col("a.cell") == F.col("b.cell")
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    first = F.floor(F.greatest(F.col("a.x"), F.col("b.x")) / width)
    return a.join(b, on & (F.col("a.box_id") < F.col("b.box_id")) & (F.col("a.cell") == first))


def box_overlap(boxes: DataFrame) -> DataFrame:
    """Overlapping pairs of a line and their common area."""
    return box_pairs(boxes, LINE).withColumn("area", area()).where("area > 0").select("a.grid_id", "a.line_id", F.col("a.box_id").alias("a_id"), F.col("b.box_id").alias("b_id"), "area")


def interval_overlap(boxes: DataFrame) -> DataFrame:
    """Vertical overlap of neighbouring boxes of a line by x: absolute, and the greater share of either height."""
    w = Window.partitionBy(*LINE).orderBy("x", "box_id")
    prev = boxes.withColumn("py", F.lag("y").over(w)).withColumn("ph", F.lag("h").over(w)).where("py IS NOT NULL")
    common = F.greatest(F.lit(0), F.least(F.col("y") + F.col("h"), F.col("py") + F.col("ph")) - F.greatest("y", "py"))
    return prev.select("grid_id", "line_id", "box_id", common.alias("overlap"), F.round(F.greatest(common / F.col("h"), common / F.col("ph")), 9).alias("share"))


def drop_overlapping(boxes: DataFrame, least: float = 0.0, of_area: Column | None = None) -> DataFrame:
    """Both members of each pair of a line that overlaps by more than ``least`` (times ``of_area``) go."""
    limit = F.lit(least) if of_area is None else of_area * least
    bad = box_pairs(boxes, LINE).where(area() > limit).select(F.explode(F.array(F.struct("a.grid_id", "a.box_id"), F.struct("b.grid_id", "b.box_id"))).alias("k")).select("k.*").distinct()
    return boxes.join(bad, ["grid_id", "box_id"], "left_anti")


def boxes_to_lines(boxes: DataFrame, tolerance: int = 10) -> DataFrame:
    """Boxes whose tops follow within the tolerance, in order of y, are one line: gaps and islands, which gives
    the components of "close in y" without pairs. Adds line, numbered from the top."""
    w = Window.partitionBy("grid_id").orderBy("y", "x", "box_id")
    start = (F.col("y") - F.coalesce(F.lag("y").over(w), F.lit(-(10**6))) > tolerance).cast("int")
    return boxes.withColumn("_s", start).withColumn("line", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_s")


def attach_lone_boxes(boxes: DataFrame) -> DataFrame:
    """A line of one box joins the nearest line by x-gap whose mean top is within half a box height and whose gap is
    less than 2.5 widths. Lines are summarised first, so the join meets lines, not boxes."""
    stats = boxes.groupBy(*LINE).agg(F.count("*").alias("n"), F.min("x").alias("lx"), F.max(F.col("x") + F.col("w")).alias("rx"), F.floor(F.avg("y")).cast("int").alias("my"))
    lone = boxes.join(stats.where("n = 1").select(*LINE), LINE)
    gap = F.greatest(F.lit(0), F.col("l.lx") - (F.col("b.x") + F.col("b.w")), F.col("b.x") - F.col("l.rx"))
    j = lone.alias("b").join(stats.where("n > 1").alias("l"), F.col("b.grid_id") == F.col("l.grid_id"))
    j = j.where((F.abs(F.col("b.y") - F.col("l.my")) * 2 <= F.col("b.h")) & (gap * 2 < F.col("b.w") * 5))
    best = j.groupBy("b.grid_id", "b.box_id").agg(F.min_by("l.line_id", F.struct(gap.alias("gap"), F.col("l.line_id"))).alias("to"))
    return boxes.join(best, ["grid_id", "box_id"], "left").select(*[c for c in boxes.columns if c != "line_id"], F.coalesce("to", "line_id").alias("line_id"))


def commons_percentile(values: Column, p: float) -> Column:
    """Percentile at p (n + 1) of a sorted array, linear between neighbours."""
    n = F.size(values)
    pos = F.lit(p) * (n + 1)
    at = F.floor(pos).cast("int")
    low, high = F.get(values, F.greatest(at - 1, F.lit(0))), F.get(values, F.least(at, n - 1))
    return F.when(pos < 1, F.get(values, F.lit(0))).when(pos >= n, F.get(values, n - 1)).otherwise(low + (pos - at) * (high - low))


def box_stats(boxes: DataFrame) -> DataFrame:
    """Sizes of a line's boxes: mean, deviation, percentiles 50, 55 and 90 at p (n + 1)."""
    g = boxes.groupBy(*LINE).agg(F.avg("h").alias("m"), F.stddev_samp("h").alias("s"), F.sort_array(F.collect_list("h")).alias("a"))
    pct = [F.round(commons_percentile(F.col("a"), p), 6).alias(f"p{int(p * 100)}") for p in (0.5, 0.55, 0.9)]
    return g.select(*LINE, F.round("m", 6).alias("mean"), F.round("s", 6).alias("sd"), *pct)


def modal_size(boxes: DataFrame, column: str = "h") -> DataFrame:
    """Bin width 0.9 sd n^-0.2 (2 at least, 9 at most; 3 where n <= 8); the bin with the greatest sum of three
    neighbours, the first of equals, and the mean of it and its larger neighbour, weighted by counts."""
    s = boxes.groupBy("grid_id").agg(F.coalesce(F.stddev_samp(column), F.lit(0.0)).alias("sd"), F.count("*").alias("n"))
    width = F.when(F.col("n") <= 8, 3).otherwise(F.greatest(F.lit(2), F.least(F.lit(9), F.floor(F.round(F.lit(0.9) * F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)), 6)))))
    s = s.withColumn("width", width.cast("int"))
    bins = boxes.join(s, "grid_id").groupBy("grid_id", "width", F.floor(F.col(column) / F.col("width")).cast("int").alias("b")).agg(F.count("*").alias("c"))
    table = bins.groupBy("grid_id", "width").agg(F.map_from_entries(F.collect_list(F.struct("b", "c"))).alias("m"))
    at = lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0))
    best = F.array_max(F.transform(F.map_keys("m"), lambda b: F.struct((at(b - 1) + at(b) + at(b + 1)).alias("s"), (-b).alias("b"))))
    out = table.withColumn("b", -best["b"])
    other = F.when(at(F.col("b") + 1) > at(F.col("b") - 1), F.col("b") + 1).otherwise(F.col("b") - 1)
    out = out.withColumn("o", other)
    centre = lambda b: b * F.col("width") + F.col("width") / 2
    size = (centre(F.col("b")) * at(F.col("b")) + centre(F.col("o")) * at(F.col("o"))) / (at(F.col("b")) + at(F.col("o")))
    return out.select("grid_id", "width", F.col("b").alias("bin"), F.round(size, 6).alias("size"))


def line_envelope(boxes: DataFrame) -> DataFrame:
    """The union box of each line."""
    x, y = F.min("x"), F.min("y")
    return boxes.groupBy(*LINE).agg(x.alias("x"), y.alias("y"), (F.max(F.col("x") + F.col("w")) - x).alias("w"), (F.max(F.col("y") + F.col("h")) - y).alias("h"), F.count("*").alias("n"))


def drop_short_lines(boxes: DataFrame, least: int) -> DataFrame:
    """A24."""
    return boxes.withColumn("_n", F.count("*").over(Window.partitionBy(*LINE))).where(F.col("_n") >= least).drop("_n")


def split_by_gap(boxes: DataFrame, gap: float) -> DataFrame:
    """A new segment of a line where the gap to the box before is greater. Adds seg, from 1."""
    w = Window.partitionBy(*LINE).orderBy("x", "box_id")
    wide = (F.col("x") - F.lag(F.col("x") + F.col("w")).over(w) > gap).cast("int")
    return boxes.withColumn("_g", F.coalesce(wide, F.lit(0))).withColumn("seg", (F.sum("_g").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).cast("int")).drop("_g")


def as_lines(boxes: DataFrame) -> DataFrame:
    """Segments become lines of their own."""
    return boxes.withColumn("line_id", F.col("line_id") * 1000 + F.col("seg")).drop("seg")


def merge_by_y(boxes: DataFrame, ratio: float) -> DataFrame:
    """A line joins the one above if the vertical overlap of its first box with that line's last box exceeds a share
    of their mean height. Only one row a line is ordered; line_id becomes the first line's."""
    first, last = F.min_by(F.struct("y", "h"), F.struct("x", "box_id")), F.max_by(F.struct("y", "h"), F.struct("x", "box_id"))
    lines = boxes.groupBy(*LINE).agg(first.alias("f"), last.alias("l"), F.min("y").alias("top"))
    w = Window.partitionBy("grid_id").orderBy("top", "line_id")
    p = F.lag("l").over(w)
    common = F.least(F.col("f.y") + F.col("f.h"), p["y"] + p["h"]) - F.greatest(F.col("f.y"), p["y"])
    lines = lines.withColumn("new", F.coalesce((common <= ratio * (F.col("f.h") + p["h"]) / 2).cast("int"), F.lit(1)))
    lines = lines.withColumn("isle", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lines = lines.withColumn("to", F.first("line_id").over(Window.partitionBy("grid_id", "isle").orderBy("top", "line_id")))
    return boxes.join(lines.select(*LINE, "to"), LINE).select(*[c for c in boxes.columns if c != "line_id"], F.col("to").alias("line_id"))


def reading_order(boxes: DataFrame) -> DataFrame:
    """Boxes by x in their lines; lines by the top of their first box in buckets of 10, then x. Adds nth and line_no."""
    first = boxes.groupBy(*LINE).agg(F.min_by(F.struct("y", "x"), F.struct("x", "box_id")).alias("f"))
    order = Window.partitionBy("grid_id").orderBy(F.floor(F.col("f.y") / 10), F.col("f.x"), "line_id")
    lines = first.withColumn("line_no", F.row_number().over(order)).drop("f")
    return boxes.join(lines, LINE).withColumn("nth", F.row_number().over(Window.partitionBy(*LINE).orderBy("x", "box_id")))


def medians(boxes: DataFrame, keys: list[str], **columns: Column) -> DataFrame:
    return boxes.groupBy(*keys).agg(*[F.percentile(c, F.lit(0.5)).alias(n) for n, c in columns.items()])


def drop_wrong_y(boxes: DataFrame) -> DataFrame:
    """Boxes whose top is within 0.4 median heights of the median top, which is taken over boxes within half of
    the median height."""
    line = Window.partitionBy(*LINE)
    got = boxes.withColumn("mh", F.percentile("h", F.lit(0.5)).over(line))
    near = F.when(F.abs(F.col("h") - F.col("mh")) <= F.col("mh") / 2, F.col("y"))
    got = got.withColumn("my", F.percentile(near, F.lit(0.5)).over(line))
    return got.where(F.abs(F.col("y") - F.col("my")) < F.col("mh") * 0.4).drop("mh", "my")


def default_boxes(boxes: DataFrame, height: int, width: int) -> DataFrame:
    """Boxes over both limits and over 0.7 of their grid's median height."""
    big = boxes.where((F.col("h") > height) & (F.col("w") > width))
    return big.join(medians(big, ["grid_id"], mh=F.col("h")), "grid_id").where(F.col("h") > F.col("mh") * 0.7).drop("mh")


def drop_odd_sizes(boxes: DataFrame, least_h: float, most_w: float) -> DataFrame:
    """W09."""
    return boxes.where((F.col("w") <= most_w) & (F.col("h") >= least_h))


def two_lines(boxes: DataFrame) -> DataFrame:
    """Islands by bottom edge whose heights overlap by more than 0.4 of the one before; the first two stay, the rest
    get no line. Adds line (1, 2 or null)."""
    w = Window.partitionBy("grid_id").orderBy(F.col("y") + F.col("h"), "box_id")
    py, ph = F.lag("y").over(w), F.lag("h").over(w)
    common = F.greatest(F.lit(0), F.least(F.col("y") + F.col("h"), py + ph) - F.greatest(F.col("y"), py))
    new = F.when(py.isNull() | (F.greatest(common / F.col("h"), common / ph) <= 0.4), 1).otherwise(0)
    got = boxes.withColumn("_n", new).withColumn("line", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_n")
    return got.withColumn("line", F.when(F.col("line") <= 2, F.col("line")))


def longest_line(boxes: DataFrame) -> DataFrame:
    """Boxes of each grid's line with most boxes; the first of equals."""
    n = boxes.repartition("grid_id").withColumn("_n", F.count("*").over(Window.partitionBy(*LINE)))
    best = F.min(F.struct((-F.col("_n")).alias("n"), "line_id")).over(Window.partitionBy("grid_id"))
    return n.withColumn("_best", best).where("line_id = _best.line_id").drop("_n", "_best")


def order_and_arrange(boxes: DataFrame, char_height: int) -> DataFrame:
    """Lines whose tops follow within a quarter height merge, split at gaps of 2.2 heights or more, and boxes of a
    segment that start within 4 of the one before become their union."""
    boxes = dealt(boxes.select("grid_id", "box_id", "x", "y", "w", "h"), "grid_id")
    lines = boxes_to_lines(boxes, char_height // 4).withColumn("line_id", F.col("line")).drop("line")
    seg = split_by_gap(lines, 0.8 * char_height * 2.75 - 1e-9)
    w = Window.partitionBy("grid_id", "line_id", "seg").orderBy("x", "box_id")
    apart = F.coalesce((F.col("x") - F.lag("x").over(w) > 4).cast("int"), F.lit(1))
    seg = seg.withColumn("_a", apart).withColumn("nth", F.sum("_a").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    x, y = F.min("x"), F.min("y")
    return seg.groupBy("grid_id", "line_id", "seg", "nth").agg(x.alias("x"), y.alias("y"), (F.max(F.col("x") + F.col("w")) - x).alias("w"), (F.max(F.col("y") + F.col("h")) - y).alias("h"))


def merge_close_lines(boxes: DataFrame, share: float, gap: float) -> DataFrame:
    """Neighbouring lines, by top, merge where their envelopes overlap by a share of the lesser height and
    their x-gap is below ``gap`` mean heights."""
    e = line_envelope(boxes)
    w = Window.partitionBy("grid_id").orderBy("y", "x", "line_id")
    py, ph, px, pw = (F.lag(c).over(w) for c in ("y", "h", "x", "w"))
    common = F.least(F.col("y") + F.col("h"), py + ph) - F.greatest(F.col("y"), py)
    between = F.greatest(F.lit(0), F.col("x") - (px + pw), px - (F.col("x") + F.col("w")))
    joined = (common > share * F.least(F.col("h"), ph)) & (between < gap * (F.col("h") + ph) / 2)
    e = e.withColumn("new", F.coalesce((~joined).cast("int"), F.lit(1))).withColumn("isle", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    to = e.withColumn("to", F.first("line_id").over(Window.partitionBy("grid_id", "isle").orderBy("y", "x", "line_id"))).select(*LINE, "to")
    return boxes.join(to, LINE).select(*[c for c in boxes.columns if c != "line_id"], F.col("to").alias("line_id"))


def split_wide_gaps(boxes: DataFrame, least: int = 7, gap: float = 4.25) -> DataFrame:
    """W23's split: lines of ``least`` boxes or more split where a gap exceeds ``gap`` median heights."""
    got = boxes.join(medians(boxes, LINE, mh=F.col("h")), LINE).withColumn("_n", F.count("*").over(Window.partitionBy(*LINE)))
    w = Window.partitionBy(*LINE).orderBy("x", "box_id")
    wide = (F.col("x") - F.lag(F.col("x") + F.col("w")).over(w) > F.col("mh") * gap) & (F.col("_n") >= least)
    got = got.withColumn("_g", F.coalesce(wide.cast("int"), F.lit(0)))
    return got.withColumn("seg", (F.sum("_g").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).cast("int")).drop("_g", "_n", "mh")


def drop_stubs(boxes: DataFrame, char_width: int, char_height: int) -> DataFrame:
    """Lines of one or two boxes go if their widths make two characters or fewer, as do single boxes that are
    narrow or low."""
    s = boxes.groupBy(*LINE).agg(F.count("*").alias("n"), F.sum("w").alias("sw"), F.max("w").alias("mw"), F.max("h").alias("mh"))
    stub = ((F.col("n") <= 2) & (F.round(F.col("sw") / char_width) <= 2)) | ((F.col("n") == 1) & ((F.col("mw") <= 0.3 * char_width) | (F.col("mh") <= 0.45 * char_height)))
    return boxes.join(s.where(~stub).select(*LINE), LINE)


def fit_two_by_two(boxes: DataFrame, patterns: tuple[int, int, int, int]) -> DataFrame:
    """Boxes forced into two lines of two columns, whose lengths ``patterns`` gives in reading order.

    Bottoms are counted in buckets of two thirds of the median height. The fullest bucket's mean bottom is one line, that
    of the fullest bucket more than the tolerance (a bucket and 2) away from it the other; the upper one is line 1. A box
    belongs to the nearer line within the tolerance. A line that is short of its patterns takes the nearest of the
    other boxes less than a median height away. A line as long as its patterns is cut by them; else it is cut at its
    widest gap of 2.25 median widths or more, and without one its last boxes, as many as the second pattern has, are
    column 2. Columns of a single box go. Grids that have as many lines as patterns are left alone: their lines count
    from the top, all in column 1. No box is in two lines; boxes in none are left out.
    """
    by_grid = Window.partitionBy("grid_id")
    got = boxes.join(medians(boxes, ["grid_id"], mh=F.col("h"), mw=F.col("w")), "grid_id")
    got = got.withColumn("bottom", F.col("y") + F.col("h")).withColumn("tol", F.col("mh") * 2 / 3 + 2)
    got = got.withColumn("given", F.size(F.collect_set("line_id").over(by_grid)))
    done = got.where(F.col("given") == len(patterns)).withColumn("col", F.lit(1))
    tops = done.groupBy(*LINE).agg(F.min("y").alias("top"))
    tops = tops.withColumn("line", F.row_number().over(by_grid.orderBy("top", "line_id"))).select(*LINE, "line")
    done = done.join(tops, LINE).select(*boxes.columns, "line", "col")

    got = got.where(F.col("given") != len(patterns))
    modes = got.groupBy("grid_id", "tol", F.floor(F.col("bottom") / (F.col("mh") * 2 / 3) + 1e-9).alias("b")).agg(F.count("*").alias("n"), F.avg("bottom").alias("at"))
    order = F.struct((-F.col("n")).alias("n"), F.col("b"))
    modes = modes.withColumn("first", F.min_by("at", order).over(by_grid))
    ends = modes.groupBy("grid_id", "first").agg(F.min(F.when(F.abs(F.col("at") - F.col("first")) > F.col("tol"), F.struct((-F.col("n")).alias("n"), "b", "at")))["at"].alias("second"))
    ends = ends.select("grid_id", F.least("first", "second").alias("upper"), F.when(F.col("second").isNotNull(), F.greatest("first", "second")).alias("lower"))
    got = got.join(ends, "grid_id")
    up, low = F.abs(F.col("bottom") - F.col("upper")), F.abs(F.col("bottom") - F.col("lower"))
    got = got.withColumn("line", F.when(F.coalesce(low < up, F.lit(False)), 2).otherwise(1)).withColumn("away", F.least(up, low))
    of_line = Window.partitionBy("grid_id", "line")
    got = got.withColumn("own", F.col("away") <= F.col("tol")).withColumn("n_own", F.count_if("own").over(of_line))
    want = F.when(F.col("line") == 1, patterns[0] + patterns[1]).otherwise(patterns[2] + patterns[3])
    spare = F.row_number().over(Window.partitionBy("grid_id", "line", "own").orderBy("away", "x", "box_id"))
    got = got.where(F.col("own") | (F.col("away") < F.col("mh"))).withColumn("spare", spare)
    got = got.where(F.col("own") | (F.col("spare") <= want - F.col("n_own")))

    by_x = of_line.orderBy("x", "box_id")
    got = got.withColumn("nth", F.row_number().over(by_x)).withColumn("n", F.count("*").over(of_line))
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(by_x)
    got = got.withColumn("gap", F.when(gap >= F.col("mw") * 2.25, gap))
    cut = F.min(F.when(F.col("gap").isNotNull(), F.struct((-F.col("gap")).alias("gap"), "nth"))).over(of_line)["nth"]
    left, right = (F.when(F.col("line") == 1, patterns[i]).otherwise(patterns[i + 2]) for i in (0, 1))
    first_right = F.when(F.col("n") == want, left + 1).otherwise(F.coalesce(cut, F.col("n") - right + 1))
    got = got.withColumn("col", F.when(F.col("nth") < first_right, 1).otherwise(2))
    got = got.withColumn("n_col", F.count("*").over(Window.partitionBy("grid_id", "line", "col"))).where("n_col > 1")
    return got.select(*boxes.columns, "line", "col").unionByName(done)


def line_pipeline(boxes: DataFrame, cw: int, ch: int, least: int = 4, overlap_share: float = 0.075, low: float = 0.5, wide: float = 2.1, gap: float = 2.75) -> DataFrame:
    """E01 (and E03 with other factors): merge by y, drop overlaps and odd sizes, split at gaps, drop short lines."""
    out = merge_by_y(boxes, 0.375)
    out = drop_overlapping(out, overlap_share, F.lit(cw * ch))
    out = drop_odd_sizes(out, low * ch, wide * cw)
    return drop_short_lines(as_lines(split_by_gap(out, gap * cw)), least)


def word_pipeline(boxes: DataFrame, cw: int, ch: int) -> DataFrame:
    """As E01 without the split, then W07 and the longest line."""
    out = drop_odd_sizes(drop_overlapping(merge_by_y(boxes, 0.375), 0.25, F.lit(cw * ch)), 0.5 * ch, 2.5 * cw)
    return longest_line(drop_wrong_y(merge_by_y(out, 0.375)))


def derivative_plan(boxes: DataFrame, factors: tuple[float, ...] = (0.7, 0.85, 1.0, 1.1, 1.2), ratio: float = 0.6) -> DataFrame:
    """For each line its envelope with a margin of 10 and, for each factor, the scales that make its median height
    28; lines whose boxes are all below 7 are blank."""
    e = line_envelope(boxes).join(medians(boxes, LINE, mh=F.col("h")), LINE).join(boxes.groupBy(*LINE).agg(F.max("h").alias("xh"), F.max("w").alias("xw")), LINE)
    e = e.withColumn("factor", F.explode(F.array(*[F.lit(f) for f in factors])))
    return e.select(
        *LINE, (F.col("x") - 10).alias("x"), (F.col("y") - 10).alias("y"), (F.col("w") + 20).alias("w"), (F.col("h") + 20).alias("h"), "factor",
        F.round(F.lit(28.0) / F.col("mh") * F.col("factor"), 6).alias("scale_y"), F.round(F.lit(28.0) / (F.col("mh") * ratio) * F.col("factor"), 6).alias("scale_x"),
        ((F.col("xh") < 7) | (F.col("xw") < 7)).alias("blank"),
    )
