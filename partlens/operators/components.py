"""Connected components of dark cells, for all grids at once, in two levels.

Each tile of a grid labels its own cells first, in one task and by runs of dark cells. What is left are the links between
components of neighbouring tiles that touch across a border: the smallest label is passed along those, with pointers
doubled in each round, until nothing changes. Rounds, and the tables written for them in the shared folder, follow the
graph of tiles, not of cells; pictures of one tile need none. Nothing is collected.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tiles as T


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a local session without one gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="partlens-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, name: str = "components") -> DataFrame:
    """``df`` as a table in the shared folder."""
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def runs(cells: DataFrame, cut: int = 128, axis: str = "x") -> DataFrame:
    """The runs of dark cells along an axis: grid_id, their row y and from x0 to x1; or column x and from y0 to y1."""
    across = "y" if axis == "x" else "x"
    w = Window.partitionBy("grid_id", across).orderBy(axis)
    isle = cells.where(F.col("v") < cut).withColumn("i", F.col(axis) - F.row_number().over(w))
    return isle.groupBy("grid_id", across, "i").agg(F.min(axis).alias(f"{axis}0"), F.max(axis).alias(f"{axis}1")).drop("i")


LABELLED = "grid_id long, y int, x0 int, x1 int, run long, comp long"


def _label_tile(table: pa.Table) -> pa.Table:
    """Runs of a tile's dark cells with the smallest run of their component in it."""
    x, y = table.column("x").to_numpy().astype(np.int64), table.column("y").to_numpy().astype(np.int64)
    order = np.lexsort((x, y))
    x, y = x[order], y[order]
    starts = np.flatnonzero(np.concatenate([[True], (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)]))
    ends = np.append(starts[1:], len(x)) - 1
    row, x0, x1 = y[starts], x[starts], x[ends]
    # a run touches those of the next row that end at its start or later and start at its end or before
    wide = int(x.max() - x.min()) + 2
    place = lambda r, c: r * wide + (c - x.min())
    low = np.searchsorted(place(row, x1), place(row + 1, x0))
    high = np.searchsorted(place(row, x0), place(row + 1, x1), "right")
    n = np.maximum(high - low, 0)
    p = np.repeat(np.arange(len(row)), n)
    q = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    label = np.arange(len(row))
    while True:
        least = np.minimum(label[p], label[q])
        before = label.copy()
        np.minimum.at(label, before[p], least)
        np.minimum.at(label, before[q], least)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(label, before):
            break
    run = (row << 31) + x0
    grid = table.column("grid_id")[0].as_py()
    ints = [pa.array(c.astype(np.int32)) for c in (row, x0, x1)]
    return pa.table([pa.array(np.full(len(row), grid, np.int64)), *ints, pa.array(run), pa.array(run[label])], names=["grid_id", "y", "x0", "x1", "run", "comp"])


def label(cells: DataFrame, cut: int = 128) -> DataFrame:
    """grid_id, y, x0, x1, run, comp: runs, cut at borders of tiles, with the smallest run id of their 4-connected component.
    Run ids order by y and x within a grid."""
    dark = cells.where(F.col("v") < cut).select("grid_id", "x", "y", T.tile_of(F.col("x")).alias("_tx"), T.tile_of(F.col("y")).alias("_ty"))
    table = written(dark.groupBy(*T.AT).applyInArrow(_label_tile, LABELLED))
    links = written(_across(table))
    if links.isEmpty():
        return table
    labels = links.select("grid_id", F.col("p").alias("comp")).distinct().select("grid_id", "comp", F.col("comp").alias("to"))
    while True:
        # the smallest label among a component and its neighbours, for it and for the label it had
        near = links.join(labels.select("grid_id", F.col("comp").alias("q"), F.col("to").alias("c")), ["grid_id", "q"]).groupBy("grid_id", F.col("p").alias("comp")).agg(F.min("c").alias("c"))
        low = labels.join(near, ["grid_id", "comp"]).withColumn("c", F.least("to", "c"))
        hook = low.groupBy("grid_id", "to").agg(F.min("c").alias("next"))
        jump = hook.alias("h").join(hook.alias("k"), (F.col("h.grid_id") == F.col("k.grid_id")) & (F.col("h.next") == F.col("k.to")), "left")
        jump = jump.select("h.grid_id", "h.to", F.coalesce("k.next", "h.next").alias("next"))
        after = written(labels.join(jump, ["grid_id", "to"]).select("grid_id", "comp", F.col("next").alias("to"), (F.col("to") != F.col("next")).alias("moved")))
        labels = after.drop("moved")
        if after.where("moved").isEmpty():
            break
    return table.join(labels, ["grid_id", "comp"], "left").select("grid_id", "y", "x0", "x1", "run", F.coalesce("to", "comp").alias("comp"))


def _across(table: DataFrame) -> DataFrame:
    """Pairs p, q (both ways) of components that touch across a border of tiles."""
    first = lambda c: (F.col(c) % T.TILE == 0) & (F.col(c) > 0)
    last = lambda c: F.col(c) % T.TILE == T.TILE - 1
    near = table.select("grid_id", "y", "x0", "x1", "comp")
    above = near.where(last("y")).select("grid_id", (F.col("y") + 1).alias("y"), T.tile_of(F.col("x0")).alias("t"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("comp").alias("p"))
    below = near.where(first("y")).select("grid_id", "y", T.tile_of(F.col("x0")).alias("t"), F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("comp").alias("q"))
    down = above.join(below, ["grid_id", "y", "t"]).where("a0 <= b1 AND b0 <= a1").select("grid_id", "p", "q")
    left = near.where(last("x1")).select("grid_id", "y", (F.col("x1") + 1).alias("x"), F.col("comp").alias("p"))
    right = near.where(first("x0")).select("grid_id", "y", F.col("x0").alias("x"), F.col("comp").alias("q"))
    links = down.unionByName(left.join(right, ["grid_id", "y", "x"]).select("grid_id", "p", "q"))
    return links.unionByName(links.select("grid_id", F.col("q").alias("p"), F.col("p").alias("q"))).distinct()


def boxes(labelled: DataFrame) -> DataFrame:
    """Bounding box and size of each component."""
    x, y = F.min("x0"), F.min("y")
    return labelled.groupBy("grid_id", "comp").agg(
        x.cast("int").alias("x"), y.cast("int").alias("y"), (F.max("x1") - x + 1).cast("int").alias("w"), (F.max("y") - y + 1).cast("int").alias("h"),
        F.sum(F.col("x1") - F.col("x0") + 1).cast("long").alias("n"),
    )


def remove_long_lines(cells: DataFrame, least: int, direction: str = "horizontal", cut: int = 128, shortest: int = 10) -> DataFrame:
    """Cells of components that hold a straight run of ``least`` + 2 dark cells in a direction turn white. ``both``
    removes horizontal lines first and vertical ones from what is left. ``least`` up to ``shortest`` changes nothing."""
    if least <= shortest:
        return cells.select("grid_id", "x", "y", "v")
    if direction == "both":
        return remove_long_lines(remove_long_lines(cells, least, "horizontal", cut, shortest), least, "vertical", cut, shortest)
    lab = label(cells, cut)
    if direction == "horizontal":
        long = runs(cells, cut).where(F.col("x1") - F.col("x0") + 1 >= least + 2).select("grid_id", "y", F.col("x0").alias("x"))
    else:
        long = runs(cells, cut, "y").where(F.col("y1") - F.col("y0") + 1 >= least + 2).select("grid_id", F.col("y0").alias("y"), "x")
    hit = lab.join(long, ["grid_id", "y"]).where("x BETWEEN x0 AND x1").select("grid_id", "comp").distinct()
    gone = lab.join(hit, ["grid_id", "comp"]).select("grid_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), F.lit(True).alias("gone"))
    return cells.join(gone, ["grid_id", "x", "y"], "left").select("grid_id", "x", "y", F.when(F.col("gone"), 255).otherwise(F.col("v")).alias("v"))


def filter_components(box: DataFrame, cw: float, ch: float, word: bool = False) -> DataFrame:
    """Components of the size of characters; in the form for words up to three characters wide and of any height."""
    fits = (F.col("w") * 5 >= cw) & (F.col("h") * 2 >= ch)
    return box.where(fits & (F.col("w") <= 3 * cw) if word else fits & (F.col("h") <= 1.3 * ch) & (F.col("w") <= 2.5 * cw))


def boxes_in_line(cells: DataFrame, cw: float, ch: float, cut: int = 128) -> DataFrame:
    """Boxes wider than cw / 4 and higher than ch / 2, by their right edges."""
    box = boxes(label(cells, cut)).where((F.col("w") * 4 > cw) & (F.col("h") * 2 > ch))
    return box.withColumn("nth", F.row_number().over(Window.partitionBy("grid_id").orderBy(F.col("x") + F.col("w"), "y", "comp")))
