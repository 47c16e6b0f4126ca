"""Tiles with halos: how neighbourhood work is dealt out.

A grid is cut into square tiles of ``TILE`` cells a side. A tile also gets copies of the cells around it that its own
cells look at, its halo, so all windows of a tile are filled inside it. That takes one exchange, by grid and tile; a task
holds some tiles, whatever the size of a picture. Copies are dropped when the windows are done.

Sums over boxes come from prefix sums along rows and then along columns (a summed-area table inside the tile): the sum up to
the box's end less the sum up to its start. Either is a running window, so the work of a cell does not grow with the box.

A window along a column sees what the rows' windows left at its own x only. So where a row of a grid with holes lacks cells,
``filled`` puts empty ones in their places first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

TILE = 256
AT = ["grid_id", "_tx", "_ty"]


def tile_of(c: Column) -> Column:
    """Cells left of or above 0 belong to the first tile."""
    return F.greatest(F.lit(0), F.floor(c / TILE)).cast("int")


def tiled(df: DataFrame, rx: int, ry: int) -> DataFrame:
    """Cells by tile, _tx and _ty, with halos of rx and ry cells; _own tells a tile's own cells from copies."""
    own = (tile_of(F.col("x")) == F.col("_tx")) & (tile_of(F.col("y")) == F.col("_ty"))
    out = df
    for c, r, t in (("x", rx, "_tx"), ("y", ry, "_ty")):
        reach = F.sequence(tile_of(F.col(c) - r), tile_of(F.col(c) + r)) if r else F.array(tile_of(F.col(c)))
        out = out.select("*", F.explode(reach).alias(t))
    return out.repartition(*AT).withColumn("_own", own)


def filled(tiled: DataFrame) -> DataFrame:
    """Adds the cells that the rows of a tile lack between its least and greatest x, with a null v; _there tells cells from
    these. Rows without a cell are not added. Columns of aggregates count where _there holds only."""
    tile = Window.partitionBy(*AT)
    got = tiled.select("*", F.lag("x").over(row()).alias("_before"), F.lead("x").over(row()).alias("_after"))
    got = got.select("*", F.min("x").over(tile).alias("_x0"), F.max("x").over(tile).alias("_x1"))
    x, none = F.col("x"), F.array().cast("array<int>")
    end = F.coalesce(F.col("_after") - 1, F.col("_x1"))
    right = F.when(x < end, F.sequence(x + 1, end)).otherwise(none)
    left = F.when(F.col("_before").isNull() & (x > F.col("_x0")), F.sequence(F.col("_x0"), x - 1)).otherwise(none)
    got = got.select("*", F.explode(F.concat(F.array(x), right, left)).alias("_at")).withColumn("_there", F.col("_at") == x)
    got = got.withColumns({"x": F.col("_at"), "v": F.when(F.col("_there"), F.col("v")), "_own": F.col("_own") & F.col("_there")})
    return got.drop("_before", "_after", "_x0", "_x1", "_at")


def kept(df: DataFrame) -> DataFrame:
    """The tiles' own cells."""
    return df.where("_own").drop("_tx", "_ty", "_own", "_there")


def row() -> WindowSpec:
    return Window.partitionBy(*AT, "y").orderBy("x")


def col() -> WindowSpec:
    return Window.partitionBy(*AT, "x").orderBy("y")


def sum_within(c: Column, w: WindowSpec, low: int, high: int) -> Column:
    """Sum over the cells at offsets low to high of an ordered window, from two running sums. Whole numbers only."""
    upto = F.sum(c).over(w.rangeBetween(Window.unboundedPreceding, high))
    before = F.sum(c).over(w.rangeBetween(Window.unboundedPreceding, low - 1))
    return F.coalesce(upto, F.lit(0)) - F.coalesce(before, F.lit(0))


def box_sums(df: DataFrame, sums: dict[str, tuple[Column, int, int]]) -> DataFrame:
    """Adds, for cells in tiles, sums of whole numbers over boxes: name -> (what, radius in x, radius in y)."""
    rows = df.select("*", *[sum_within(c, row(), -rx, rx).alias(f"_{n}") for n, (c, rx, _) in sums.items()])
    cols = rows.select("*", *[sum_within(F.col(f"_{n}"), col(), -ry, ry).alias(n) for n, (_, _, ry) in sums.items()])
    return cols.drop(*[f"_{n}" for n in sums])
