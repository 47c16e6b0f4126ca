"""Operators on single cells: tones, colours, borders, and pairs of grids at the same place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["grid_id", "x", "y"]


def to_gray(df: DataFrame) -> DataFrame:
    """Three brightness formulas of r, g, b."""
    return df.select(
        *KEY, F.floor(F.col("g") * 0.59 + F.col("r") * 0.3 + F.col("b") * 0.11 + 1e-9).cast("int").alias("weighted"),
        F.floor((F.col("r") + F.col("g") + F.col("b")) / 3).cast("int").alias("mean"),
        F.floor((F.col("r") * 77 + F.col("g") * 151 + F.col("b") * 28) / 256).cast("int").alias("ntsc"),
    )


def binarize(v: Column, cut: int, mode: str = "down") -> Column:
    """``down`` and ``up`` by the cut alone; ``keep`` leaves 0 and 255 alone and sends v <= cut to 0."""
    if mode == "up":
        return F.when(v > cut, 0).otherwise(255)
    if mode == "keep":
        return F.when((v == 0) | (v == 255), v).when(v <= cut, 0).otherwise(255)
    return F.when(v < cut, 0).otherwise(255)


def invert(v: Column) -> Column:
    """P03."""
    return 255 - v


def colour_predicates(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """Threshold rules for the colours of a board."""
    low, high = F.least(r, g, b), F.greatest(r, g, b)
    return {
        "is_green": (g > r) & (g > b),
        "is_light": (r > 150) & (g > 150) & (b > 150),
        "is_copper": (r > g) & (g > b) & (r > 100),
        "is_near_white": (low > 200) & (high - low < 30),
        "is_near_gray": high - low < 25,
        "is_almost_white": low > 230,
    }


def replace_with_white(df: DataFrame, predicate: Column, rest: Column | None = None) -> DataFrame:
    """Cells that meet the predicate turn white; the rest stay, or take the given value."""
    return df.select(*KEY, *[F.when(predicate, 255).otherwise(F.col(c) if rest is None else rest).alias(c) for c in "rgb"])


def near_colours(a: tuple[Column, ...], b: tuple[Column, ...], tolerance: int) -> Column:
    """P06."""
    out = F.lit(True)
    for p, q in zip(a, b, strict=True):
        out = out & (F.abs(p - q) <= tolerance)
    return out


def border_fill(df: DataFrame, border: int, fill: int = 255) -> DataFrame:
    """A frame of ``border`` cells around each grid takes one value. The extent comes from one small
    aggregate, not from a window over all cells."""
    size = df.groupBy("grid_id").agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"))
    edge = (F.col("x") < border) | (F.col("y") < border) | (F.col("x") >= F.col("_w") - border) | (F.col("y") >= F.col("_h") - border)
    return df.join(size, "grid_id").select(*KEY, F.when(edge, fill).otherwise(F.col("v")).alias("v"))


def blend(a: Column, b: Column, how: str) -> Column:
    """Two values into one, held to 0..255."""
    out = {
        "min": lambda: F.least(a, b), "max": lambda: F.greatest(a, b), "add": lambda: a + b, "subtract": lambda: a - b,
        "difference": lambda: F.abs(a - b), "multiply": lambda: F.floor(a * b / 255), "average": lambda: F.floor((a + b) / 2),
        "screen": lambda: 255 - F.floor((255 - a) * (255 - b) / 255),
        "overlay": lambda: F.floor((a * (255 - F.floor((255 - a) * (255 - b) / 255)) + (255 - a) * F.floor(a * b / 255)) / 255),
    }[how]()
    return F.greatest(F.lit(0), F.least(F.lit(255), out)).cast("int")


BLENDS = ("min", "max", "add", "subtract", "difference", "multiply", "average", "screen", "overlay")


def combine(a: Column, b: Column, how: str) -> Column:
    """Logic and means of two grids; dark is "true", so binary AND is the greater value."""
    return {
        "binary_and": lambda: F.greatest(a, b), "binary_or": lambda: F.least(a, b), "gray_and": lambda: F.least(a, b), "gray_or": lambda: F.greatest(a, b),
        "average": lambda: F.floor((a + b) / 2).cast("int"), "average_skip_white": lambda: F.when(a >= 248, a).otherwise(F.floor((a + b) / 2).cast("int")),
    }[how]()


COMBINES = ("binary_and", "binary_or", "gray_and", "gray_or", "average", "average_skip_white")


def pair_up(cells: DataFrame, other: DataFrame) -> DataFrame:
    """Two grids at the same place: v and w; the common extent only."""
    return cells.join(other.select(*KEY, F.col("v").alias("w")), KEY)


def pad_cells(df: DataFrame, kx: int, ky: int, fill: int = 255) -> DataFrame:
    """A frame of kx/2 and ky/2 cells, the content shifted into it. Only frame cells are generated."""
    px, py = kx // 2, ky // 2
    moved = df.select("grid_id", (F.col("x") + px).alias("x"), (F.col("y") + py).alias("y"), "v")
    size = df.groupBy("grid_id").agg((F.max("x") + 1 + 2 * px).alias("w"), (F.max("y") + 1 + 2 * py).alias("h"))
    frame = size.select("grid_id", "w", "h", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y")).select("grid_id", "w", "h", "y", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"))
    inside = (F.col("x") >= px) & (F.col("x") < F.col("w") - px) & (F.col("y") >= py) & (F.col("y") < F.col("h") - py)
    return moved.unionByName(frame.where(~inside).select("grid_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.lit(fill).alias("v")))


def downsample(df: DataFrame) -> DataFrame:
    """Half the size by means of 2 by 2 cells."""
    half = lambda c: F.floor(F.col(c) / 2).cast("int").alias(c)
    return df.groupBy("grid_id", half("x"), half("y")).agg(F.floor(F.avg("v")).cast("int").alias("v"))


def rotate_cells(df: DataFrame, degrees: float, fill: int = 255) -> DataFrame:
    """Grids turned about their centres into canvases that hold them, nearest cell, blank where none."""
    size = df.groupBy("grid_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    s, c = F.sin(F.radians(F.lit(degrees))), F.cos(F.radians(F.lit(degrees)))
    nw = F.ceil(F.abs(F.col("w") * c) + F.abs(F.col("h") * s) - 1e-9).cast("int")
    nh = F.ceil(F.abs(F.col("w") * s) + F.abs(F.col("h") * c) - 1e-9).cast("int")
    target = size.withColumn("nw", nw).withColumn("nh", nh)
    target = target.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("nh") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("nw") - 1)))
    dx, dy = F.col("x") + 0.5 - F.col("nw") / 2, F.col("y") + 0.5 - F.col("nh") / 2
    target = target.withColumn("sx", F.floor(dx * c + dy * s + F.col("w") / 2 + 1e-9).cast("int")).withColumn("sy", F.floor(-dx * s + dy * c + F.col("h") / 2 + 1e-9).cast("int"))
    source = df.select("grid_id", F.col("x").alias("sx"), F.col("y").alias("sy"), "v")
    return target.join(source, ["grid_id", "sx", "sy"], "left").select(*KEY, F.coalesce("v", F.lit(fill)).alias("v"))
