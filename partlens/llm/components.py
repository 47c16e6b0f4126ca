"""Connected components on Spark tables, for links found in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _mark(edges: DataFrame) -> tuple:
    """Tells one set of edges from another: one pass, one row."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, comp for every node of ``edges`` (a, b): comp is the smallest node it is connected to.

    Alternates large-star and small-star steps until no edge changes; each step is one grouping, and a
    step's edges are written to the shared folder. Links and labels never reach the driver.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    mark = _mark(edges)
    while True:
        # large star: neighbours above a node link to its smallest neighbour
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: neighbours below a node, and the node, link to its smallest neighbour
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        after = materialize(small.where("a <> b").distinct(), "cc")
        now = _mark(after)
        edges, done = after, now == mark
        mark = now
        if done:
            break
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp")).unionByName(roots).groupBy("node").agg(F.min("comp").alias("comp"))
