"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partlens.operators.components import shared_root

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage at a table that survives lost executors. What the write shuffled is of no use
    after it, so its files go at once.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def plain(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns only, so that extra columns of the input cannot clash."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def text_of(name: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Identifies a document by its id and its content.

    Rows equal in both are one document; rows that share an id but not a text are told apart.
    """
    return [doc_id.alias("doc_id"), F.md5(text.cast("binary")).alias("content")]


def small_batches(df: DataFrame, most_bytes: int = 8 << 20) -> DataFrame:
    """Arrow batches of the session hold ``most_bytes`` at most (or one row), as whole texts may be long and
    a Python worker holds several copies of a batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(key, "64m").lower().rstrip("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now[-1:], 1)
    if int(now.rstrip("kmg") or 0) * unit not in range(1, most_bytes + 1):
        df.sparkSession.conf.set(key, f"{most_bytes}b")
    return df
