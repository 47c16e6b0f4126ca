"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as
Parquet in the shared folder and reads them back for the next one.

All stages take null and empty texts, null ids, repeated rows, ids that several texts share and columns of any further
names; an empty table gives no rows. What becomes of such rows stands at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from partlens.llm import linededup, mixing, neardup, packing, quality
from partlens.llm.common import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go; null and empty texts are too short and go, repeated rows are judged each."""
    return quality.cascade(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that occurred before leave their texts. No row goes: a null text stays null, a text of nothing but
    repeats becomes empty, rows equal in id and text share their fate."""
    return linededup.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id (null last); of repeated rows one, and all
    null and empty texts are one group."""
    return neardup.drop_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken, up to three times each, until the mix has as many words as came in. Null and empty texts
    cost nothing and are taken once; repeated rows are documents of their own."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 4096 tokens; a null or empty text is its end token."""
    return packing.op6_packing(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("packing", packed),
]

#: Near-duplicate search and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
