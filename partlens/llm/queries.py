"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bytenet, chat, linededup, merkle, mixing, neardup, packing, pii, quality, secrets, topk, toxicity, whitening
from .common import table


def _on(name: str, f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(table(spark, sf_dir, name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": _on("documents", linededup.op1_line_dedup),
    "op2_mixing": _on("documents", mixing.op2_mixing),
    "op3_pii": _on("documents", pii.op3_pii),
    "op4_near_dedup": _on("documents", neardup.op4_near_dedup),
    "op5_exact_top_k": _on("embeddings", topk.op5_top_k),
    "op6_packing": _on("documents", packing.op6_packing),
    "op7_secret_scan": _on("documents", secrets.op7_secrets),
    "op8_chat_formatting": lambda spark, sf_dir: chat.op8_chat(spark, table(spark, sf_dir, "conversations")),
    "op9_quality_rules": _on("documents", quality.op9_quality),
    "op10_toxicity": lambda spark, sf_dir: toxicity.op10_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op11_whitening": _on("embeddings", whitening.op11_whitening),
    "op12_quality_classifier": lambda spark, sf_dir: bytenet.op12_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op13_merkle_manifest": _on("documents", merkle.op13_merkle),
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": linededup.OP1_SQL,
    "op2_mixing": mixing.OP2_SQL,
    "op5_exact_top_k": topk.OP5_SQL,
    "op8_chat_formatting": chat.OP8_SQL,
    "op9_quality_rules": quality.OP9_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
