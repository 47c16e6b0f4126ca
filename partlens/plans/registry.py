"""Registered queries: an operator applied to its whole table, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from partlens.fixtures import TABLES, build, ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, tables: str, run: Callable[..., DataFrame], sql: str | None = None) -> None:
    """``run`` gets the tables named in ``tables`` (blank-separated) in that order. ``sql`` starts after
    the WITH list of those fixtures; more CTEs may come first, each written as ``, name AS (...)``."""
    needed = tables.split()
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    QUERIES[name] = lambda spark, sf_dir: run(*[build(spark, sf_dir, t) for t in needed])
    if sql is not None:
        ORACLES[name] = (ctes(*needed) + "\n" + sql.strip()) if any(t in TABLES for t in needed) else sql.strip()
