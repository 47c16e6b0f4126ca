"""Buckets of time, by which events that are near each other meet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}


def interval_micros(interval: str) -> int:
    """Microseconds of an interval such as ``10 minutes``."""
    n, unit = interval.split()
    return int(n) * SECONDS[unit.rstrip("s")] * 1_000_000


def time_bucket(ts: str, micros: int) -> Column:
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / micros)
