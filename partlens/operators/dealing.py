"""How rows are dealt out to tasks that sort or group them by key.

Adaptive execution makes one partition a core of what a shuffle wrote, up to 64 MB as compressed, which is gigabytes of
repetitive rows once a task sorts them. A partitioning by number is left as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Number of partitions: the most that map tasks write to directly. For more they hold and sort what they write.
PIECES = 200


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by key, in ``PIECES`` partitions. What follows by these keys, or by these and others, needs no further exchange."""
    return df.repartition(PIECES, *keys)
