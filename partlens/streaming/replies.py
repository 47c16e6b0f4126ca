"""Replies that count. A reply belongs to its camera's latest request at or before it; of those, a request's first one
within the timeout counts. A request that a later one supersedes, or that no reply reaches in time, is an empty result."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from partlens.functions.times import interval_micros, time_bucket

RESULTS = "camera_id long, request_id long, request_ts timestamp, reply_id long, reply_ts timestamp"


def latest_request_replies(requests: DataFrame, responses: DataFrame, timeout: str = "30 seconds") -> DataFrame:
    """Batch form: an as-of join of replies with requests, latest request first.

    Time is cut into buckets as long as the timeout. A request stands in its own bucket and in the next one, so a bucket
    holds every request that its replies may belong to, and one running window a bucket finds the latest. Of requests at one
    moment the largest id is the latest; a reply at a request's moment comes after it."""
    micros = interval_micros(timeout)
    own = time_bucket("ts", micros)
    q = requests.where("ts IS NOT NULL AND camera_id IS NOT NULL").select("camera_id", "ts", F.struct("ts", "event_id").alias("request"), F.lit(None).cast("long").alias("reply_id"), F.explode(F.array(own, own + 1)).alias("bucket"))
    r = responses.where("ts IS NOT NULL AND camera_id IS NOT NULL").select("camera_id", "ts", F.lit(None).cast(q.schema["request"].dataType).alias("request"), F.col("event_id").alias("reply_id"), own.alias("bucket"))
    order = Window.partitionBy("camera_id", "bucket").orderBy("ts", F.col("request").isNull(), "request.event_id").rowsBetween(Window.unboundedPreceding, 0)
    met = q.unionByName(r).withColumn("latest", F.last("request", ignorenulls=True).over(order)).where("reply_id IS NOT NULL AND latest IS NOT NULL")
    met = met.where(F.col("ts") <= F.col("latest.ts") + F.expr(f"INTERVAL {timeout}"))
    first = met.groupBy("camera_id", F.col("latest.event_id").alias("request_id"), F.col("latest.ts").alias("request_ts")).agg(F.min(F.struct("ts", "reply_id")).alias("f"))
    asked = requests.select("camera_id", F.col("event_id").alias("request_id"), F.col("ts").alias("request_ts"))
    return asked.join(first, ["camera_id", "request_id", "request_ts"], "left").select("camera_id", "request_id", "request_ts", F.col("f.reply_id").alias("reply_id"), F.col("f.ts").alias("reply_ts"))


class LatestRequest(StatefulProcessor):
    """Events wait until the watermark has passed them and are then taken in order, so late ones take their place. State is
    the events within the watermark's delay and the open request."""

    def __init__(self, timeout: int):
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "ts array<long>, id array<long>, reply array<boolean>, open_ts long, open_id long")

    def _step(self, key: tuple, fresh: list[tuple[int, bool, int]], now: int) -> Iterator[pd.DataFrame]:
        got = self.state.get() if self.state.exists() else None
        waiting = sorted([*(zip(got[0], got[2], got[1], strict=True) if got else []), *fresh])
        asked = (got[3], got[4]) if got and got[4] is not None else None
        out: list[tuple] = []

        def close(reply: tuple[int, int] | None) -> None:
            out.append((key[0], asked[1], asked[0], *(reply or (None, None))))

        settled = [e for e in waiting if -(-e[0] // 1000) <= now]
        for ts, is_reply, event in settled:
            if asked and (not is_reply or ts > asked[0] + self.timeout):
                close(None)
                asked = None
            if not is_reply:
                asked = (ts, event)
            elif asked:
                close((event, ts))
                asked = None
        over = lambda a: (a[0] + self.timeout) // 1000 + 1  # noqa: E731 (the millisecond after the last moment that counts)
        if asked and over(asked) <= now:
            close(None)
            asked = None
        waiting = waiting[len(settled) :]
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        due = ([-(-waiting[0][0] // 1000)] if waiting else []) + ([over(asked)] if asked else [])
        if due:
            self.state.update(([e[0] for e in waiting], [e[2] for e in waiting], [e[1] for e in waiting], *(asked or (None, None))))
            self.handle.registerTimer(min(due))
        elif self.state.exists():
            self.state.clear()
        if out:
            df = pd.DataFrame(out, columns=["camera_id", "request_id", "asked", "reply_id", "replied"])
            yield df.astype({"reply_id": "Int64", "replied": "Int64"})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fresh: list[tuple[int, bool, int]] = []
        for b in rows:
            fresh += zip(b["micros"].tolist(), (b["kind"] == "response").tolist(), b["event_id"].tolist(), strict=True)
        yield from self._step(key, fresh, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._step(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def live_replies(events: DataFrame, timeout: str = "30 seconds") -> DataFrame:
    """Live form, append mode: the rows of ``latest_request_replies`` as soon as they are certain. ``events`` hold requests and
    responses and carry a watermark; the session must keep state in RocksDB."""
    given = events.where("kind IN ('request', 'response') AND camera_id IS NOT NULL AND ts IS NOT NULL").select("camera_id", "ts", F.unix_micros("ts").alias("micros"), "event_id", "kind")
    numbers = "camera_id long, request_id long, asked long, reply_id long, replied long"
    out = given.groupBy("camera_id").transformWithStateInPandas(LatestRequest(interval_micros(timeout)), numbers, "Append", "EventTime")
    return out.select("camera_id", "request_id", F.timestamp_micros("asked").alias("request_ts"), "reply_id", F.timestamp_micros("replied").alias("reply_ts"))
