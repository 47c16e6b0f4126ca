"""Live views of capture events and inspections. Every function takes a stream or a batch alike; a stream needs
the watermark that ``watermarked`` sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from partlens.functions.times import interval_micros, time_bucket
from partlens.operators.components import written


def watermarked(events: DataFrame, delay: str = "30 seconds", ts: str = "ts") -> DataFrame:
    return events.withWatermark(ts, delay)


def sampled_frames(events: DataFrame, every: str = "10 seconds") -> DataFrame:
    """The first event of each camera in each window."""
    first = F.min_by(F.struct("event_id", "value"), F.struct("ts", "event_id"))
    out = events.groupBy(F.window("ts", every).alias("w"), "camera_id").agg(first.alias("f"))
    return out.select("camera_id", F.col("w.start").alias("start"), F.col("f.event_id").alias("event_id"), F.col("f.value").alias("value"))


def capture_timeout_join(requests: DataFrame, responses: DataFrame, timeout: str = "30 seconds") -> DataFrame:
    """Requests with every response of their camera within the timeout; one without any is an empty result. As a
    stream both sides carry watermarks, and an empty result comes out once no response can come.

    A request meets the responses of its own bucket of time, as long as the timeout, and of the next one."""
    micros = interval_micros(timeout)
    q = requests.select(F.col("camera_id").alias("q_camera"), F.col("event_id").alias("request_id"), F.col("ts").alias("request_ts"), time_bucket("ts", micros).alias("q_bucket"))
    own = time_bucket("ts", micros)
    r = responses.select(F.col("camera_id").alias("r_camera"), F.col("event_id").alias("reply_id"), F.col("ts").alias("reply_ts"), F.explode(F.array(own, own - 1)).alias("r_bucket"))
    within = F.expr(f"q_camera = r_camera AND q_bucket = r_bucket AND reply_ts >= request_ts AND reply_ts <= request_ts + INTERVAL {timeout}")
    return q.join(r, within, "left_outer").select(F.col("q_camera").alias("camera_id"), "request_id", "request_ts", "reply_id", "reply_ts")


def camera_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Connected spells of each camera: start, end (a gap after the last event), n. As a batch, see ``spells``."""
    if not events.isStreaming:
        return spells(events, gap).select("camera_id", "start", (F.col("last") + F.expr(f"INTERVAL {gap}")).alias("end"), "n")
    out = events.groupBy(F.session_window("ts", gap).alias("w"), "camera_id").agg(F.count("*").alias("n"))
    return out.select("camera_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


#: First buckets are so many gaps long; each round joins so many of them.
GAPS_A_BUCKET, BUCKETS_A_ROUND = 16, 64


def _joined(parts: DataFrame, micros: int) -> DataFrame:
    """Parts (camera_id, bucket, start, last, n) of a bucket that are less than a gap apart as one; outer marks the first and
    the last one of a bucket."""
    w = Window.partitionBy("camera_id", "bucket").orderBy("start")
    fresh = F.coalesce(F.col("start") >= F.lag("last").over(w) + F.expr(f"INTERVAL {micros} MICROSECONDS"), F.lit(True))
    k = F.sum(F.when(F.col("_fresh"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = parts.withColumn("_fresh", fresh).withColumn("_k", k).groupBy("camera_id", "bucket", "_k").agg(F.min("start").alias("start"), F.max("last").alias("last"), F.sum("n").alias("n"))
    return out.withColumn("outer", (F.col("_k") == 1) | (F.col("_k") == F.max("_k").over(Window.partitionBy("camera_id", "bucket")))).drop("_k")


def spells(events: DataFrame, gap: str) -> DataFrame:
    """camera_id, start, last, n of spells of events that follow each other by less than the gap.

    Time is cut into buckets, and a camera's events in one bucket are one group, so no task holds a camera. Only the first and
    the last spell of a bucket may go on beyond it; those are carried to the next round, where ``BUCKETS_A_ROUND`` buckets are
    one, until one bucket holds all. Events without a time have no part."""
    micros = interval_micros(gap)
    moment = events.where("ts IS NOT NULL").select("camera_id", time_bucket("ts", micros * GAPS_A_BUCKET).alias("bucket"), F.col("ts").alias("start"), F.col("ts").alias("last"))
    parts = moment.groupBy("camera_id", "bucket", "start", "last").agg(F.count("*").alias("n"))
    done: list[DataFrame] = []
    while True:
        parts = written(_joined(parts, micros), "spells")
        low, high = parts.agg(F.min("bucket"), F.max("bucket")).first()
        if low == high:
            break
        done.append(parts.where("NOT outer"))
        parts = parts.where("outer").withColumn("bucket", F.floor((F.col("bucket") - low) / BUCKETS_A_ROUND)).drop("outer")
    for d in done:
        parts = parts.unionByName(d)
    return parts.select("camera_id", "start", "last", "n")


def camera_liveness(events: DataFrame, silence: str = "20 minutes") -> DataFrame:
    """ON from the first event of a spell to ``silence`` after its last, then OFF; a batch, or a stream that reports a spell
    when it has ended. ``liveness.live_changes`` is the form that shows cameras while they are ON."""
    s = camera_sessions(events, silence)
    change = F.array(F.struct(F.col("start").alias("at"), F.lit("ON").alias("state")), F.struct(F.col("end").alias("at"), F.lit("OFF").alias("state")))
    return s.select("camera_id", F.explode(change).alias("c")).select("camera_id", "c.at", "c.state")


def liveness_by_gaps(events: DataFrame, silence: str = "20 minutes") -> DataFrame:
    """Batch twin of X03, from the gaps beside each event: its neighbours in time are those of its bucket, as long as the
    silence, and of the buckets beside it, so no task holds a camera."""
    limit, micros = F.expr(f"INTERVAL {silence}"), interval_micros(silence)
    at = events.where("ts IS NOT NULL").select("camera_id", "ts").distinct().withColumn("_own", time_bucket("ts", micros))
    near = at.withColumn("_b", F.explode(F.array(F.col("_own") - 1, F.col("_own"), F.col("_own") + 1)))
    w = Window.partitionBy("camera_id", "_b").orderBy("ts")
    got = near.withColumn("before", F.lag("ts").over(w)).withColumn("after", F.lead("ts").over(w)).where("_b = _own")
    on = got.where(F.col("before").isNull() | (F.col("ts") >= F.col("before") + limit)).select("camera_id", F.col("ts").alias("at"), F.lit("ON").alias("state"))
    off = got.where(F.col("after").isNull() | (F.col("after") >= F.col("ts") + limit)).select("camera_id", (F.col("ts") + limit).alias("at"), F.lit("OFF").alias("state"))
    return on.unionByName(off)


def live_pass_rate(inspections: DataFrame) -> DataFrame:
    """Totals so far; as a stream in complete or update mode."""
    g = inspections.groupBy("point_id").agg(F.count("*").alias("inspected"), F.count_if("ok").alias("passed"))
    return g.withColumn("rate", F.round(F.col("passed") / F.col("inspected"), 9))


STRIP = "point_id long, seen long, parts array<long>, oks array<boolean>"
_STRIP_STATE = "seen long, ts array<long>, parts array<long>, rows array<long>, oks array<boolean>"


def live_strip(inspections: DataFrame, n: int = 60) -> DataFrame:
    """X05's strip of a stream, in update mode: the last n outcomes of each point that changed, oldest first, and how many
    it has had. State is n outcomes a point, however many came; late ones take their place if they belong to the last n."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, *held = state.get if state.exists else (0, [], [], [], [])
        rows = list(zip(*held, strict=True))
        for batch in batches:
            seen += len(batch)
            micros = batch["run_ts"].astype("datetime64[us]").astype("int64")
            rows += list(zip(micros.tolist(), batch["part_id"].tolist(), batch["row_id"].tolist(), batch["ok"].tolist(), strict=True))
            rows = sorted(rows)[-n:]
        ts, parts, ids, oks = ([r[i] for r in rows] for i in range(4))
        state.update((seen, ts, parts, ids, oks))
        yield pd.DataFrame({"point_id": [key[0]], "seen": [seen], "parts": [parts], "oks": [oks]})

    given = inspections.select("point_id", "run_ts", "part_id", "row_id", "ok")
    return given.groupBy("point_id").applyInPandasWithState(update, STRIP, _STRIP_STATE, "update", GroupStateTimeout.NoTimeout)


def first_reply_wins(replies: DataFrame) -> DataFrame:
    """One reply a request; as a stream the first to arrive within the watermark."""
    if replies.isStreaming:
        return replies.dropDuplicatesWithinWatermark(["request_id"])
    w = Window.partitionBy("request_id").orderBy("reply_ts", "reply_id")
    return replies.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def archive_stream(frames: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch goes to ``write`` with its number; the checkpoint makes restarts go on where it ended."""
    return frames.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
