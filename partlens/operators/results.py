"""Results of inspections: verdicts, texts, rates and rolling views; detections of codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partlens.functions.times import interval_micros, time_bucket


def point_result(processed: Column, details: Column) -> Column:
    """NO where nothing was processed, YES without details, else CHECK MANUALLY."""
    return F.when(~processed, "NO").when(F.size(details) == 0, "YES").otherwise("CHECK MANUALLY")


def severity(ok: Column, unsure: Column) -> Column:
    """0 not evaluated, 1 OK, 2 unsure, 3 not OK."""
    return F.when(ok.isNull(), 0).when(~ok, 3).when(F.coalesce(unsure, F.lit(False)), 2).otherwise(1)


def part_result(df: DataFrame) -> DataFrame:
    """The worst point decides on a part's run."""
    return df.groupBy("part_id", "run_ts").agg(F.max(severity(F.col("ok"), F.col("unsure"))).alias("result"))


WORDS = ("Not evaluated", "OK", "Unsure", "Not OK")


def result_text(df: DataFrame) -> DataFrame:
    """Numbered lines of a run's points, and the result in words. A run's points meet in one row, as its text does."""
    s = severity(F.col("ok"), F.col("unsure"))
    word = lambda c: F.element_at(F.array(*[F.lit(w) for w in WORDS]), c + 1)
    g = df.groupBy("part_id", "run_ts").agg(F.max(s).alias("result"), F.sort_array(F.collect_list(F.struct("point_id", "row_id", s.alias("s")))).alias("d"))
    lines = F.transform("d", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". Point "), x["point_id"].cast("string"), F.lit(": "), word(x["s"])))
    return g.select("part_id", "run_ts", word(F.col("result")).alias("verdict"), F.array_join(lines, "\n").alias("details"))


def pass_rate(df: DataFrame) -> DataFrame:
    """Inspected, passed and their share, by part and point with subtotals."""
    g = df.rollup("part_id", "point_id").agg(F.count("*").alias("inspected"), F.sum(F.col("ok").cast("long")).alias("passed"))
    return g.withColumn("rate", F.round(F.col("passed") / F.col("inspected"), 9))


def merge_detections(df: DataFrame, spurious: tuple[str, ...] = ("DataMatrix",)) -> DataFrame:
    """A scan's codes in the order of its variants, without null, empty and spurious ones, each appended
    unless the text so far already contains it."""
    good = df.where(F.col("code").isNotNull() & (F.col("code") != "") & ~F.col("code").isin(*spurious))
    g = good.groupBy("scan_id").agg(F.sort_array(F.collect_list(F.struct("variant", "code"))).alias("c"))
    text = F.aggregate("c", F.lit(""), lambda s, x: F.when(F.contains(s, x["code"]), s).when(s == "", x["code"]).otherwise(F.concat(s, F.lit(" "), x["code"])))
    return df.select("scan_id").distinct().join(g, "scan_id", "left").select("scan_id", F.coalesce(text, F.lit("")).alias("text"))


def last_outcomes(df: DataFrame, n: int = 60) -> DataFrame:
    """The last n outcomes of each point, oldest first."""
    w = Window.partitionBy("point_id").orderBy(F.desc("run_ts"), F.desc("part_id"), F.desc("row_id"))
    last = df.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)
    return last.withColumn("nth", F.row_number().over(Window.partitionBy("point_id").orderBy(F.desc("back")))).select("point_id", "nth", "part_id", "run_ts", "ok")


def running_rate(df: DataFrame) -> DataFrame:
    """Each part's share of passed points after each outcome."""
    w = Window.partitionBy("part_id").orderBy("run_ts", "point_id", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    return df.select("part_id", "row_id", F.round(F.avg(F.col("ok").cast("double")).over(w), 9).alias("rate"))


def sequence_number(df: DataFrame, bucket: str = "day") -> DataFrame:
    """Number of each event of its camera in time. Events are numbered in buckets of time, and each bucket goes on
    from the counts of those before it, so a camera's events meet in no single task."""
    at = df.withColumn("_bucket", F.date_trunc(bucket, "ts"))
    counts = at.groupBy("camera_id", "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("camera_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("camera_id", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("camera_id", "_bucket").orderBy("ts", "event_id"))
    numbered = at.withColumn("_nth", nth).join(counts, ["camera_id", "_bucket"])
    return numbered.withColumn("nth", (F.col("_nth") + F.col("_before")).cast("int")).select(*df.columns, "nth")


def variant_fan_out(df: DataFrame, variants: tuple[float, ...]) -> DataFrame:
    """Every row under each parameter of a short list, in one pass."""
    return df.withColumn("factor", F.explode(F.array(*[F.lit(v) for v in variants])))


def match_replies(events: DataFrame, timeout: str = "10 minutes") -> DataFrame:
    """The first response of a camera to each request within the timeout; none is an empty result.

    Time is cut into buckets as long as the timeout, so a request's reply lies in its bucket or in the next. One window
    over both kinds, latest first, hands the nearest response down; no join, and a camera's work is spread over time.
    """
    micros = interval_micros(timeout)
    bucket = time_bucket("ts", micros)
    mine = F.when(F.col("kind") == "response", F.array(bucket, bucket - 1)).otherwise(F.array(bucket))
    both = events.where(F.col("kind").isin("request", "response")).withColumn("bucket", F.explode(mine))
    is_reply = F.col("kind") == "response"
    w = Window.partitionBy("camera_id", "bucket").orderBy(F.desc("ts"), is_reply.cast("int").desc(), F.desc("event_id"))
    reply = F.last(F.when(is_reply, F.struct("ts", "event_id", "value")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("r", reply).where("kind = 'request'")
    ok = F.col("r.ts") <= F.col("ts") + F.expr(f"INTERVAL {timeout}")
    return out.select("camera_id", "event_id", "ts", F.when(ok, F.col("r.event_id")).alias("reply_id"), F.when(ok, F.col("r.value")).alias("value"), F.coalesce(ok, F.lit(False)).alias("answered"))


def detection_pipeline(df: DataFrame) -> DataFrame:
    """Cleaned codes of all variants of a scan, merged, with a good or bad flag."""
    merged = merge_detections(df)
    return merged.withColumn("verdict", F.when(F.col("text") != "", "good").otherwise("bad"))
