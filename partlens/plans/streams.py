"""Queries on sources and on live views, in their batch form; tests hold the streams against them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from partlens.fixtures import ctes
from partlens.operators import regions as G
from partlens.operators.components import shared_root
from partlens.sources import files as S
from partlens.streaming import liveness as L
from partlens.streaming import replies as RP
from partlens.streaming import views as V

from .regions import PARSED
from .registry import ORACLES, QUERIES, register

register(
    "s05_pixels_from_array", "embeddings", lambda d: S.pixels_from_array(d, "vec_id", "embedding", 8).select("grid_id", "x", "y", F.round(F.col("v").cast("double"), 6).alias("v")),
    "SELECT vec_id AS grid_id, (p % 8)::INT AS x, (p // 8)::INT AS y, round(f::DOUBLE, 6) AS v FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS p, unnest(embedding) AS f FROM embeddings) q",
)
register(
    "s07_save_properties", "settings", lambda d: S.settings_lines(G.parse_settings(d)),
    PARSED + " SELECT line_no, key || '=' || value AS text FROM kept",
)
QUERIES["s01_list_files"] = lambda spark, sf_dir: S.list_files(spark, sf_dir, r"^.+\.parquet$").select("path", "length")

register(
    "x01_sampled_frames", "capture_events", lambda d: V.sampled_frames(d, "1 hour"),
    """SELECT camera_id, date_trunc('hour', ts) AS start, arg_min(event_id, epoch_us(ts) * 1000000::HUGEINT + event_id) AS event_id, arg_min(value, epoch_us(ts) * 1000000::HUGEINT + event_id) AS value
    FROM capture_events GROUP BY camera_id, date_trunc('hour', ts)""",
)


def _shared(spark: SparkSession, name: str) -> str:
    """A new folder among those that all executors share."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def _kind(d: DataFrame, kind: str) -> DataFrame:
    return d.where(F.col("kind") == kind)


JOINED = """, j AS (SELECT q.camera_id, q.event_id AS request_id, q.ts AS request_ts, r.event_id AS reply_id, r.ts AS reply_ts FROM capture_events q
LEFT JOIN capture_events r ON r.kind = 'response' AND r.camera_id = q.camera_id AND r.ts >= q.ts AND r.ts <= q.ts + INTERVAL 10 MINUTE WHERE q.kind = 'request')"""
register("x02_capture_timeout_join", "capture_events", lambda d: V.capture_timeout_join(_kind(d, "request"), _kind(d, "response"), "10 minutes"), JOINED + " SELECT * FROM j")
register(
    "x08_first_reply_wins", "capture_events", lambda d: V.first_reply_wins(V.capture_timeout_join(_kind(d, "request"), _kind(d, "response"), "10 minutes")),
    JOINED + " SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY reply_ts, reply_id) = 1",
)
register(
    "x08_latest_request", "capture_events", lambda d: RP.latest_request_replies(_kind(d, "request"), _kind(d, "response"), "10 minutes"),
    """, q AS (SELECT camera_id, ts, max(event_id) AS id FROM capture_events WHERE kind = 'request' GROUP BY ALL),
    m AS (SELECT q.camera_id, q.id, arg_min(r.event_id, (r.ts, r.event_id)) AS reply_id, min(r.ts) AS reply_ts
      FROM (SELECT * FROM capture_events WHERE kind = 'response') r ASOF JOIN q ON q.camera_id = r.camera_id AND q.ts <= r.ts WHERE r.ts <= q.ts + INTERVAL 10 MINUTE GROUP BY ALL)
    SELECT e.camera_id, e.event_id AS request_id, e.ts AS request_ts, m.reply_id, m.reply_ts FROM capture_events e LEFT JOIN m ON m.camera_id = e.camera_id AND m.id = e.event_id WHERE e.kind = 'request'""",
)
SPELLS = """, g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY camera_id ORDER BY ts, event_id) + INTERVAL {gap} MINUTE THEN 0 ELSE 1 END AS s FROM capture_events),
h AS (SELECT *, sum(s) OVER (PARTITION BY camera_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g),
spell AS (SELECT camera_id, min(ts) AS a, max(ts) + INTERVAL {gap} MINUTE AS b, count(*) AS n FROM h GROUP BY camera_id, k)"""
for _from, _more in (("capture_events", ""), ("fleet_events", "_fleet")):
    _spells = SPELLS.replace("capture_events", _from)
    register("x04_camera_sessions" + _more, _from, V.camera_sessions, _spells.format(gap=30) + ' SELECT camera_id, a AS start, b AS "end", n FROM spell')
    for _name, _run in (("x03_camera_liveness", V.camera_liveness), ("x03_camera_liveness_by_gaps", V.liveness_by_gaps)):
        register(_name + _more, _from, _run, _spells.format(gap=20) + " SELECT camera_id, a AS at, 'ON' AS state FROM spell UNION ALL SELECT camera_id, b, 'OFF' FROM spell")


def _with_settings(spark: SparkSession, settings: dict[str, str], run: Callable[[], None]) -> None:
    """Runs streams with settings of their own, and leaves the session's as they were."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        run()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _with_rocks(spark: SparkSession, run: Callable[[], None]) -> None:
    """Runs a stream whose state is kept in RocksDB."""
    _with_settings(spark, {"spark.sql.streaming.stateStore.providerClass": L.PROVIDER}, run)


def _live_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of events as a stream of capture events."""
    given = f"{sf_dir}/events.parquet"
    live = spark.readStream.schema(spark.read.parquet(given).schema).parquet(given + "*")
    kind = F.when(F.col("event_type") == "view", "request").when(F.col("event_type") == "click", "response").when(F.col("event_type") == "error", "fail").otherwise("beat")
    return V.watermarked(live.select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 4 + 1).alias("camera_id"), kind.alias("kind")))


def _streamed_rows(view: Callable[[DataFrame], DataFrame], name: str, schema: str) -> Callable[[SparkSession, str], DataFrame]:
    """A live view run over the table of events to its end, and what it brought out."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path, state = _shared(spark, name), _shared(spark, f"{name}-state")
        out = view(_live_events(spark, sf_dir)).writeStream.format("parquet").option("path", path).option("checkpointLocation", state).outputMode("append")
        _with_rocks(spark, lambda: out.trigger(availableNow=True).start().awaitTermination())
        got = spark.read.schema(schema).parquet(path)
        # the table's times have no zone, and so have these
        return got.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f.name) for f in got.schema])

    return run


#: what the watermark has reached when the table ends: the last event less 30 seconds, in whole milliseconds
_REACHED = "(SELECT epoch_ms(max(ts)) - 30000 FROM capture_events)"
QUERIES["x03_camera_liveness_live"] = _streamed_rows(lambda d: L.live_changes(d), "liveness", L.CHANGES)
ORACLES["x03_camera_liveness_live"] = ctes("capture_events") + SPELLS.format(gap=20) + f"""
SELECT camera_id, a AS at, 'ON' AS state FROM spell WHERE (epoch_us(a) + 999) // 1000 <= {_REACHED} UNION ALL SELECT camera_id, b, 'OFF' FROM spell WHERE (epoch_us(b) + 999) // 1000 <= {_REACHED}"""
#: only requests and replies move that view's watermark, as its filter comes first
_ASKED = "(SELECT epoch_ms(max(ts)) - 30000 FROM capture_events WHERE kind IN ('request', 'response'))"
QUERIES["x08_latest_request_live"] = _streamed_rows(lambda d: RP.live_replies(d, "10 minutes"), "replies", RP.RESULTS)
ORACLES["x08_latest_request_live"] = ORACLES["x08_latest_request"].replace("WHERE e.kind = 'request'", f"""WHERE e.kind = 'request'
AND least(coalesce(epoch_us(m.reply_ts) + 999, 9e18::BIGINT), coalesce((SELECT min(epoch_us(n.ts)) + 999 FROM capture_events n WHERE n.kind = 'request' AND n.camera_id = e.camera_id AND (n.ts, n.event_id) > (e.ts, e.event_id)), 9e18::BIGINT),
  coalesce((SELECT min(epoch_us(n.ts)) + 999 FROM capture_events n WHERE n.kind = 'response' AND n.camera_id = e.camera_id AND n.ts > e.ts + INTERVAL 10 MINUTE), 9e18::BIGINT), (epoch_us(e.ts) + 600000000) // 1000 * 1000 + 1000) // 1000 <= {_ASKED}""")
register(
    "x05_live_pass_rate", "inspections", V.live_pass_rate,
    "SELECT point_id, count(*) AS inspected, count(*) FILTER (ok) AS passed, round(count(*) FILTER (ok) / count(*), 9) AS rate FROM inspections GROUP BY point_id",
)


def _strip(inspections: DataFrame) -> DataFrame:
    """X05's strip: the inspections as a stream, in four triggers, and each point's newest strip."""
    spark = inspections.sparkSession
    source, path, state = (_shared(spark, n) for n in ("inspections", "strip", "strip-state"))
    inspections.repartition(4).write.parquet(source)
    live = spark.readStream.schema(inspections.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = V.live_strip(live).writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True)
    out.foreachBatch(lambda batch, _: batch.write.mode("append").parquet(path)).start().awaitTermination()
    newest = spark.read.schema(V.STRIP).parquet(path).groupBy("point_id").agg(F.max_by(F.struct("seen", "parts", "oks"), "seen").alias("s"))
    strip = newest.select("point_id", "s.seen", F.posexplode(F.arrays_zip("s.parts", "s.oks")).alias("nth", "c"))
    return strip.select("point_id", "seen", (F.col("nth") + 1).alias("nth"), F.col("c.parts").alias("part_id"), F.col("c.oks").alias("ok"))


register(
    "x05_live_strip", "inspections", _strip,
    """, b AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY run_ts DESC, part_id DESC, row_id DESC) AS back, count(*) OVER (PARTITION BY point_id) AS seen FROM inspections)
    SELECT point_id::BIGINT AS point_id, seen, row_number() OVER (PARTITION BY point_id ORDER BY back DESC)::INT AS nth, part_id, ok FROM b WHERE back <= 60""",
)
register(
    "x06_drop_empty_frames", "documents", lambda d: d.where(~S.is_empty_frame(F.col("text").cast("binary"))).select("doc_id"),
    "SELECT doc_id FROM documents WHERE text IS NOT NULL AND length(text) > 0",
)


def _archived(d: DataFrame) -> DataFrame:
    """Events laid out by camera and read back."""
    path = _shared(d.sparkSession, "archive")
    S.archive(d.select("camera_id", "event_id", "kind", "value"), path, "camera_id")
    return d.sparkSession.read.schema("event_id long, kind string, value double, camera_id long").parquet(path).select("camera_id", "event_id", "kind", "value")


def _saved(d: DataFrame) -> DataFrame:
    """Detections as JSON lines and read back."""
    path = _shared(d.sparkSession, "results")
    S.save_results(d, path)
    return d.sparkSession.read.schema("scan_id long, variant int, code string").json(path)


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of events as a stream whose batches go to an archive, read back."""
    given = f"{sf_dir}/events.parquet"
    live = spark.readStream.schema(spark.read.parquet(given).schema).parquet(given + "*").select("event_id", "user_id", "event_type", "value")
    path, state = _shared(spark, "stream"), _shared(spark, "stream-state")
    V.archive_stream(live, lambda batch, _: batch.write.mode("append").parquet(path), state).awaitTermination()
    return spark.read.schema(live.schema).parquet(path)




def _frames(cells: DataFrame) -> DataFrame:
    """Each grid as a picture file of its camera; every fiftieth is no picture."""
    bad = F.when(F.col("grid_id") % 50 == 49, F.encode(F.lit("no picture"), "UTF-8"))
    name = F.format_string("camera=%d/%d.bmp", F.col("grid_id") % 7, "grid_id")
    return S.encode_bitmaps(cells).select(name.alias("name"), F.coalesce(bad, "content").alias("content"))


def _scanned(cells: DataFrame) -> DataFrame:
    """Grids written as pictures and decoded again."""
    folder = _shared(cells.sparkSession, "pictures")
    S.save_frames(_frames(cells), folder)
    return S.pixels_from_binary(S.image_scan(cells.sparkSession, folder)).select(F.regexp_extract("origin", r"(\d+)\.bmp$", 1).cast("long").alias("grid_id"), "x", "y", "v", "bad")


register(
    "s04_image_scan", "cells", _scanned,
    """SELECT grid_id, x, y, v, false AS bad FROM cells WHERE grid_id % 50 <> 49
    UNION ALL SELECT grid_id, x::INT, y::INT, 0, true FROM (SELECT DISTINCT grid_id FROM cells WHERE grid_id % 50 = 49) b, range(50) AS a(x), range(50) AS c(y)""",
)


def _watch(spark: SparkSession, folder: str, path: str, state: str) -> None:
    """Streams of the frames of each camera in a folder, side by side, 100 files a trigger each, until nothing is new. A
    camera has a checkpoint and a folder of results of its own."""

    def follow(camera: str) -> StreamingQuery:
        live = S.frame_stream(spark, f"{folder}/{camera}", 100).where(~S.is_empty_frame(F.col("content")))
        seen = live.select(F.col("camera_id").cast("long").alias("camera_id"), F.regexp_extract("path", r"(\d+)\.bmp$", 1).cast("long").alias("grid_id"), "length", F.hex(F.expr("substring(content, 55)")).alias("body"))
        return V.archive_stream(seen, lambda batch, _: batch.write.mode("append").parquet(f"{path}/{camera}"), f"{state}/{camera}")

    def run() -> None:
        streams: list[StreamingQuery] = []
        try:
            for camera in S.camera_folders(folder):
                streams.append(follow(camera))
            for stream in streams:
                stream.awaitTermination()
        finally:
            for stream in streams:
                stream.stop()

    _with_settings(spark, S.SMALL_FILES, run)


def _frames_in(cells: DataFrame) -> DataFrame:
    """Pictures of seven cameras that arrive in a folder in two halves; the streams end after the first, and second ones go
    on from their checkpoints, 100 files a trigger. What they saw: camera, grid and the bytes of the cells."""
    spark = cells.sparkSession
    folder, path, state = (_shared(spark, n) for n in ("frames", "frames-seen", "frames-state"))
    for half in (0, 1):
        S.save_frames(_frames(cells.where(F.pmod("grid_id", F.lit(2)) == half)), folder)
        _watch(spark, folder, path, state)
    return spark.read.schema("camera_id long, grid_id long, length long, body string").option("recursiveFileLookup", True).parquet(path)


register(
    "s08_frame_stream", "cells", _frames_in,
    """, r AS (SELECT grid_id, string_agg(repeat(printf('%02X', v), 3), '' ORDER BY y DESC, x) AS body FROM cells GROUP BY grid_id)
    SELECT grid_id % 7 AS camera_id, grid_id, CASE WHEN grid_id % 50 = 49 THEN 10 ELSE 54 + length(body) // 2 END AS length, CASE WHEN grid_id % 50 = 49 THEN '' ELSE body END AS body FROM r""",
)
register("s09_archive_sink", "capture_events", _archived, "SELECT camera_id, event_id, kind, value FROM capture_events")
register("s10_result_sink", "detections", _saved, "SELECT scan_id, variant, code FROM detections")
QUERIES["x07_archive_stream"] = _streamed
ORACLES["x07_archive_stream"] = "SELECT event_id, user_id, event_type, value FROM events"
