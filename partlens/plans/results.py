"""Queries on components, results and detections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlens.operators import components as C
from partlens.operators import grids as G
from partlens.operators import neighbours as N
from partlens.operators import points as P
from partlens.operators import readings as RD
from partlens.operators import regions as G2
from partlens.operators import results as R

from .grids import otsu_sql
from .neighbours import bridges_sql, clear_sql
from .registry import register
from .text import CANDIDATES, _corrected, _verified



def labels_sql(source: str = "cells", name: str = "") -> str:
    """CTEs: runs of dark cells, their links, and their components; all names end in ``name``."""
    n = name
    return f""", dark{n} AS (SELECT grid_id, x, y FROM {source} WHERE v < 128),
run0{n} AS (SELECT *, x - row_number() OVER (PARTITION BY grid_id, y ORDER BY x) AS i FROM dark{n}),
runs{n} AS (SELECT grid_id, y, min(x) AS x0, max(x) AS x1, y::BIGINT * 2147483648 + min(x) AS run FROM run0{n} GROUP BY grid_id, y, i),
lk0{n} AS (SELECT a.grid_id, a.run AS p, b.run AS q FROM runs{n} a JOIN runs{n} b ON a.grid_id = b.grid_id AND b.y = a.y + 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1),
lk{n} AS (SELECT grid_id, p, q FROM lk0{n} UNION ALL SELECT grid_id, q, p FROM lk0{n}),
reach{n} AS (SELECT grid_id, run, run AS r FROM runs{n} UNION SELECT t.grid_id, t.run, l.q FROM reach{n} t JOIN lk{n} l ON l.grid_id = t.grid_id AND l.p = t.r),
lab{n} AS (SELECT r.grid_id, r.y, r.x0, r.x1, r.run, m.comp FROM runs{n} r JOIN (SELECT grid_id, run, min(r) AS comp FROM reach{n} GROUP BY ALL) m ON m.grid_id = r.grid_id AND m.run = r.run),
cbox{n} AS (SELECT grid_id, comp, min(x0)::INT AS x, min(y)::INT AS y, (max(x1) - min(x0) + 1)::INT AS w, (max(y) - min(y) + 1)::INT AS h, sum(x1 - x0 + 1)::BIGINT AS n FROM lab{n} GROUP BY ALL)"""


def lines_sql(source: str, name: str, least: int, direction: str) -> str:
    """CTE ``name``: ``source`` without the components that hold a straight run of ``least`` + 2 dark cells."""
    a, b = ("x", "y") if direction == "horizontal" else ("y", "x")
    return labels_sql(source, f"_{name}") + f""", straight_{name} AS (SELECT grid_id, {b}, min({a}) AS {a} FROM (SELECT *, {a} - row_number() OVER (PARTITION BY grid_id, {b} ORDER BY {a}) AS i FROM dark_{name}) q
      GROUP BY grid_id, {b}, i HAVING count(*) >= {least + 2}),
    gone_{name} AS (SELECT DISTINCT l.grid_id, l.comp FROM lab_{name} l JOIN straight_{name} s ON s.grid_id = l.grid_id AND s.y = l.y AND s.x BETWEEN l.x0 AND l.x1),
    {name} AS (SELECT c.grid_id, c.x, c.y, CASE WHEN g.comp IS NOT NULL THEN 255 ELSE c.v END AS v FROM {source} c
      LEFT JOIN lab_{name} l ON l.grid_id = c.grid_id AND l.y = c.y AND c.x BETWEEN l.x0 AND l.x1 LEFT JOIN gone_{name} g ON g.grid_id = l.grid_id AND g.comp = l.comp)"""


LABELS = labels_sql()

register("c01_connected_boxes", "cells", lambda d: C.boxes(C.label(d)), LABELS + " SELECT grid_id, comp, x, y, w, h, n FROM cbox")
register("c01_connected_boxes_large", "mosaic", lambda d: C.boxes(C.label(d, 80)), labels_sql("mosaic").replace("v < 128", "v < 80") + " SELECT grid_id, comp, x, y, w, h, n FROM cbox")
for _axis in ("horizontal", "vertical"):
    # on grids of 8 by 8 cells no run exceeds the least length that counts by default
    register(
        "c02_remove_long_lines" + ("_vertical" if _axis == "vertical" else ""), "cells", lambda d, a=_axis: C.remove_long_lines(d, 3, a, shortest=0),
        lines_sql("cells", "o", 3, _axis) + " SELECT grid_id, x, y, v FROM o",
    )


def _ruled(d: DataFrame) -> DataFrame:
    """Darkest where one of two rulers runs: 29 cells of every 32nd row, 20 of every 16th column."""
    ruler = ((F.col("y") % 32 == 5) & F.col("x").between(1, 29)) | ((F.col("x") % 16 == 8) & F.col("y").between(20, 39))
    return d.select("grid_id", "x", "y", F.when(ruler, 0).otherwise(F.col("v") % 200 + 50).alias("v"))


RULED = ", ruled AS (SELECT grid_id, x, y, CASE WHEN (y % 32 = 5 AND x BETWEEN 1 AND 29) OR (x % 16 = 8 AND y BETWEEN 20 AND 39) THEN 0 ELSE v % 200 + 50 END AS v FROM mosaic)"
register("c02_remove_long_lines_both", "mosaic", lambda d: C.remove_long_lines(_ruled(d), 18, "both"), RULED + lines_sql("ruled", "h", 18, "horizontal") + lines_sql("h", "o", 18, "vertical") + " SELECT grid_id, x, y, v FROM o")
register("c02_short_lines_stay", "mosaic", lambda d: C.remove_long_lines(d, 10, "both"), " SELECT grid_id, x, y, v FROM mosaic")
register("c03_filter_components", "cells", lambda d: C.filter_components(C.boxes(C.label(d)), 3, 5), LABELS + " SELECT grid_id, comp, x, y, w, h, n FROM cbox WHERE w * 5 >= 3 AND h * 2 >= 5 AND h <= 1.3::DOUBLE * 5 AND w <= 2.5::DOUBLE * 3")
register(
    "w26_boxes_in_line", "cells", lambda d: C.boxes_in_line(d, 4, 4),
    LABELS + " SELECT grid_id, comp, x, y, w, h, n, row_number() OVER (PARTITION BY grid_id ORDER BY x + w, y, comp)::INT AS nth FROM cbox WHERE w * 4 > 4 AND h * 2 > 4",
)


def _points(d: DataFrame) -> DataFrame:
    details = F.when(F.col("unsure"), F.array(F.lit("unclear"))).otherwise(F.array().cast("array<string>"))
    return d.select("row_id", R.point_result(F.col("ok"), details).alias("verdict"))


SEV = "CASE WHEN ok IS NULL THEN 0 WHEN NOT ok THEN 3 WHEN unsure THEN 2 ELSE 1 END"
register("a18_point_result", "inspections", _points, "SELECT row_id, CASE WHEN NOT ok THEN 'NO' WHEN NOT unsure THEN 'YES' ELSE 'CHECK MANUALLY' END AS verdict FROM inspections")
register("a19_part_result", "inspections", R.part_result, f"SELECT part_id, run_ts, max({SEV}) AS result FROM inspections GROUP BY ALL")
WORD = "(['Not evaluated', 'OK', 'Unsure', 'Not OK'])[{s} + 1]"
TEXT = f""", s AS (SELECT *, {SEV} AS s, row_number() OVER (PARTITION BY part_id, run_ts ORDER BY point_id, row_id) AS i FROM inspections)
SELECT part_id, run_ts, {WORD.format(s='max(s)')} AS verdict, string_agg(i::VARCHAR || '. Point ' || point_id::VARCHAR || ': ' || {WORD.format(s='s')}, chr(10) ORDER BY i) AS details FROM s GROUP BY part_id, run_ts"""
register("a20_result_text", "inspections", R.result_text, TEXT)
register(
    "a21_pass_rate", "inspections", R.pass_rate,
    "SELECT part_id, point_id, count(*) AS inspected, sum(ok::INT)::BIGINT AS passed, round(sum(ok::INT) / count(*), 9) AS rate FROM inspections GROUP BY ROLLUP (part_id, point_id)",
)
MERGED = """, good AS (SELECT scan_id, code, row_number() OVER (PARTITION BY scan_id ORDER BY variant, code) AS i FROM detections WHERE code IS NOT NULL AND code <> '' AND code <> 'DataMatrix'),
acc AS (SELECT scan_id, i, code AS text FROM good WHERE i = 1 UNION ALL SELECT g.scan_id, g.i, CASE WHEN contains(a.text, g.code) THEN a.text ELSE a.text || ' ' || g.code END FROM acc a JOIN good g ON g.scan_id = a.scan_id AND g.i = a.i + 1),
merged AS (SELECT d.scan_id, coalesce(m.text, '') AS text FROM (SELECT DISTINCT scan_id FROM detections) d LEFT JOIN (SELECT scan_id, arg_max(text, i) AS text FROM acc GROUP BY scan_id) m USING (scan_id))"""
register("a22_merge_detections", "detections", R.merge_detections, MERGED + " SELECT scan_id, text FROM merged")
register("e09_detection_pipeline", "detections", R.detection_pipeline, MERGED + " SELECT scan_id, text, CASE WHEN text <> '' THEN 'good' ELSE 'bad' END AS verdict FROM merged")
register("u03_distinct_codes", "detections", lambda d: d.where("code IS NOT NULL").dropDuplicates(["scan_id", "code"]).select("scan_id", "code"), "SELECT DISTINCT scan_id, code FROM detections WHERE code IS NOT NULL")
register(
    "u02_variant_fan_out", "detections", lambda d: R.variant_fan_out(d, (1.0, 1.4, 2.0)).select("scan_id", "variant", "code", "factor"),
    "SELECT scan_id, variant, code, factor FROM detections, (SELECT unnest([1.0, 1.4, 2.0])::DOUBLE AS factor) f",
)
register(
    "u04_mask_difference", "cells", lambda d: d.where("v < 128").join(d.where("v < 64").select("grid_id", "x", "y"), P.KEY, "left_anti").select(*P.KEY, "v"),
    "SELECT grid_id, x, y, v FROM cells c WHERE v < 128 AND NOT EXISTS (SELECT 1 FROM cells d WHERE d.v < 64 AND d.grid_id = c.grid_id AND d.x = c.x AND d.y = c.y)",
)
register(
    "w13_rolling_results", "inspections", R.last_outcomes,
    """, b AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY run_ts DESC, part_id DESC, row_id DESC) AS back FROM inspections)
    SELECT point_id, row_number() OVER (PARTITION BY point_id ORDER BY back DESC)::INT AS nth, part_id, run_ts, ok FROM b WHERE back <= 60""",
)
register(
    "w14_running_pass_rate", "inspections", R.running_rate,
    "SELECT part_id, row_id, round(avg(ok::INT) OVER (PARTITION BY part_id ORDER BY run_ts, point_id, row_id ROWS UNBOUNDED PRECEDING), 9) AS rate FROM inspections",
)
register("w15_sequence_number", "capture_events", lambda d: R.sequence_number(d).select("event_id", "camera_id", "nth"), "SELECT event_id, camera_id, row_number() OVER (PARTITION BY camera_id ORDER BY ts, event_id)::INT AS nth FROM capture_events")
REPLIES = """, q AS (SELECT * FROM capture_events WHERE kind = 'request'), r AS (SELECT * FROM capture_events WHERE kind = 'response'),
m AS (SELECT q.camera_id, q.event_id, q.ts, r.event_id AS reply_id, r.value FROM q LEFT JOIN r ON r.camera_id = q.camera_id AND r.ts >= q.ts AND r.ts <= q.ts + INTERVAL 10 MINUTE
  QUALIFY row_number() OVER (PARTITION BY q.event_id, q.camera_id ORDER BY r.ts, r.event_id) = 1)"""
register("j08_match_request_response", "capture_events", R.match_replies, REPLIES + " SELECT camera_id, event_id, ts, reply_id, value, reply_id IS NOT NULL AS answered FROM m")


def _part_inspection(readings: DataFrame, inspections: DataFrame) -> DataFrame:
    """Each run's verdict and text beside what its part's label reads."""
    label = RD.reading_pipeline(readings).select("part_id", "label", "matches")
    return R.result_text(inspections).join(label, "part_id", "left").select("part_id", "run_ts", "verdict", "details", "label", "matches")


_LABEL = CANDIDATES + f""", lv AS (SELECT part_id, text, count(*) AS votes FROM cand GROUP BY ALL),
ls AS (SELECT *, votes / sum(votes) OVER (PARTITION BY part_id) AS share FROM lv),
lw AS (SELECT * FROM ls QUALIFY row_number() OVER (PARTITION BY part_id ORDER BY (share <= 0.5)::INT, votes DESC, text) = 1),
lo AS (SELECT p.part_id, coalesce(lw.text, '') AS t FROM (SELECT DISTINCT part_id FROM readings) p LEFT JOIN lw USING (part_id)),
ll AS (SELECT part_id, {_corrected('t')} AS label FROM lo), lf AS (SELECT part_id, label, ({_verified('label')}) <> '' AS matches FROM ll)"""
register(
    "e08_part_inspection", "readings inspections", _part_inspection,
    _LABEL + TEXT.replace("SELECT part_id, run_ts, (", ", tx AS (SELECT part_id, run_ts, (") + ") SELECT part_id, run_ts, verdict, details, label, matches FROM tx LEFT JOIN lf USING (part_id)",
)


def _board_holes(colours: DataFrame) -> DataFrame:
    """Cells at the peak of their tile's colours, thickened and opened."""
    return N.open_close(N.extreme(G.tile_colour_peak(colours, 30, 4, 4), 3, 3), 5, 5)


def _stage(source: str, name: str, f: str, k: int) -> str:
    return f", {name} AS (SELECT c.grid_id, c.x, c.y, {f}(n.v) AS v FROM {source} c JOIN {source} n ON n.grid_id = c.grid_id AND abs(n.x - c.x) <= {k // 2} AND abs(n.y - c.y) <= {k // 2} GROUP BY c.grid_id, c.x, c.y)"


register(
    "e06_board_holes", "colours", _board_holes,
    """, t AS (SELECT *, max(r) OVER w AS mr, max(g) OVER w AS mg, max(b) OVER w AS mb FROM colours WINDOW w AS (PARTITION BY grid_id, x // 4, y // 4)),
    p AS (SELECT grid_id, x, y, CASE WHEN r * 100 >= mr * 70 AND g * 100 >= mg * 70 AND b * 100 >= mb * 70 THEN 0 ELSE 255 END AS v FROM t)"""
    + _stage("p", "q", "min", 3) + _stage("q", "o", "min", 5) + _stage("o", "z", "max", 5) + " SELECT grid_id, x, y, v FROM z",
)


#: Size of characters in E07's halved clips.
CW, CH = 5, 9
CLIP = (1, 2, 30, 120)


def region_binarize(cells: DataFrame, rects: DataFrame, cw: int, ch: int, width: int, height: int) -> DataFrame:
    """Characters of each region of ``width`` by ``height`` cells: clipped, halved, tiles normalised, cut locally with
    and without that, joined, cleaned of lines along both axes, of trails and of bridges, and boxed.

    What a step reads more than once is a table in the shared folder, so each step runs once."""
    half = C.written(P.downsample(G2.clip_cells(cells, rects).select("grid_id", "x", "y", "v")), "half")
    tile = (width // 4, height // 6)  # half of the halved width, a third of the halved height
    both = P.pair_up(G.local_otsu(half, *tile), G.local_otsu(G.normalise_tiles(half, 6, 12), *tile)).select(*P.KEY, P.combine(F.col("v"), F.col("w"), "gray_and").alias("v"))
    clean = C.written(both, "cut")
    for least, direction in ((3 * cw, "horizontal"), (ch * 3 // 2, "vertical")):
        clean = C.written(C.remove_long_lines(clean, least, direction), "clean")
    for kx in range(3, -(-2 * cw // 3), 2):
        for ky in range(3, -(-2 * ch // 3), 2):
            clean = N.clear_trails(clean, kx, ky)
    return C.filter_components(C.boxes(C.label(N.join_bridges(clean))), cw, ch, word=True)


def _region_binarize(cells: DataFrame) -> DataFrame:
    x, y, w, h = CLIP
    rects = cells.select("grid_id").distinct().selectExpr("1 AS region_id", "grid_id", f"{x} AS rx", f"{y} AS ry", f"{w} AS rw", f"{h} AS rh")
    return region_binarize(_inked(cells), rects, CW, CH, w, h)


def _inked(d: DataFrame) -> DataFrame:
    """Strokes of two widths and two long lines on a light ground that darkens to the right."""
    stroke = ((F.col("x") % 12 < 5) & (F.col("y") % 24 >= 4) & ((F.col("x") + F.col("y") + F.col("grid_id")) % 7 != 0)) | F.col("y").isin(2, 3) | F.col("x").isin(26, 27)
    return d.select("grid_id", "x", "y", F.when(stroke, F.col("v") % 60).otherwise(250 - F.col("x") - F.col("v") % 20).alias("v"))


def _suffixed(sql: str, suffix: str, *names: str) -> str:
    """The same CTEs under other names."""
    for n in names:
        sql = re.sub(rf"\b{n}\b", n + suffix, sql)
    return sql


def _region_sql() -> str:
    x, y, w, h = CLIP
    otsu = ("ot", "ob", "od", "ov", "ow", "ox", "otsu", "tiled", "cut")
    cut = f", tiled AS (SELECT *, (x // {w // 4})::INT AS tx, (y // {h // 6})::INT AS ty FROM {{source}})" + otsu_sql("grid_id, tx, ty", "tiled") + ", cut AS (SELECT grid_id, x, y, CASE WHEN v <= threshold THEN 0 ELSE 255 END AS v FROM tiled JOIN otsu USING (grid_id, tx, ty))"
    sql = f""", inked AS (SELECT grid_id, x, y, CASE WHEN (x % 12 < 5 AND y % 24 >= 4 AND (x + y + grid_id) % 7 <> 0) OR y IN (2, 3) OR x IN (26, 27) THEN v % 60 ELSE 250 - x - v % 20 END AS v FROM mosaic),
    half AS (SELECT grid_id, ((x - {x}) // 2)::INT AS x, ((y - {y}) // 2)::INT AS y, floor(avg(v))::INT AS v FROM inked WHERE x >= {x} AND x < {x + w} AND y >= {y} AND y < {y + h} GROUP BY ALL),
    mt AS (SELECT grid_id, x // 6 AS a, y // 12 AS b, sum(v) AS s, count(*) AS n FROM half GROUP BY ALL),
    mv AS (SELECT grid_id, a, b, floor(sum(s) OVER g / sum(n) OVER g) - floor(s / n) AS move FROM mt WINDOW g AS (PARTITION BY grid_id)),
    even AS (SELECT h.grid_id, h.x, h.y, greatest(0, least(255, h.v + m.move))::INT AS v FROM half h JOIN mv m ON m.grid_id = h.grid_id AND m.a = h.x // 6 AND m.b = h.y // 12)"""
    sql += _suffixed(cut.replace("{source}", "half"), "_p", *otsu) + _suffixed(cut.replace("{source}", "even"), "_q", *otsu)
    sql += ", both_ AS (SELECT p.grid_id, p.x, p.y, least(p.v, q.v) AS v FROM cut_p p JOIN cut_q q USING (grid_id, x, y))"
    sql += lines_sql("both_", "hl", 3 * CW, "horizontal") + lines_sql("hl", "vl", CH * 3 // 2, "vertical")
    last = "vl"
    for kx in range(3, -(-2 * CW // 3), 2):
        for ky in range(3, -(-2 * CH // 3), 2):
            sql += clear_sql(kx, last, f"tr{kx}x{ky}_", ky)
            last = f"tr{kx}x{ky}_"
    sql += bridges_sql(last, "joined") + labels_sql("joined")
    return sql + f" SELECT grid_id, comp, x, y, w, h, n FROM cbox WHERE w * 5 >= {CW} AND h * 2 >= {CH} AND w <= 3 * {CW}"


register("e07_region_binarize", "mosaic", _region_binarize, _region_sql())


def _processor(cells: DataFrame) -> DataFrame:
    """a step of the user's own between two of the library's, by DataFrame.transform."""
    return cells.transform(lambda d: N.box_mean(d, 3, 3)).transform(lambda d: d.withColumn("v", 255 - F.col("v"))).transform(G.mean_gray)


register("f01_processor", "cells", _processor, """, a AS (SELECT c.grid_id, c.x, c.y, 255 - floor(avg(n.v)) AS v FROM cells c JOIN cells n ON n.grid_id = c.grid_id AND abs(n.x - c.x) <= 1 AND abs(n.y - c.y) <= 1 GROUP BY c.grid_id, c.x, c.y)
SELECT grid_id, floor(avg(v))::INT AS mean FROM a GROUP BY grid_id""")


def evaluate(df: DataFrame, *aggregates: Column) -> DataFrame:
    """a roll-up of the user's own, as Columns inside the library's grouping by part and run."""
    return df.groupBy("part_id", "run_ts").agg(*aggregates)


register(
    "f02_evaluator", "inspections", lambda d: evaluate(d, F.round(F.avg(F.col("ok").cast("double")), 9).alias("share"), (F.count_if(~F.col("ok")) == 0).alias("clear")),
    "SELECT part_id, run_ts, round(avg(ok::INT), 9) AS share, count(*) FILTER (NOT ok) = 0 AS clear FROM inspections GROUP BY ALL",
)
