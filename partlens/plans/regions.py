"""Queries on region settings and the cells they cut out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partlens.functions.strings import base_name
from partlens.operators import regions as G

from .registry import register

PARSED = r"""
, s AS (SELECT line_no, trim(text) AS t FROM settings WHERE trim(text) <> '' AND NOT regexp_matches(trim(text), '^[#!]')),
kv AS (SELECT line_no, regexp_extract(t, '^([^=:]*?)\s*[=:]', 1) AS key, regexp_extract(t, '^[^=:]*[=:]\s*(.*)$', 1) AS value FROM s),
kept AS (SELECT * FROM kv QUALIFY row_number() OVER (PARTITION BY key ORDER BY line_no DESC) = 1),
keys AS (SELECT line_no, key, value, n[1] AS part, n[2] AS point, n[3] AS processor, CASE WHEN len(n) = 5 THEN n[4]::INT END AS i,
  CASE WHEN len(n) = 5 THEN n[5] ELSE n[4] END AS kind FROM (SELECT *, string_split(key, '.') AS n FROM kept) q),
nums AS (SELECT *, list_transform(string_split(value, ','), lambda x: TRY_CAST(trim(x) AS DOUBLE)) AS d FROM keys),
ok AS (SELECT *, len(d) = 4 AND len(list_filter(d, lambda x: x IS NULL)) = 0 AND trunc(d[3]) >= 2 AND trunc(d[4]) >= 2 AS is_rect,
  len(d) >= 6 AND len(d) % 2 = 0 AND len(list_filter(d, lambda x: x IS NULL)) = 0 AS is_poly FROM nums WHERE kind = 'clipBox'),
rects AS (SELECT part, point, processor, i, trunc(d[1])::INT AS x, trunc(d[2])::INT AS y, trunc(d[3])::INT AS w, trunc(d[4])::INT AS h, substr(part, 2)::BIGINT AS grid_id, line_no FROM ok WHERE is_rect),
pts AS (SELECT part, point, processor, i, line_no, unnest(range(0, len(d) // 2)) AS k, d FROM ok WHERE is_poly),
verts AS (SELECT part, point, processor, i, line_no, k, d[2*k+1] AS px, d[2*k+2] AS py, d[2*((k+1) % (len(d)//2))+1] AS qx, d[2*((k+1) % (len(d)//2))+2] AS qy FROM pts),
boxes_of AS (SELECT part, point, processor, i, line_no, floor(min(px))::INT AS x, floor(min(py))::INT AS y, (ceil(max(px)) - floor(min(px)))::INT AS w, (ceil(max(py)) - floor(min(py)))::INT AS h, count(*) AS n
  FROM verts GROUP BY ALL)"""


def keys(settings: DataFrame) -> DataFrame:
    return G.key_parts(G.parse_settings(settings))


def clip_boxes(settings: DataFrame) -> DataFrame:
    """Keys of regions. Lines that do not name the kind at all go before they are taken apart; lines of one key all name it."""
    return keys(settings.where(F.contains("text", F.lit("clipBox")))).where("kind = 'clipBox'")


def rects(settings: DataFrame) -> DataFrame:
    r = G.parse_rect(F.col("value"))
    out = clip_boxes(settings).withColumn("r", r).where("r IS NOT NULL")
    return out.select("part", "point", "processor", "i", "r.*", F.substring("part", 2, 18).try_cast("long").alias("grid_id"), "line_no")


def polygons(settings: DataFrame) -> DataFrame:
    out = clip_boxes(settings).withColumn("points", G.parse_polygon(F.col("value"))).where("points IS NOT NULL")
    return out.select("part", "point", "processor", "i", "points", F.substring("part", 2, 18).try_cast("long").alias("grid_id"), F.col("line_no").alias("region_id"))


register("s02_filter_files", "paths", lambda df: df.where(F.contains("path", F.lit("1"))).select("page_id", "path"), "SELECT page_id, path FROM paths WHERE path LIKE '%1%'")
register(
    "s03_base_name", "paths", lambda df: df.select("page_id", base_name(F.col("path")).alias("name")),
    "SELECT page_id, regexp_extract(path, '([^/.]*)[^/]*$', 1) AS name FROM paths",
)
register("s06_properties_to_table", "settings", lambda df: G.parse_settings(df).select("line_no", "key", "value"), PARSED + " SELECT line_no, key, value FROM kept")


def _region_keys(settings: DataFrame) -> DataFrame:
    counts = clip_boxes(settings).groupBy("part", "point", "processor").agg(F.max("i").alias("regions"))
    return G.region_keys(counts).select("key", "i")


register(
    "r01_region_keys", "settings", _region_keys,
    PARSED + """, c AS (SELECT part, point, processor, max(i) AS n FROM keys WHERE kind = 'clipBox' GROUP BY ALL)
    SELECT concat_ws('.', part, point, processor, i::VARCHAR, 'clipBox') AS key, i::INT AS i FROM (SELECT *, unnest(range(1, greatest(n, 1)::BIGINT + 1)) AS i FROM c) q""",
)
register("r02_parse_clip_rect", "settings", lambda df: rects(df).select("part", "point", "i", "x", "y", "w", "h"), PARSED + " SELECT part, point, i, x, y, w, h FROM rects")
register(
    "r03_parse_clip_polygon", "settings", lambda df: polygons(df).select("part", F.posexplode("points").alias("k", "p")).select("part", "k", "p.x", "p.y"),
    PARSED + " SELECT part, k::INT AS k, px AS x, py AS y FROM verts",
)
register(
    "r04_polygon_bbox", "settings", lambda df: polygons(df).select("part", G.polygon_bbox(F.col("points")).alias("b")).select("part", "b.*"),
    PARSED + " SELECT part, x, y, w, h FROM boxes_of WHERE w >= 2 AND h >= 2",
)
register(
    "r05_region_settings", "settings", lambda df: G.region_settings(keys(df)),
    PARSED + """, g AS (SELECT part, point, processor, max(value) FILTER (kind = 'characterDimensions') AS s, max(value) FILTER (kind = 'thickness') AS t FROM keys GROUP BY ALL)
    SELECT part, point, processor, CASE WHEN s LIKE '%,%' THEN split_part(s, ',', 1)::INT ELSE 10 END AS width,
    CASE WHEN s LIKE '%,%' THEN split_part(s, ',', 2)::INT ELSE 16 END AS height, coalesce(t, 'Thin') AS thickness FROM g""",
)
register(
    "r06_number_regions", "settings", lambda df: G.number_regions(rects(df)).select("part", "point", "processor", "i", "n"),
    PARSED + " SELECT part, point, processor, i, row_number() OVER (PARTITION BY part, point, processor ORDER BY i)::INT AS n FROM rects",
)


def _upsert(settings: DataFrame) -> DataFrame:
    old = G.parse_settings(settings)
    new = old.where("line_no % 3 = 0").select(F.regexp_replace("key", "Left", "Right").alias("key"), F.concat(F.lit("new "), "value").alias("value"))
    return G.upsert(old, new)


register(
    "r07_upsert_regions", "settings", _upsert,
    PARSED + """, n AS (SELECT replace(key, 'Left', 'Right') AS key, 'new ' || value AS value FROM kept WHERE line_no % 3 = 0)
    SELECT coalesce(n.key, kept.key) AS key, coalesce(n.value, kept.value) AS value FROM kept FULL JOIN n ON kept.key = n.key""",
)
register(
    "r08_check_unique", "inspections", lambda df: G.violations(df, "part_id", "run_ts", "point_id"),
    "SELECT part_id, run_ts, point_id, count(*) AS n FROM inspections GROUP BY ALL HAVING count(*) > 1",
)


def _region_rects(settings: DataFrame) -> DataFrame:
    return rects(settings).select(F.col("line_no").alias("region_id"), "grid_id", F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("w").alias("rw"), F.col("h").alias("rh"))


_INSIDE = "c.x >= r.x AND c.x < r.x + r.w AND c.y >= r.y AND c.y < r.y + r.h"
register(
    "r09_clip_cells", "cells settings", lambda c, s: G.clip_cells(c, _region_rects(s)),
    PARSED + f" SELECT r.line_no AS region_id, c.grid_id, c.x - r.x AS x, c.y - r.y AS y, v FROM cells c JOIN rects r ON c.grid_id = r.grid_id WHERE {_INSIDE}",
)
register(
    "r09_retain_clip", "cells settings", lambda c, s: G.clip_cells(c, _region_rects(s), rebase=False),
    PARSED + f" SELECT r.line_no AS region_id, c.grid_id, c.x, c.y, CASE WHEN {_INSIDE} THEN v ELSE 255 END AS v FROM cells c JOIN rects r ON c.grid_id = r.grid_id",
)


def _next_grid(cells: DataFrame) -> DataFrame:
    return cells.withColumn("grid_id", F.col("grid_id") - 1)


for _inv in (False, True):
    register(
        "r10_mask_cells" + "_inverted" * _inv, "cells", lambda c, i=_inv: G.mask_cells(c, _next_grid(c), i),
        f"SELECT c.grid_id, c.x, c.y, CASE WHEN m.v {'>=' if _inv else '<'} 128 THEN c.v ELSE {0 if _inv else 255} END AS v "
        "FROM cells c JOIN cells m ON m.grid_id = c.grid_id + 1 AND m.x = c.x AND m.y = c.y",
    )
register(
    "r11_clip_polygon_cells", "cells settings", lambda c, s: G.clip_polygon_cells(c, polygons(s).select("region_id", "grid_id", "points")),
    PARSED + """, e AS (SELECT v.*, substr(v.part, 2)::BIGINT AS grid_id FROM verts v JOIN boxes_of b USING (part, point, processor, i, line_no) WHERE b.w >= 2 AND b.h >= 2)
    SELECT e.line_no AS region_id, c.grid_id, c.x, c.y, any_value(c.v) AS v FROM cells c JOIN e USING (grid_id) GROUP BY e.line_no, c.grid_id, c.x, c.y
    HAVING sum(CASE WHEN (py > c.y + 0.5) <> (qy > c.y + 0.5) AND c.x + 0.5 < px + (c.y + 0.5 - py) * (qx - px) / (qy - py) THEN 1 ELSE 0 END) % 2 = 1""",
)
register(
    "r12_walk_hierarchy", "settings", lambda df: G.walk_hierarchy(keys(df)),
    PARSED + " SELECT DISTINCT part || ' > ' || point || ' > ' || processor AS path, part, point, processor FROM keys",
)


def _overlay(settings: DataFrame) -> DataFrame:
    """All rectangles of all processors of a point, as its overlay. A rectangle's key names its point and processor."""
    return rects(settings).where("part IS NOT NULL AND point IS NOT NULL AND processor IS NOT NULL").select("part", "point", "processor", "i", "x", "y", "w", "h")


register("j09_merge_boxes_regions", "settings", _overlay, PARSED + " SELECT part, point, processor, i, x, y, w, h FROM rects")
