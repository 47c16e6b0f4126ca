"""Inspection tables derived from the given star-schema, embedding and event tables.

Each is one SQL text that runs in Spark and in DuckDB alike; ``build`` makes the Spark DataFrame and
``ctes`` the WITH list for the SQL twins of the registered queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LI = """SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey,
 min(l_quantity) AS l_quantity, min(l_shipdate) AS l_shipdate, min(l_returnflag) AS l_returnflag
 FROM {lineitem} GROUP BY l_orderkey, l_linenumber"""

SRC_SPARK = """SELECT vec_id AS grid_id, pos, CAST(col AS DOUBLE) AS f
 FROM {embeddings} LATERAL VIEW posexplode(embedding) e AS pos, col"""
SRC_DUCK = """SELECT vec_id AS grid_id, generate_subscripts(embedding, 1) - 1 AS pos,
 CAST(unnest(embedding) AS DOUBLE) AS f FROM {embeddings}"""

CELLS = """SELECT grid_id, CAST(pos % 8 AS INT) AS x, CAST(floor(pos / 8) AS INT) AS y,
 CAST(floor((f - min(f) OVER (PARTITION BY grid_id))
 / (max(f) OVER (PARTITION BY grid_id) - min(f) OVER (PARTITION BY grid_id)) * 255) AS INT) AS v FROM {src}"""

#: grids of 32 by 128 cells, each made of 64 of the small ones, four abreast
MOSAIC = """SELECT CAST(floor(grid_id / 64) AS BIGINT) AS grid_id, CAST(grid_id % 4 * 8 + x AS INT) AS x, CAST(floor(grid_id % 64 / 4) * 8 + y AS INT) AS y, v FROM {cells}"""

#: cells with a second grid's value beside them
PAIRS = """SELECT a.grid_id, a.x, a.y, a.v, b.v AS w FROM {cells} a JOIN {cells} b
 ON b.grid_id = a.grid_id + 1 AND b.x = a.x AND b.y = a.y"""

BOXES = """SELECT l_partkey AS grid_id, CAST(l_linenumber % 3 AS BIGINT) AS line_id, l_orderkey * 10 + l_linenumber AS box_id,
 CAST((l_orderkey * 37) % 400 AS INT) AS x, CAST(10 + 60 * (l_linenumber % 3) + l_suppkey % 7 AS INT) AS y,
 CAST(12 + l_quantity % 9 AS INT) AS w, CAST(18 + l_orderkey % 8 AS INT) AS h FROM {li}"""

READINGS = """SELECT l_partkey AS part_id, l_orderkey * 10 + l_linenumber AS reading_id, 'AADD' AS template,
 CASE l_linenumber % 5 WHEN 0 THEN t WHEN 1 THEN translate(t, '0158', 'OISB')
 WHEN 2 THEN concat(substr(t, 1, 2), '-', substr(t, 3)) WHEN 3 THEN concat(' ', lower(t), '©’')
 ELSE CASE l_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN concat(t, '+=') ELSE concat(t, 'X') END END AS raw
 FROM (SELECT l_partkey, l_orderkey, l_linenumber,
 concat(substr(p_type, 1, 2), lpad(CAST(p_size AS VARCHAR(9)), 2, '0')) AS t FROM {li} JOIN {part} ON l_partkey = p_partkey) q"""

#: readings of which some are null: a third of the parts' first ones, and all of every ninth part
GAPPY = """SELECT part_id, reading_id, template, CASE WHEN part_id % 9 = 0 OR (part_id % 3 = 1 AND reading_id % 10 <= 2) THEN NULL ELSE raw END AS raw FROM {readings}"""

#: one block of settings for each part; the last lines repeat a key of the block for every fifth part
SETTINGS = """SELECT p_partkey * 10 + i AS line_no, CASE i
 WHEN 1 THEN concat('P', k, '.Left IP.Text Inspection.1.clipBox=', CAST(p_partkey % 3 AS VARCHAR(9)), ',1,', CAST(2 + p_partkey % 5 AS VARCHAR(9)), ',4')
 WHEN 2 THEN concat('P', k, '.Left IP.Text Inspection.2.clipBox = 0,0,8,2.0')
 WHEN 3 THEN concat('P', k, '.Left IP.Text Inspection.3.clipBox=1,1,x,4')
 WHEN 4 THEN concat('P', k, '.Right IP.Text Inspection.1.clipBox : 1,1,6,1,6,6,1,', CAST(4 + p_partkey % 3 AS VARCHAR(9)))
 WHEN 5 THEN concat('P', k, '.Left IP.Text Inspection.characterDimensions=', CASE WHEN p_partkey % 3 = 0 THEN '3' ELSE '3,4' END)
 WHEN 6 THEN CASE WHEN p_partkey % 2 = 0 THEN concat('P', k, '.Left IP.Text Inspection.thickness=Thick') ELSE '' END
 WHEN 7 THEN concat('# comment line ', k)
 ELSE CASE WHEN p_partkey % 5 = 0 THEN concat('P', k, '.Left IP.Text Inspection.1.clipBox=2,2,4,4') ELSE concat('! other comment ', k) END END AS text
 FROM (SELECT p_partkey, CAST(p_partkey AS VARCHAR(19)) AS k FROM {part}) p
 CROSS JOIN (SELECT 1 AS i UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8) n"""

INSPECTIONS = """SELECT l_partkey AS part_id, CAST(l_shipdate AS TIMESTAMP) AS run_ts, CAST(l_linenumber % 2 + 1 AS INT) AS point_id,
 l_returnflag <> 'R' AS ok, l_returnflag = 'N' AS unsure, l_orderkey * 10 + l_linenumber AS row_id FROM {li}"""

EVENTS = """SELECT event_id, ts, user_id % 4 + 1 AS camera_id,
 CASE event_type WHEN 'view' THEN 'request' WHEN 'click' THEN 'response' WHEN 'error' THEN 'fail' ELSE 'beat' END AS kind, value
 FROM {events}"""

#: a fleet that grows with the events: four cameras for every thousand of them, and one that has a third of all
FLEET = """SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 0 ELSE CAST(floor(event_id / 1000) AS BIGINT) * 4 + user_id % 4 + 1 END AS camera_id, kind, value
 FROM (SELECT event_id, ts, user_id, CASE event_type WHEN 'view' THEN 'request' WHEN 'click' THEN 'response' ELSE 'beat' END AS kind, value FROM {events}) e"""

COLOURS = """SELECT grid_id, x, y, v AS r, coalesce(lead(v, 1) OVER (PARTITION BY grid_id ORDER BY y, x), 0) AS g,
 coalesce(lead(v, 2) OVER (PARTITION BY grid_id ORDER BY y, x), 0) AS b FROM {cells}"""

PATHS = "SELECT page_id, url AS path FROM {pages}"

DETECTIONS = """SELECT l_orderkey AS scan_id, CAST(l_linenumber AS INT) AS variant,
 CASE WHEN l_suppkey % 10 = 0 THEN NULL WHEN l_suppkey % 10 = 1 THEN 'DataMatrix'
 ELSE concat('P', CAST(l_partkey % 50 AS VARCHAR(9))) END AS code FROM {li}"""

#: name: (SQL, what it reads)
TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "li": (LI, ("lineitem",)),
    "src": (SRC_SPARK, ("embeddings",)),
    "cells": (CELLS, ("src",)),
    "mosaic": (MOSAIC, ("cells",)),
    "pairs": (PAIRS, ("cells",)),
    "colours": (COLOURS, ("cells",)),
    "boxes": (BOXES, ("li",)),
    "readings": (READINGS, ("li", "part")),
    "gappy_readings": (GAPPY, ("readings",)),
    "settings": (SETTINGS, ("part",)),
    "inspections": (INSPECTIONS, ("li",)),
    "capture_events": (EVENTS, ("events",)),
    "fleet_events": (FLEET, ("events",)),
    "paths": (PATHS, ("pages",)),
    "detections": (DETECTIONS, ("li",)),
}


def build(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named fixture, or the given table of that name."""
    if name not in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql, needs = TABLES[name]
    return spark.sql(sql, **{n: build(spark, sf_dir, n) for n in needs})


def ctes(*names: str) -> str:
    """WITH list that defines the named fixtures, and what they read, for DuckDB."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES and name not in order:
            for n in TABLES[name][1]:
                visit(n)
            order.append(name)

    for name in names:
        visit(name)
    parts = []
    for name in order:
        sql = SRC_DUCK if name == "src" else TABLES[name][0]
        parts.append(f"{name} AS ({sql.format(**{n: n for n in TABLES[name][1]})})")
    return "WITH RECURSIVE " + ",\n".join(parts)
