"""Queries on single cells and pairs of grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partlens.functions import curves as C
from partlens.operators import points as P

from .registry import register

KEY = "grid_id, x, y"


def _cell(name: str, f, sql: str) -> None:
    """A function of a cell's value."""
    register(name, "cells", lambda df: df.select(*P.KEY, f(F.col("v")).cast("int").alias("v")), f"SELECT {KEY}, CAST({sql} AS INT) AS v FROM cells")


register(
    "p01_to_gray", "colours", P.to_gray,
    f"""SELECT {KEY}, floor(g * 0.59::DOUBLE + r * 0.3::DOUBLE + b * 0.11::DOUBLE + 1e-9)::INT AS weighted, ((r + g + b) // 3)::INT AS mean,
    ((r * 77 + g * 151 + b * 28) // 256)::INT AS ntsc FROM colours""",
)
_cell("p02_binarize", lambda v: P.binarize(v, 128), "CASE WHEN v < 128 THEN 0 ELSE 255 END")
_cell("p02_binarize_up", lambda v: P.binarize(v, 128, "up"), "CASE WHEN v > 128 THEN 0 ELSE 255 END")
_cell("p02_binarize_keep", lambda v: P.binarize(v, 200, "keep"), "CASE WHEN v IN (0, 255) THEN v WHEN v <= 200 THEN 0 ELSE 255 END")
_cell("p03_invert", P.invert, "255 - v")

PREDICATES = {
    "is_green": "g > r AND g > b", "is_light": "r > 150 AND g > 150 AND b > 150", "is_copper": "r > g AND g > b AND r > 100",
    "is_near_white": "least(r, g, b) > 200 AND greatest(r, g, b) - least(r, g, b) < 30", "is_near_gray": "greatest(r, g, b) - least(r, g, b) < 25",
    "is_almost_white": "least(r, g, b) > 230",
}


def _rgb() -> tuple:
    return F.col("r"), F.col("g"), F.col("b")


register(
    "p04_colour_predicates", "colours", lambda df: df.select(*P.KEY, *[c.alias(n) for n, c in P.colour_predicates(*_rgb()).items()]),
    f"SELECT {KEY}, " + ", ".join(f"{s} AS {n}" for n, s in PREDICATES.items()) + " FROM colours",
)
for _name, _sql in PREDICATES.items():
    register(
        f"p05_white_for_{_name[3:]}", "colours", lambda df, n=_name: P.replace_with_white(df, P.colour_predicates(*_rgb())[n]),
        f"SELECT {KEY}, " + ", ".join(f"CASE WHEN {_sql} THEN 255 ELSE {c} END AS {c}" for c in "rgb") + " FROM colours",
    )
register(
    "p05_enhance_whites", "colours", lambda df: P.replace_with_white(df, P.colour_predicates(*_rgb())["is_almost_white"], F.lit(0)),
    f"SELECT {KEY}, " + ", ".join(f"CASE WHEN {PREDICATES['is_almost_white']} THEN 255 ELSE 0 END AS {c}" for c in "rgb") + " FROM colours",
)
register(
    "p06_near_colours", "colours", lambda df: df.select(*P.KEY, P.near_colours(_rgb(), (F.lit(120), F.lit(110), F.lit(100)), 60).alias("near")),
    f"SELECT {KEY}, abs(r - 120) <= 60 AND abs(g - 110) <= 60 AND abs(b - 100) <= 60 AS near FROM colours",
)
register("p07_border_fill", "cells", lambda df: P.border_fill(df, 2), f"SELECT {KEY}, CASE WHEN x < 2 OR y < 2 OR x >= 6 OR y >= 6 THEN 255 ELSE v END AS v FROM cells")


def gamma_sql(v: str, g: str) -> str:
    step = f"round(greatest(0.01::DOUBLE, least(6.99::DOUBLE, {g})) / 0.05::DOUBLE)"
    return f"(CASE WHEN {step} = 0 THEN CASE WHEN {v} < 255 THEN 0 ELSE 255 END ELSE floor(255 * pow({v} / 255.0::DOUBLE, 1.0::DOUBLE / (greatest({step}, 1) * 0.05::DOUBLE)) + 1e-6) END)::INT"


for _g in (0.02, 0.5, 2.2):
    _cell(f"p08_gamma_{str(_g).replace('.', '_')}", lambda v, g=_g: C.gamma_value(v, F.lit(g)), gamma_sql("v", f"{_g}::DOUBLE"))

BLEND_SQL = {
    "min": "least(v, w)", "max": "greatest(v, w)", "add": "v + w", "subtract": "v - w", "difference": "abs(v - w)", "multiply": "v * w // 255", "average": "(v + w) // 2",
    "screen": "255 - (255 - v) * (255 - w) // 255", "overlay": "(v * (255 - (255 - v) * (255 - w) // 255) + (255 - v) * (v * w // 255)) // 255",
}


def _paired(cells: DataFrame) -> DataFrame:
    return P.pair_up(cells, cells.withColumn("grid_id", F.col("grid_id") - 1))


PAIRED = "FROM cells a JOIN cells b ON b.grid_id = a.grid_id + 1 AND b.x = a.x AND b.y = a.y"
WITH_PAIRS = f", p AS (SELECT a.grid_id, a.x, a.y, a.v, b.v AS w {PAIRED})"
for _name, _sql in BLEND_SQL.items():
    register(
        f"p09_blend_{_name}", "cells", lambda df, n=_name: _paired(df).select(*P.KEY, P.blend(F.col("v"), F.col("w"), n).alias("v")),
        f"{WITH_PAIRS} SELECT {KEY}, greatest(0, least(255, {_sql}))::INT AS v FROM p",
    )
COMBINE_SQL = {
    "binary_and": "greatest(v, w)", "binary_or": "least(v, w)", "gray_and": "least(v, w)", "gray_or": "greatest(v, w)", "average": "(v + w) // 2",
    "average_skip_white": "CASE WHEN v >= 248 THEN v ELSE (v + w) // 2 END",
}
for _name, _sql in COMBINE_SQL.items():
    register(
        f"j01_combine_{_name}", "cells", lambda df, n=_name: _paired(df).select(*P.KEY, P.combine(F.col("v"), F.col("w"), n).cast("int").alias("v")),
        f"{WITH_PAIRS} SELECT {KEY}, ({_sql})::INT AS v FROM p",
    )


def _curves(df: DataFrame) -> DataFrame:
    a = F.col("l_discount") * 10
    q = F.col("l_quantity").cast("double")
    cols = {
        "bias": C.bias(a, 0.3), "gain": C.gain(a, 0.3), "step": C.step(0.5, a), "pulse": C.pulse(0.2, 0.6, a), "smooth_step": C.smooth_step(0.2, 0.8, a),
        "smooth_pulse": C.smooth_pulse(0.1, 0.3, 0.6, 0.8, a), "clamp": C.clamp(q, 5.0, 20.0), "mod": C.mod(q, 7.0), "triangle": C.triangle(q / 8), "lerp": C.lerp(0.25, q, a),
    }
    names = list(cols)
    # millionths, as whole numbers: sums are then the same in any order
    out = df.select("l_orderkey", "l_linenumber", *[F.round(cols[n].cast("double") * 1e6).cast("long").alias(n) for n in names])
    return out.groupBy("l_orderkey", "l_linenumber").agg(*[F.sum(n).alias(n) for n in names])


_A, _Q = "(l_discount * 10)::DOUBLE", "l_quantity::DOUBLE"
CURVE_SQL = {
    "bias": "a / ((1 / 0.3::DOUBLE - 2) * (1 - a) + 1)",
    "gain": "CASE WHEN a < 0.5 THEN a / ((1 / 0.3::DOUBLE - 2) * (1 - 2 * a) + 1) ELSE ((1 / 0.3::DOUBLE - 2) * (1 - 2 * a) - a) / ((1 / 0.3::DOUBLE - 2) * (1 - 2 * a) - 1) END",
    "step": "CASE WHEN a < 0.5 THEN 0 ELSE 1 END", "pulse": "CASE WHEN a < 0.2 OR a >= 0.6 THEN 0 ELSE 1 END",
    "smooth_step": "CASE WHEN a < 0.2 THEN 0 WHEN a >= 0.8 THEN 1 ELSE pow((a - 0.2) / 0.6, 2) * (3 - 2 * (a - 0.2) / 0.6) END",
    "smooth_pulse": "CASE WHEN a < 0.1 OR a >= 0.8 THEN 0 WHEN a >= 0.3 AND a < 0.6 THEN 1 WHEN a < 0.3 THEN pow((a - 0.1) / 0.2, 2) * (3 - 2 * (a - 0.1) / 0.2) ELSE 1 - pow((a - 0.6) / 0.2, 2) * (3 - 2 * (a - 0.6) / 0.2) END",
    "clamp": "greatest(5, least(20, q))", "mod": "q - floor(q / 7) * 7", "triangle": "CASE WHEN q / 8 - floor(q / 8) < 0.5 THEN (q / 8 - floor(q / 8)) * 2 ELSE (1 - (q / 8 - floor(q / 8))) * 2 END",
    "lerp": "q + (a - q) * 0.25",
}
register(
    "p10_curve_functions", "lineitem", _curves,
    f"WITH t AS (SELECT l_orderkey, l_linenumber, {_A} AS a, {_Q} AS q FROM lineitem) SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"sum(round(({s})::DOUBLE * 1e6)::BIGINT)::BIGINT AS {n}" for n, s in CURVE_SQL.items()) + " FROM t GROUP BY ALL",
)
register(
    "p11_pad_cells", "cells", lambda df: P.pad_cells(df, 3, 5),
    """, g AS (SELECT DISTINCT grid_id FROM cells), f AS (SELECT grid_id, x::INT AS x, y::INT AS y FROM g, range(0, 10) AS a(x), range(0, 12) AS b(y))
    SELECT f.grid_id, f.x, f.y, coalesce(c.v, 255) AS v FROM f LEFT JOIN cells c ON c.grid_id = f.grid_id AND c.x = f.x - 1 AND c.y = f.y - 2""",
)
register("p12_downsample_2x", "cells", P.downsample, "SELECT grid_id, (x // 2)::INT AS x, (y // 2)::INT AS y, floor(avg(v))::INT AS v FROM cells GROUP BY ALL")
_S, _C = "sin(radians(30::DOUBLE))", "cos(radians(30::DOUBLE))"
register(
    "p13_rotate_cells", "cells", lambda df: P.rotate_cells(df, 30.0),
    f""", size AS (SELECT grid_id, max(x) + 1 AS w, max(y) + 1 AS h FROM cells GROUP BY grid_id),
    canvas AS (SELECT *, ceil(abs(w * {_C}) + abs(h * {_S}) - 1e-9)::INT AS nw, ceil(abs(w * {_S}) + abs(h * {_C}) - 1e-9)::INT AS nh FROM size),
    place AS (SELECT q.*, unnest(range(0, nw)) AS x FROM (SELECT *, unnest(range(0, nh)) AS y FROM canvas) q),
    away AS (SELECT *, x + 0.5::DOUBLE - nw / 2::DOUBLE AS dx, y + 0.5::DOUBLE - nh / 2::DOUBLE AS dy FROM place),
    turned AS (SELECT grid_id, x, y, floor(dx * {_C} + dy * {_S} + w / 2::DOUBLE + 1e-9)::INT AS sx, floor(-dx * {_S} + dy * {_C} + h / 2::DOUBLE + 1e-9)::INT AS sy FROM away)
    SELECT t.grid_id, t.x::INT AS x, t.y::INT AS y, coalesce(c.v, 255) AS v FROM turned t LEFT JOIN cells c ON c.grid_id = t.grid_id AND c.x = t.sx AND c.y = t.sy""",
)
