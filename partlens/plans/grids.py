"""Queries on whole grids and tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partlens.operators import grids as G

from .neighbours import LIST, around, ranked, ratio_sql
from .points import gamma_sql
from .registry import register

KEY = "grid_id, x, y"

register("a01_histogram", "cells", G.histogram, "SELECT grid_id, v AS bin, count(*) AS n FROM cells GROUP BY ALL")
register("a01_histogram_buckets", "cells", lambda d: G.histogram(d, 10), "SELECT grid_id, (v // 10)::INT AS bin, count(*) AS n FROM cells GROUP BY ALL")
register(
    "a02_min_max_histogram", "cells", lambda d: G.min_max_histogram(d.where("v BETWEEN 20 AND 200")),
    """, m AS (SELECT grid_id, v, min(v) OVER w AS lo, max(v) OVER w AS hi FROM cells WHERE v BETWEEN 20 AND 200 WINDOW w AS (PARTITION BY grid_id))
    SELECT grid_id, (CASE WHEN hi = lo THEN 128 ELSE (v - lo) * 255 // greatest(hi - lo, 1) END)::INT AS bin, count(*) AS n FROM m GROUP BY ALL""",
)


def otsu_sql(keys: str, source: str = "cells", experimental: bool = False) -> str:
    """CTE otsu: keys, raw, threshold; each candidate bin is tried against all cells of the key."""
    on = " AND ".join(f"h.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    half = "lo // 2"
    if experimental:
        final = f"CASE WHEN covered >= 0.45 THEN {half} WHEN covered >= 0.35 THEN -1 WHEN place < 0.35 THEN raw ELSE raw - floor((hi - lo) * 5 / 100) END"
    else:
        final = f"CASE WHEN covered >= 0.6 THEN {half} WHEN place < 0.1 THEN raw + floor((hi - lo) * 15 / 100) WHEN place < 0.15 THEN raw + floor((hi - lo) * 75 / 1000) WHEN place < 0.3 THEN raw ELSE raw - floor((hi - lo) * 5 / 100) END"
    return f""", ot AS (SELECT {keys}, v, min(v) OVER w AS lo, max(v) OVER w AS hi FROM {source} WINDOW w AS (PARTITION BY {keys})),
    ob AS (SELECT {keys}, lo, hi, (CASE WHEN hi = lo THEN 128 ELSE (v - lo) * 255 // greatest(hi - lo, 1) END) // 3 AS b FROM ot),
    od AS (SELECT DISTINCT {keys}, b FROM ob),
    ov AS (SELECT {", ".join("h." + k.strip() for k in keys.split(","))}, any_value(lo) AS lo, any_value(hi) AS hi, b.b AS t, count(*) AS w, count(*) FILTER (h.b <= b.b) AS wb,
      sum(h.b) FILTER (h.b <= b.b) AS sb, coalesce(sum(h.b) FILTER (h.b > b.b), 0) AS sf FROM ob h JOIN od b ON {on} GROUP BY {", ".join("h." + k.strip() for k in keys.split(","))}, b.b),
    ow AS (SELECT *, round(coalesce(wb * (w - wb) * pow(sb / wb - sf / nullif(w - wb, 0), 2), 0), 6) AS var FROM ov),
    ox AS (SELECT *, (lo + (3 * t + 1) * (hi - lo) // 255)::INT AS raw, wb / w AS covered FROM ow QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY var DESC, t) = 1),
    otsu AS (SELECT {keys}, raw, ({final})::INT AS threshold FROM (SELECT *, coalesce((raw - lo) / nullif(hi - lo, 0), 0) AS place FROM ox) q)"""


TILED = ", tiled AS (SELECT *, (x // 4)::INT AS tx, (y // 4)::INT AS ty FROM cells)"
for _e in (False, True):
    _n = "_experimental" * _e
    register(
        ("a04_otsu_experimental" if _e else "a03_otsu_threshold"), "cells", lambda d, e=_e: G.otsu(d, ["grid_id"], e), otsu_sql("grid_id", "cells", _e) + " SELECT grid_id, raw, threshold FROM otsu",
    )
register(
    "a05_local_otsu", "cells", lambda d: G.local_otsu(d, 4, 4),
    TILED + otsu_sql("grid_id, tx, ty", "tiled") + f" SELECT {KEY}, CASE WHEN v <= threshold THEN 0 ELSE 255 END AS v FROM tiled JOIN otsu USING (grid_id, tx, ty)",
)
register(
    "a05_local_otsu_experimental", "cells", lambda d: G.local_otsu(d, 4, 4, True),
    TILED + otsu_sql("grid_id, tx, ty", "tiled", True) + around(LIST)
    + f""" SELECT c.grid_id, c.x, c.y, CASE WHEN threshold = -1 THEN CASE WHEN c.v >= {ranked(30, 'a.l')} THEN 255 ELSE 0 END WHEN c.v <= threshold THEN 0 ELSE 255 END AS v
    FROM tiled c JOIN otsu USING (grid_id, tx, ty) JOIN a ON a.grid_id = c.grid_id AND a.x = c.x AND a.y = c.y""",
)
register("a06_mean_gray", "cells", G.mean_gray, "SELECT grid_id, floor(avg(v))::INT AS mean FROM cells GROUP BY grid_id")


def _ladder(table: str) -> str:
    steps = G.GAMMA_STEPS[table]
    return "CASE " + " ".join(f"WHEN m < {b} THEN {g}::DOUBLE" for b, g in steps[:-1]) + f" ELSE {steps[-1][1]}::DOUBLE END"


register(
    "a07_gamma_for_mean", "cells", lambda d: G.mean_gray(d).select("grid_id", *[G.gamma_for_mean(F.col("mean"), t).alias(t) for t in G.GAMMA_STEPS]),
    ", a AS (SELECT grid_id, floor(avg(v))::INT AS m FROM cells GROUP BY grid_id) SELECT grid_id, " + ", ".join(f"{_ladder(t)} AS {t}" for t in G.GAMMA_STEPS) + " FROM a",
)
_LOW = "b AS (SELECT *, CASE WHEN v BETWEEN 20 AND 200 THEN v ELSE 100 END AS u FROM cells)"


def _middle(d: DataFrame) -> DataFrame:
    return d.withColumn("v", F.when(F.col("v").between(20, 200), F.col("v")).otherwise(100))


def stretch_sql(keys: str, source: str, v: str = "v") -> str:
    return f", s AS (SELECT *, min({v}) OVER w AS lo, max({v}) OVER w AS hi FROM {source} WINDOW w AS (PARTITION BY {keys})) SELECT {KEY}, (CASE WHEN hi = lo OR (lo = 0 AND hi = 255) THEN {v} ELSE 255 * ({v} - lo) // greatest(hi - lo, 1) END)::INT AS v FROM s"


register("a08_stretch_histogram", "cells", lambda d: G.stretch(_middle(d), ["grid_id"]), f", {_LOW}" + stretch_sql("grid_id", "b", "u"))
register(
    "a08_stretch_white_bias", "cells", lambda d: G.stretch(d, ["grid_id"], 200),
    f""", s AS (SELECT *, min(v) FILTER (v <= 200) OVER w AS lo, max(v) FILTER (v <= 200) OVER w AS hi FROM cells WINDOW w AS (PARTITION BY grid_id))
    SELECT {KEY}, (CASE WHEN v > 200 THEN 255 WHEN hi = lo OR (lo = 0 AND hi = 255) THEN v ELSE 255 * (v - lo) // greatest(hi - lo, 1) END)::INT AS v FROM s""",
)
register("a09_stretch_local", "cells", lambda d: G.stretch(G.tile(d, 4, 4), G.TILE), TILED + stretch_sql("grid_id, tx, ty", "tiled"))
register(
    "a10_dominant_bucket_gamma", "cells", G.dominant_bucket_gamma,
    f""", b AS (SELECT grid_id, v // 10 AS b, count(*) AS n FROM cells WHERE v <= 240 GROUP BY ALL),
    t AS (SELECT grid_id, b * 10 + 5 AS p FROM b QUALIFY row_number() OVER (PARTITION BY grid_id ORDER BY n DESC, b) = 1)
    SELECT {KEY}, CASE WHEN p IS NULL OR p > 180 OR v > 240 THEN v ELSE {gamma_sql('v', 'least(400::DOUBLE / p, 7::DOUBLE)')} END AS v FROM cells LEFT JOIN t USING (grid_id)""",
)
for _power, _cut in ((1, None), (2, None), (3, 200)):
    register(
        f"a11_global_gamma_{_power}" + "_skip_white" * bool(_cut), "cells", lambda d, p=_power, c=_cut: G.global_gamma(d, p, c),
        f""", m AS (SELECT grid_id, avg(v) FILTER (v < {_cut or 256}) AS m, count(*) FILTER (v < {_cut or 256}) AS n FROM cells GROUP BY grid_id)
        SELECT {KEY}, CASE WHEN n < 10 THEN v ELSE {ratio_sql('v', 'm', _power)} END AS v FROM cells JOIN m USING (grid_id)""",
    )
register(
    "a12_tile_background_normalise", "cells", lambda d: G.normalise_tiles(d, 4, 4),
    TILED + f""", t AS (SELECT grid_id, tx, ty, floor(avg(v)) AS m FROM tiled GROUP BY ALL), g AS (SELECT grid_id, floor(avg(v)) AS m FROM cells GROUP BY ALL)
    SELECT {KEY}, greatest(0, least(255, v + g.m - t.m))::INT AS v FROM tiled JOIN t USING (grid_id, tx, ty) JOIN g USING (grid_id)""",
)
register(
    "a13_tile_colour_peak", "colours", lambda d: G.tile_colour_peak(d, 30, 4, 4),
    f""", t AS (SELECT *, max(r) OVER w AS mr, max(g) OVER w AS mg, max(b) OVER w AS mb FROM colours WINDOW w AS (PARTITION BY grid_id, x // 4, y // 4))
    SELECT {KEY}, CASE WHEN r * 100 >= mr * 70 AND g * 100 >= mg * 70 AND b * 100 >= mb * 70 THEN 0 ELSE 255 END AS v FROM t""",
)
register(
    "a25_skew_angle", "cells", lambda d: G.skew_angle(d, tuple(range(-40, 41, 10))),
    """, r AS (SELECT grid_id, a::INT AS angle, floor(y + 0.5 - x * round(tan(radians(a::DOUBLE)), 9)) AS row, count(*) AS n FROM cells, range(-40, 41, 10) AS t(a) WHERE v < 128 GROUP BY ALL),
    s AS (SELECT grid_id, angle, sum(n * n)::BIGINT AS score FROM r GROUP BY ALL)
    SELECT grid_id, angle, score FROM s QUALIFY row_number() OVER (PARTITION BY grid_id ORDER BY score DESC, abs(angle), angle DESC) = 1""",
)

def _fold(period: int, source: str, name: str) -> str:
    return f""", {name} AS (SELECT grid_id, b, n, (2 * n // {period + 1})::BIGINT AS s FROM {source} WHERE b = 0
    UNION ALL SELECT h.grid_id, h.b, h.n, (({period - 1}) * p.s + 2 * h.n) // {period + 1} FROM {name} p JOIN {source} h ON h.grid_id = p.grid_id AND h.b = p.b + 1)"""


HIST = ", hist AS (SELECT g.grid_id, b::INT AS b, count(c.v) AS n FROM (SELECT DISTINCT grid_id FROM cells) g CROSS JOIN range(0, 256) AS r(b) LEFT JOIN cells c ON c.grid_id = g.grid_id AND c.v = b GROUP BY ALL)"
register(
    "w01_smooth_histogram", "cells", lambda d: G.smooth_histogram(d).select("grid_id", F.posexplode("s").alias("b", "s")),
    HIST + _fold(5, "hist", "e1") + ", h2 AS (SELECT grid_id, b, s AS n FROM e1)" + _fold(5, "h2", "e2") + " SELECT grid_id, b, s FROM e2",
)
# from a histogram of each grid to its cut
_VALLEY = HIST + _fold(3, "hist", "e1") + """, top AS (SELECT grid_id, b FROM e1 WHERE b < 225 QUALIFY row_number() OVER (PARTITION BY grid_id ORDER BY s DESC, b) <= 4),
    o AS (SELECT grid_id, list_sort(list(b)) AS t FROM top GROUP BY grid_id), g AS (SELECT grid_id, avg(v) AS m FROM cells GROUP BY grid_id),
    ab AS (SELECT grid_id, CASE WHEN m > 200 THEN t[2] ELSE t[1] END AS a, CASE WHEN m > 200 THEN t[3] ELSE t[2] END AS b FROM o JOIN g USING (grid_id)),
    f AS (SELECT ab.grid_id, e1.b FROM ab JOIN e1 ON e1.grid_id = ab.grid_id AND e1.b > ab.a AND e1.b < ab.b QUALIFY row_number() OVER (PARTITION BY ab.grid_id ORDER BY e1.s, e1.b) = 1)
    , cuts AS (SELECT ab.grid_id, ab.a, ab.b, coalesce(f.b, ab.a) AS cut FROM ab LEFT JOIN f USING (grid_id))"""
register("w02_valley_threshold", "cells", G.valley_threshold, _VALLEY + " SELECT grid_id, a, b, cut FROM cuts")
# W02 of each tile: its histogram under a name of its own
_TILES = ", strips AS (SELECT grid_id AS g, x, y, v, concat(grid_id, '/', x // 4, '/', y // 4) AS grid_id FROM cells)"
_CUBE = " * ".join(["(v / greatest(cut, 1)::DOUBLE)"] * 3)
register(
    "w03_thin_strip_gamma", "cells", lambda d: G.thin_strip_gamma(d, 4, 4),
    _TILES + _VALLEY.replace("cells", "strips") + f" SELECT g AS grid_id, x, y, {gamma_sql('v', f'least(6.95::DOUBLE, {_CUBE})')} AS v FROM strips JOIN cuts USING (grid_id)",
)
_SECOND = "list_transform(range(0, greatest(len(l) - 3, 0) + 1), lambda i: coalesce(l[i + 3] - 2 * l[i + 2] + l[i + 1], 0))"
for _name, _k, _from in (("", 3, "cells"), ("_wide", 9, "mosaic")):
    register(
        "w16_knee_base" + _name, _from, lambda d, k=_k: G.knee_base(d, k),
        f""", a AS (SELECT c.grid_id, c.x, c.y, c.v, list_sort(list(n.v)) AS l FROM {_from} c JOIN {_from} n ON n.grid_id = c.grid_id AND abs(n.x - c.x) <= {_k // 2} AND abs(n.y - c.y) <= {_k // 2} GROUP BY ALL)"""
        + f", d AS (SELECT *, {_SECOND} AS d FROM a), k AS (SELECT *, v / (l[least(list_position(d, list_max(d)) + 1, len(l) - 1) + 1] + 1.0::DOUBLE) AS q FROM d)"
        + ", r AS (SELECT *, CASE WHEN q > 1 THEN q + 0.1::DOUBLE ELSE greatest(q - 0.1::DOUBLE, 0::DOUBLE) END AS r FROM k)"
        + f" SELECT {KEY}, {gamma_sql('v', 'least(7::DOUBLE, r * r * r)')} AS v FROM r",
    )


def _filled(source: str, name: str, gap: int, white: bool, axis: str = "x") -> str:
    """W17 over gaps of one or two cells."""
    cmp, op = ("<", "greatest") if white else (">", "least")
    key = "y" if axis == "x" else "x"
    fill = lambda a, b: f"CASE WHEN {a} {cmp} 128 AND {b} {cmp} 128 THEN ({a} + {b}) // 2 END"
    best = fill("l1", "r1") if gap == 1 else f"{op}({fill('l1', 'r2')}, {fill('l2', 'r1')})"
    return f""", {name}0 AS (SELECT *, lag(v, 1) OVER o AS l1, lag(v, 2) OVER o AS l2, lead(v, 1) OVER o AS r1, lead(v, 2) OVER o AS r2 FROM {source} WINDOW o AS (PARTITION BY grid_id, {key} ORDER BY {axis})),
    {name} AS (SELECT {KEY}, coalesce({best}, v)::INT AS v FROM {name}0)"""


for _white in (False, True):
    for _axis in "xy":
        register(
            "w17_bridge_fill" + "_white" * _white + "_down" * (_axis == "y"), "cells", lambda d, w=_white, a=_axis: G.bridge_fill(d, 2, 128, w, a),
            _filled("cells", "f", 2, _white, _axis) + f" SELECT {KEY}, v FROM f",
        )
    register(
        "w17_bridge_fill_iterative" + "_white" * _white, "cells", lambda d, w=_white: G.bridge_fill(d, 2, 128, w, down_to=1),
        _filled("cells", "f", 2, _white) + _filled("f", "g", 1, _white) + f" SELECT {KEY}, v FROM g",
    )


def _lighten(source: str, name: str, key: str, order: str) -> str:
    return f""", {name}0 AS (SELECT grid_id, x, y, v, lag(v, 1) OVER o AS p1, lag(v, 2) OVER o AS p2, lead(v, 1) OVER o AS n1, lead(v, 2) OVER o AS n2 FROM {source} WINDOW o AS (PARTITION BY grid_id, {key} ORDER BY {order})),
    {name} AS (SELECT grid_id, x, y, CASE WHEN v > 16 AND ((p1 < 8 AND n1 < 8) OR (p1 < 8 AND n1 > 16 AND n2 < 8) OR (p2 < 8 AND p1 > 16 AND n1 < 8)) THEN 180 ELSE v END AS v FROM {name}0)"""


def _dark_sparse(d: DataFrame) -> DataFrame:
    return d.withColumn("v", F.when(F.col("v") % 3 == 0, F.col("v") % 8).otherwise(F.col("v")))


register(
    "w18_lighten_intermediates", "cells", lambda d: G.lighten_intermediates(_dark_sparse(d)),
    ", q AS (SELECT grid_id, x, y, CASE WHEN v % 3 = 0 THEN v % 8 ELSE v END AS v FROM cells)" + _lighten("q", "a", "y", "x") + _lighten("a", "b", "x", "y") + f" SELECT {KEY}, v FROM b",
)
register(
    "w19_whiten_long_runs", "cells", lambda d: G.whiten_long_runs(d, 5),
    f""", a AS (SELECT *, count(*) FILTER (v > 200) OVER w AS n, count(*) OVER w AS k FROM cells WINDOW w AS (PARTITION BY grid_id, y ORDER BY x RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
    b AS (SELECT *, bool_or(v < 128 AND n <= k * 0.1::DOUBLE) OVER (PARTITION BY grid_id, y ORDER BY x RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS hit FROM a)
    SELECT {KEY}, CASE WHEN hit THEN 255 ELSE v END AS v FROM b""",
)
