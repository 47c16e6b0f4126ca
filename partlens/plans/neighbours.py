"""Queries on neighbourhoods of cells; the SQL twins join each cell with its neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partlens.operators import bilateral as B
from partlens.operators import neighbours as N
from partlens.operators import regions as G

from .points import gamma_sql
from .registry import register

KEY = "grid_id, x, y"


def around(cols: str, kx: int = 3, ky: int = 3, source: str = "cells", name: str = "a") -> str:
    """CTE: aggregates of each cell's neighbourhood; c is the cell, n a neighbour."""
    return (
        f", {name} AS (SELECT c.grid_id, c.x, c.y, c.v, {cols} FROM {source} c JOIN {source} n ON n.grid_id = c.grid_id "
        f"AND abs(n.x - c.x) <= {kx // 2} AND abs(n.y - c.y) <= {ky // 2} GROUP BY c.grid_id, c.x, c.y, c.v)"
    )


def _query(name: str, run, ctes: str, v: str, source: str = "a") -> None:
    register(name, "cells", run, f"{ctes} SELECT {KEY}, CAST({v} AS INT) AS v FROM {source}")


def ratio_sql(v: str, base: str, power: int) -> str:
    r = f"({v} / greatest({base}::DOUBLE, 1::DOUBLE))"
    return gamma_sql(v, f"least(7::DOUBLE, {' * '.join([r] * power)})")


SUMS = "sum(n.v) AS s, count(*) AS n, floor(sum(n.v) / count(*)) AS m"
_query("n01_box_mean", lambda d: N.box_mean(d, 3, 5), around(SUMS, 3, 5), "m")
_query("n02_erode", lambda d: N.extreme(d, 3, 3), around("min(n.v) AS e"), "e")
_query("n02_dilate", lambda d: N.extreme(d, 3, 3, True), around("max(n.v) AS e"), "e")
_query("n03_open", lambda d: N.open_close(d, 3, 3), around("min(n.v) AS e") + ", b AS (SELECT grid_id, x, y, e AS v FROM a)" + around("max(n.v) AS f", source="b", name="o"), "f", "o")
_query("n03_close", lambda d: N.open_close(d, 3, 3, True), around("max(n.v) AS e") + ", b AS (SELECT grid_id, x, y, e AS v FROM a)" + around("min(n.v) AS f", source="b", name="o"), "f", "o")
_query("n04_filtered_erode", lambda d: N.filtered_extreme(d, 3, 3, 100), around("min(n.v) FILTER (n.v > 32) AS e"), "CASE WHEN v > 100 THEN coalesce(e, v) ELSE v END")
_query("n04_filtered_dilate", lambda d: N.filtered_extreme(d, 3, 3, 100, True, False), around("max(n.v) FILTER (n.v < 250) AS e"), "CASE WHEN v < 100 THEN coalesce(e, v) ELSE v END")


def ranked(p: int, values: str = "l") -> str:
    return f"greatest(1, {values}[least(len({values}) - 1, len({values}) * {p} // 100) + 1])"


LIST = "list_sort(list(n.v)) AS l"
_query("n05_rank_median", lambda d: N.rank_filter(d, 3, 3), around(LIST), ranked(50))
_query("n05_rank_80", lambda d: N.rank_filter(d, 5, 3, 80), around(LIST, 5, 3), ranked(80))
_query(
    "n06_local_contrast", lambda d: N.local_contrast(d, 3, 3),
    around(SUMS) + ", b AS (SELECT grid_id, x, y, m::INT AS v FROM a)" + around("min(n.v) AS lo, max(n.v) AS hi", source="b", name="o"),
    "floor(255 * (v - lo) / greatest(hi - lo, 1))", "o",
)
_query("n07_mean_gamma", lambda d: N.mean_gamma(d, 3, 3), around(SUMS), ratio_sql("v", "(s / 9)", 1))
_query("n07_mean_gamma_cubed", lambda d: N.mean_gamma(d, 3, 3, 3), around(SUMS), ratio_sql("v", "(s / 9)", 3))
_R = "least(1.999::DOUBLE, round(v::DOUBLE / base, 3))"
for _p in (20, 80):
    _query(
        f"n08_percentile_gamma_{_p}", lambda d, p=_p: N.percentile_gamma(d, 3, 3, p), around(LIST) + f", b AS (SELECT *, {ranked(_p)} AS base FROM a)",
        gamma_sql("v", f"least(7::DOUBLE, {_R} * {_R} * {_R})"), "b",
    )
_query("n08_percentile_binary", lambda d: N.percentile_gamma(d, 3, 3, 30, True), around(LIST) + f", b AS (SELECT *, {ranked(30)} AS base FROM a)", "CASE WHEN v >= base THEN 255 ELSE 0 END", "b")
_S = "least(1.999::DOUBLE, coalesce((v - lo)::DOUBLE / nullif((lo + (hi - lo) * 0.6::DOUBLE) - lo, 0), 1::DOUBLE))"
for _name, _black, _white in (("", -1, 256), ("_skip_white", -1, 240), ("_skip_both", 16, 240)):
    _query(
        "n09_scaled_gamma" + _name, lambda d, b=_black, w=_white: N.scaled_gamma(d, 3, 3, 0.6, b, w),
        around(f"min(n.v) FILTER (n.v > {_black} AND n.v < {_white}) AS lo, max(n.v) FILTER (n.v > {_black} AND n.v < {_white}) AS hi, count(*) FILTER (n.v > {_black} AND n.v < {_white}) AS n"),
        f"CASE WHEN v <= {_black} OR v >= {_white} OR n <= 2 THEN v ELSE {gamma_sql('v', f'least(7::DOUBLE, {_S} * {_S} * {_S})')} END",
    )
_query(
    "n10_mean_gamma_tolerant", lambda d: N.tolerant_gamma(d, 3, 3, 0.2), around(SUMS),
    f"CASE WHEN (v >= s / n * (1 - 0.2::DOUBLE) AND v <= s / n * (1 + 0.2::DOUBLE)) OR v > 242 OR v < 16 THEN v ELSE {ratio_sql('v', '(s / n)', 3)} END",
)
_query(
    "n11_average_skip_white", lambda d: N.skip_white_gamma(d, 3, 3, 200), around("coalesce(sum(n.v) FILTER (n.v < 200), 0) AS s, count(*) FILTER (n.v < 200) AS n"),
    f"CASE WHEN n < 5 THEN v ELSE {ratio_sql('v', '(s / n)', 2)} END",
)
_query(
    "n12_equalise_or_enhance", lambda d: N.equalise(d, 3, 3, 0.8, 1.2), around(SUMS),
    f"CASE WHEN coalesce(v / nullif(s / n, 0), 1) BETWEEN 0.8::DOUBLE AND 1.2::DOUBLE THEN floor((v + m) / 2) ELSE {ratio_sql('v', '(s / n)', 3)} END",
)
_K = "(CASE WHEN k > 1200 THEN k + 200 WHEN k < 800 THEN greatest(0, k - 200) ELSE k END / 1000.0::DOUBLE)"
_query("n13_mean_step_gamma", lambda d: N.step_gamma(d, 3, 3, 0.2), around(SUMS) + ", b AS (SELECT *, floor(v * 1000 / (m + 1)) AS k FROM a)", gamma_sql("v", f"least(7::DOUBLE, {_K} * {_K} * {_K})"), "b")
_U = "least(1.999::DOUBLE, round(u::DOUBLE / base, 3))"
_query(
    "n14_sigmoid_gamma", lambda d: N.sigmoid_gamma(d, 3, 3, 50, 0.1),
    around(LIST) + f""", b AS (SELECT *, {ranked(50)} AS base, greatest(8, least(32, {ranked(60)} - {ranked(40)})) AS w FROM a),
    u AS (SELECT *, floor(base + (v - base) * (1::DOUBLE / (1 + exp(-0.1::DOUBLE * (abs(v - base) - w)))) + 1e-6)::INT AS u FROM b)""",
    gamma_sql("u", f"least(7::DOUBLE, {_U} * {_U} * {_U})"), "u",
)
_W = "pow(2.0::DOUBLE - greatest(abs(n.x - c.x), abs(n.y - c.y)), 2)"
for _o in (-2, 2):
    _query(
        "n15_harmonic_mean" + ("_inverse" if _o < 0 else "_contra"), lambda d, o=_o: N.harmonic_mean(d, 3, 3, o, 2, 240),
        around(f"count(*) FILTER (n.v < 240) AS n, sum({_W} * pow(greatest(n.v, 1)::DOUBLE, {_o + 1})) FILTER (n.v < 240) AS num, sum({_W} * pow(greatest(n.v, 1)::DOUBLE, {_o})) FILTER (n.v < 240) AS den"),
        "CASE WHEN n < 5 THEN v ELSE greatest(0, least(255, floor(num / den + 1e-6))) END",
    )
SOBEL_SQL = {
    "vertical": "sign(n.x - c.x) * CASE WHEN n.y = c.y THEN 2 ELSE 1 END", "horizontal": "sign(n.y - c.y) * CASE WHEN n.x = c.x THEN 2 ELSE 1 END",
    "nesw": "sign(n.x - c.x + n.y - c.y) * 2", "nwse": "sign((n.x - c.x) - (n.y - c.y)) * 2",
}
_HELD = "greatest(0, least(255, {e}))::INT"
for _name, _w in SOBEL_SQL.items():
    _query(f"n16_sobel_{_name}", lambda d, k=_name: N.sobel(d, k), around(f"sum({_w} * n.v)::INT AS e"), f"{_HELD.format(e='e')} | {_HELD.format(e='-e')}")
_query("n17_laplacian_edges", lambda d: N.laplacian(d, 3, 3), around(SUMS), "greatest(0, least(255, n * v - s))")
_EDGES = ", ".join(f"abs(sum({w} * n.v))::INT AS e{i}" for i, w in enumerate(SOBEL_SQL.values()))
_query("n18_edge_composite", lambda d: N.composite_edges(d), around(_EDGES), "least(255, greatest(e0, e1, e2, e3))")
_query("n18_edge_composite_laplacian", lambda d: N.composite_edges(d, True), around(_EDGES + ", " + SUMS), "greatest(0, least(255, greatest(e0, e1, e2, e3, n * v - s)))")
_query(
    "n19_convolve", lambda d: N.convolve(d, [[0.0, 0.25, 0.0], [0.25, 0.5, 0.25], [0.0, -0.25, 0.0]]),
    around("sum(CASE WHEN n.x = c.x AND n.y = c.y THEN 0.5 WHEN n.x = c.x AND n.y = c.y + 1 THEN -0.25 WHEN abs(n.x - c.x) + abs(n.y - c.y) = 1 THEN 0.25 ELSE 0 END::DOUBLE * n.v) AS s"),
    "greatest(0, least(255, floor(s + 0.5 + 1e-9)))",
)
_GW = "exp(-((n.x - c.x) * (n.x - c.x) + (n.y - c.y) * (n.y - c.y)) / (2 * (2 / 3::DOUBLE) * (2 / 3::DOUBLE)))"
_G = f"floor(sum({_GW} * n.v) / sum({_GW}) + 0.5 + 1e-9)::INT AS g"
_query("n20_gaussian", lambda d: N.gaussian(d, 2), around(_G, 5, 5), "g")
_query("n20_unsharp", lambda d: N.gaussian(d, 2, 0.5, 3), around(_G, 5, 5), "CASE WHEN abs(v - g) >= 3 THEN greatest(0, least(255, floor(3::DOUBLE * (v - g) + g + 1e-9))) ELSE v END")
_query(
    "n21_edge_keeping_blur", lambda d: N.edge_keeping_blur(d, 2, 40),
    around(f"floor(sum({_GW} * n.v) FILTER (abs(n.v - c.v) <= 40) / sum({_GW}) FILTER (abs(n.v - c.v) <= 40) + 0.5 + 1e-9) AS g", 5, 5), "g",
)
_BW = "exp(-((n.x - c.x) * (n.x - c.x) + (n.y - c.y) * (n.y - c.y)) / 2::DOUBLE - (n.v - c.v) * (n.v - c.v) / 1800::DOUBLE)"
_query("n21_bilateral", lambda d: B.direct(d, 1, 30), around(f"floor(sum({_BW} * n.v) / sum({_BW}) + 0.5 + 1e-9) AS g", 7, 7), "g")


def _lattice_beside_direct(cells: DataFrame) -> DataFrame:
    """The grid form's cells that are within eight gray levels of the direct form, all of them, on grids of next to noise."""
    exact = B.direct(cells, 2, 40).select(*N.KEY, F.col("v").alias("w"))
    return B.by_lattice(cells, 2, 40).join(exact, N.KEY).groupBy("grid_id").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("v") - F.col("w")) <= 8).alias("near"))


register("n21_bilateral_lattice", "mosaic", _lattice_beside_direct, "SELECT grid_id, count(*) AS n, count(*) AS near FROM mosaic GROUP BY grid_id")
_query(
    "n22_sauvola_binarize", lambda d: N.sauvola(d, 5, 0.2),
    around("sum(n.v)::DOUBLE / count(*) AS m, sqrt(greatest(0::DOUBLE, sum(n.v * n.v)::DOUBLE / count(*) - (sum(n.v)::DOUBLE / count(*)) * (sum(n.v)::DOUBLE / count(*)))) AS sd", 5, 5),
    "CASE WHEN v <= round(m * (1 + 0.2::DOUBLE * (sd / 128 - 1)), 6) THEN 0 ELSE 255 END",
)
_query(
    "n23_kernel_background", lambda d: N.kernel_background(d, 5, 200),
    around(LIST + ", floor(sum(n.v)::DOUBLE / count(*)) AS m, count(*) FILTER (n.v >= 128) AS bright", 5, 5),
    f"CASE WHEN bright >= 8 AND {ranked(50)} <= m AND m <= {ranked(50)} + 5 AND m <= 200 AND v < m THEN 200 ELSE v END",
)
for _d, _on in (("E", "n.y = c.y AND n.x BETWEEN c.x - 2 AND c.x"), ("N", "n.x = c.x AND n.y BETWEEN c.y AND c.y + 2")):
    _query(
        f"n24_add_layer_{_d.lower()}", lambda d, w=_d: N.add_layer(d, 2, w, 100),
        f", a AS (SELECT c.grid_id, c.x, c.y, least(c.v, coalesce(min(n.v) FILTER (n.v < 100), c.v)) AS e FROM cells c JOIN cells n ON n.grid_id = c.grid_id AND {_on} GROUP BY c.grid_id, c.x, c.y, c.v)", "e",
    )
_query(
    "n25_drop_diagonals", lambda d: N.drop_diagonals(d, 3),
    around("coalesce(bool_and(n.v >= 128) FILTER (n.x - c.x = n.y - c.y AND n.x <> c.x), false) AS p, coalesce(bool_and(n.v >= 128) FILTER (n.x - c.x = c.y - n.y AND n.x <> c.x), false) AS q"),
    "CASE WHEN v < 128 AND (p OR q) THEN 255 ELSE v END",
)
for _axis, _o in (("y", "x"), ("x", "y")):
    _query(
        f"n27_lighten_centre_{_axis}", lambda d, a=_axis: N.lighten_centre(d, 5, a),
        f", a AS (SELECT c.grid_id, c.x, c.y, c.v, avg(n.v) FILTER (n.{_axis} < c.{_axis}) AS p, avg(n.v) FILTER (n.{_axis} > c.{_axis}) AS q FROM cells c "
        f"JOIN cells n ON n.grid_id = c.grid_id AND n.{_o} = c.{_o} AND abs(n.{_axis} - c.{_axis}) <= 2 GROUP BY c.grid_id, c.x, c.y, c.v)",
        f"CASE WHEN v > p AND v > q THEN {ratio_sql('v', 'least(p, q)', 3)} ELSE v END",
    )


def clear_sql(kx: int, source: str, name: str, ky: int | None = None) -> str:
    ky = ky or kx
    x0, x1, y0, y1 = -((kx - 1) // 2), kx // 2, -((ky - 1) // 2), ky // 2
    return f""", {name}0 AS (SELECT c.grid_id, c.x, c.y, c.v, count(*) = {kx * ky} AND bool_and(n.v >= 128) FILTER (n.x - c.x IN ({x0}, {x1}) OR n.y - c.y IN ({y0}, {y1})) AS clear
      FROM {source} c JOIN {source} n ON n.grid_id = c.grid_id AND n.x - c.x BETWEEN {x0} AND {x1} AND n.y - c.y BETWEEN {y0} AND {y1} GROUP BY c.grid_id, c.x, c.y, c.v),
    {name}1 AS (SELECT s.grid_id, s.x + i AS x, s.y + j AS y FROM {name}0 s, range({x0 + 1}, {x1}) AS a(i), range({y0 + 1}, {y1}) AS b(j) WHERE s.clear),
    {name} AS (SELECT c.grid_id, c.x, c.y, CASE WHEN EXISTS (SELECT 1 FROM {name}1 t WHERE t.grid_id = c.grid_id AND t.x = c.x AND t.y = c.y) THEN 255 ELSE c.v END AS v FROM {source} c)"""


def bridges_sql(source: str, name: str) -> str:
    return f""", {name}0 AS (SELECT c.grid_id, c.x, c.y, c.v, coalesce(c.v >= 128 AND e.v < 128 AND s.v < 128 AND z.v >= 128, false) AS hit FROM {source} c
    LEFT JOIN {source} e ON e.grid_id = c.grid_id AND e.x = c.x + 1 AND e.y = c.y LEFT JOIN {source} s ON s.grid_id = c.grid_id AND s.x = c.x AND s.y = c.y + 1
    LEFT JOIN {source} z ON z.grid_id = c.grid_id AND z.x = c.x + 1 AND z.y = c.y + 1), {name} AS (SELECT grid_id, x, y, CASE WHEN hit THEN 0 ELSE v END AS v FROM {name}0)"""


_query("n26_join_bridges", N.join_bridges, bridges_sql("cells", "j"), "v", "j")
_query("n28_clear_small_trails", lambda d: N.clear_trails(d, 3), clear_sql(3, "cells", "t"), "v", "t")
_query("n28_clear_small_trails_oblong", lambda d: N.clear_trails(d, 3, 5), clear_sql(3, "cells", "t", 5), "v", "t")
_query("n29_salt_pepper", N.salt_pepper, clear_sql(3, "cells", "t") + clear_sql(4, "t", "s") + clear_sql(5, "s", "r") + clear_sql(7, "r", "u"), "v", "u")


def _masked_gamma(cells: DataFrame) -> DataFrame:
    """Tones by rank, cut, thickened into a mask, and local tones under the mask only."""
    mask = N.extreme(N.out(N.percentile_gamma(cells, 3, 3, 50), F.when(F.col("v") < 128, 0).otherwise(255)), 3, 3)
    return N.scaled_gamma(G.mask_cells(cells, mask), 3, 3, 0.6)


_RANK = around(LIST) + f", p AS (SELECT *, {ranked(50)} AS base FROM a)" + f", q AS (SELECT grid_id, x, y, CASE WHEN {gamma_sql('v', f'least(7::DOUBLE, {_R} * {_R} * {_R})')} < 128 THEN 0 ELSE 255 END AS v FROM p)"
_query(
    "n30_masked_gamma", _masked_gamma,
    _RANK + around("min(n.v) AS e", source="q", name="mask")
    + ", shown AS (SELECT c.grid_id, c.x, c.y, CASE WHEN mask.e < 128 THEN c.v ELSE 255 END AS v FROM cells c JOIN mask USING (grid_id, x, y))"
    + around("min(n.v) AS lo, max(n.v) AS hi, count(*) AS n", source="shown", name="o"),
    f"CASE WHEN n <= 2 THEN v ELSE {gamma_sql('v', f'least(7::DOUBLE, {_S} * {_S} * {_S})')} END", "o",
)


def _ring_sql(side: int, mark: int, ratio: float, source: str, skip: str = "false") -> str:
    """Each ring's cells listed by their distance from the centre."""
    r = side // 2
    far = "greatest(abs(n.x - c.x), abs(n.y - c.y))"
    ring = {"rim": f"{far} > {r - 2}", "next_rim": f"{far} > {r - 4} AND {far} <= {r - 2}", "rims": f"{far} > {r - 4}", "inside": f"{far} <= {r - 4}"}
    avgs = ", ".join(f"sum(n.v) FILTER ({w})::DOUBLE / count(*) FILTER ({w})::DOUBLE AS {k}" for k, w in ring.items())
    return f""", seen AS (SELECT c.grid_id, c.x, c.y, count(*) AS cells, count(*) FILTER (n.v = {mark} OR n.v = 255) AS barred, {avgs}, {ratio}::DOUBLE * sum(n.v) FILTER ({ring['inside']})::DOUBLE / count(*) FILTER ({ring['inside']})::DOUBLE AS bound
      FROM {source} c JOIN {source} n ON n.grid_id = c.grid_id AND abs(n.x - c.x) <= {r} AND abs(n.y - c.y) <= {r} WHERE NOT ({skip}) GROUP BY c.grid_id, c.x, c.y),
    hit AS (SELECT * FROM seen WHERE cells = {side * side} AND barred = 0 AND (rim > bound OR next_rim > bound OR rims > bound)),
    marked AS (SELECT DISTINCT c.grid_id, c.x, c.y FROM {source} c JOIN hit h ON h.grid_id = c.grid_id AND abs(h.x - c.x) <= {r - 4} AND abs(h.y - c.y) <= {r - 4})
    SELECT c.grid_id, c.x, c.y, CASE WHEN m.x IS NULL THEN c.v ELSE {mark} END AS v FROM {source} c LEFT JOIN marked m USING (grid_id, x, y)"""


def _shaded(d: DataFrame) -> DataFrame:
    """Nothing white, and a dark disc around every centre of 16 by 16 cells."""
    dx, dy = F.col("x") % 16 - 8, F.col("y") % 16 - 8
    return d.select("grid_id", "x", "y", F.when(dx * dx + dy * dy <= 5, F.col("v") % 64 + 20).otherwise(F.col("v") % 128 + 100).alias("v"))


SHADED = """, shaded AS (SELECT grid_id, x, y, CASE WHEN (x % 16 - 8) * (x % 16 - 8) + (y % 16 - 8) * (y % 16 - 8) <= 5 THEN v % 64 + 20 ELSE v % 128 + 100 END AS v FROM mosaic)"""


def _tinted(d: DataFrame) -> DataFrame:
    """Colours whose first channel is the shade and whose green grows with x."""
    return _shaded(d).select("*", F.col("v").alias("r"), F.least(F.lit(255), F.col("v") + F.col("x")).alias("g"), F.col("v").alias("b"))


# side x mark x ratio; the least side and the greatest mark are held
register("n31_ring_detector", "mosaic", lambda d: N.ring_detector(_shaded(d), 9, 12, 1.5), SHADED + _ring_sql(11, 8, 1.5, "shaded"))
register("n31_ring_detector_wide", "mosaic", lambda d: N.ring_detector(_shaded(d), 14, 0, 1.25), SHADED + _ring_sql(15, 0, 1.25, "shaded"))
register("n31_ring_detector_raw", "mosaic", lambda d: N.ring_detector(d, 11, 8, 1.3), _ring_sql(11, 8, 1.3, "mosaic"))
register(
    "n31_ring_detector_colour", "mosaic", lambda d: N.ring_detector(_tinted(d), 11, 8, 1.5, N.greenish(F.col("r"), F.col("g"), F.col("b"))),
    SHADED + _ring_sql(11, 8, 1.5, "shaded", "c.v <= least(255, c.v + c.x) + 20 AND least(255, c.v + c.x) - c.v >= 30"),
)
# large neighbourhoods: sums by prefix sums, ranks by histograms
register("n01_box_mean_wide", "mosaic", lambda d: N.box_mean(d, 29, 13), around(SUMS, 29, 13, "mosaic") + f" SELECT {KEY}, CAST(m AS INT) AS v FROM a")
register("n05_rank_median_wide", "mosaic", lambda d: N.rank_filter(d, 9, 9), around(LIST, 9, 9, "mosaic") + f" SELECT {KEY}, CAST({ranked(50)} AS INT) AS v FROM a")
register("n05_rank_95_wide", "mosaic", lambda d: N.rank_filter(d, 15, 9, 95), around(LIST, 15, 9, "mosaic") + f" SELECT {KEY}, CAST({ranked(95)} AS INT) AS v FROM a")
register(
    "n08_percentile_gamma_wide", "mosaic", lambda d: N.percentile_gamma(d, 9, 9, 80),
    around(LIST, 9, 9, "mosaic") + f", b AS (SELECT *, {ranked(80)} AS base FROM a) SELECT {KEY}, CAST({gamma_sql('v', f'least(7::DOUBLE, {_R} * {_R} * {_R})')} AS INT) AS v FROM b",
)
register("n22_sauvola_wide", "mosaic", lambda d: N.sauvola(d, 15, 0.2), around(
    "sum(n.v)::DOUBLE / count(*) AS m, sqrt(greatest(0::DOUBLE, sum(n.v * n.v)::DOUBLE / count(*) - (sum(n.v)::DOUBLE / count(*)) * (sum(n.v)::DOUBLE / count(*)))) AS sd", 15, 15, "mosaic",
) + f" SELECT {KEY}, CASE WHEN v <= round(m * (1 + 0.2::DOUBLE * (sd / 128 - 1)), 6) THEN 0 ELSE 255 END AS v FROM a")
