"""Queries on character boxes and text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partlens.operators import boxes as B

from .registry import register

ALL = "grid_id, line_id, box_id, x, y, w, h"
AREA = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"


def _boxes(df: DataFrame) -> DataFrame:
    return df.select("grid_id", "line_id", "box_id", "x", "y", "w", "h")


register(
    "j02_box_overlap", "boxes", B.box_overlap,
    f", p AS (SELECT a.grid_id, a.line_id, a.box_id AS a_id, b.box_id AS b_id, {AREA} AS area FROM boxes a JOIN boxes b ON a.grid_id = b.grid_id AND a.line_id = b.line_id AND a.box_id < b.box_id) SELECT * FROM p WHERE area > 0",
)
register(
    "j03_interval_overlap", "boxes", B.interval_overlap,
    """, p AS (SELECT *, lag(y) OVER o AS py, lag(h) OVER o AS ph FROM boxes WINDOW o AS (PARTITION BY grid_id, line_id ORDER BY x, box_id)),
    q AS (SELECT *, greatest(0, least(y + h, py + ph) - greatest(y, py)) AS c FROM p WHERE py IS NOT NULL)
    SELECT grid_id, line_id, box_id, c AS overlap, round(greatest(c / h, c / ph), 9) AS share FROM q""",
)


def drop_sql(source: str, name: str, limit: str) -> str:
    return f""", {name}_p AS (SELECT a.grid_id, a.box_id AS p, b.box_id AS q FROM {source} a JOIN {source} b ON a.grid_id = b.grid_id AND a.line_id = b.line_id AND a.box_id < b.box_id WHERE {AREA} > {limit}),
    {name} AS (SELECT * FROM {source} s WHERE NOT EXISTS (SELECT 1 FROM {name}_p t WHERE t.grid_id = s.grid_id AND (t.p = s.box_id OR t.q = s.box_id)))"""


register("j04_drop_overlapping_boxes", "boxes", lambda d: _boxes(B.drop_overlapping(d, 60)), drop_sql("boxes", "d", "60") + f" SELECT {ALL} FROM d")


def lines_sql(tolerance: int, name: str = "ln") -> str:
    return f""", {name}_0 AS (SELECT *, CASE WHEN y - coalesce(lag(y) OVER (PARTITION BY grid_id ORDER BY y, x, box_id), -1000000) > {tolerance} THEN 1 ELSE 0 END AS s FROM boxes),
    {name} AS (SELECT *, sum(s) OVER (PARTITION BY grid_id ORDER BY y, x, box_id ROWS UNBOUNDED PRECEDING)::BIGINT AS line FROM {name}_0)"""


register("j05_boxes_to_lines", "boxes", lambda d: B.boxes_to_lines(d).select("grid_id", "box_id", "line"), lines_sql(10) + " SELECT grid_id, box_id, line FROM ln")


def _scattered(d: DataFrame) -> DataFrame:
    """Every fourth box as a line of its own."""
    return d.withColumn("line_id", F.when(F.col("box_id") % 4 == 0, F.col("box_id")).otherwise(F.col("line_id")))


register(
    "j06_attach_lone_boxes", "boxes", lambda d: _boxes(B.attach_lone_boxes(_scattered(d))),
    f""", s AS (SELECT grid_id, CASE WHEN box_id % 4 = 0 THEN box_id ELSE line_id END AS line_id, box_id, x, y, w, h FROM boxes),
    st AS (SELECT grid_id, line_id, count(*) AS n, min(x) AS lx, max(x + w) AS rx, floor(avg(y))::INT AS my FROM s GROUP BY ALL),
    j AS (SELECT b.grid_id, b.box_id, l.line_id, greatest(0, l.lx - (b.x + b.w), b.x - l.rx) AS gap FROM s b JOIN st o ON o.grid_id = b.grid_id AND o.line_id = b.line_id AND o.n = 1
      JOIN st l ON l.grid_id = b.grid_id AND l.n > 1 WHERE abs(b.y - l.my) * 2 <= b.h AND greatest(0, l.lx - (b.x + b.w), b.x - l.rx) * 2 < b.w * 5),
    t AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY grid_id, box_id ORDER BY gap, line_id) = 1)
    SELECT s.grid_id, coalesce(t.line_id, s.line_id) AS line_id, s.box_id, x, y, w, h FROM s LEFT JOIN t ON t.grid_id = s.grid_id AND t.box_id = s.box_id""",
)


def _pct(p: str) -> str:
    pos = f"({p}::DOUBLE * (len(a) + 1))"
    return f"round(CASE WHEN {pos} < 1 THEN a[1] WHEN {pos} >= len(a) THEN a[len(a)] ELSE a[floor({pos})::INT] + ({pos} - floor({pos})) * (a[least(floor({pos})::INT + 1, len(a))] - a[floor({pos})::INT]) END, 6)"


register(
    "a14_box_stats", "boxes", B.box_stats,
    f", g AS (SELECT grid_id, line_id, round(avg(h), 6) AS mean, round(stddev_samp(h), 6) AS sd, list_sort(list(h)) AS a FROM boxes GROUP BY ALL) SELECT grid_id, line_id, mean, sd, {_pct('0.5')} AS p50, {_pct('0.55')} AS p55, {_pct('0.9')} AS p90 FROM g",
)
register(
    "a15_modal_size", "boxes", B.modal_size,
    """, s AS (SELECT grid_id, (CASE WHEN count(*) <= 8 THEN 3 ELSE greatest(2, least(9, floor(round(0.9::DOUBLE * coalesce(stddev_samp(h), 0) * pow(count(*)::DOUBLE, -0.2), 6)))) END)::INT AS width FROM boxes GROUP BY grid_id),
    b AS (SELECT grid_id, width, h // width AS b, count(*) AS c FROM boxes JOIN s USING (grid_id) GROUP BY ALL),
    n AS (SELECT m.grid_id, m.width, m.b, m.c, coalesce(l.c, 0) AS lc, coalesce(r.c, 0) AS rc FROM b m LEFT JOIN b l ON l.grid_id = m.grid_id AND l.b = m.b - 1 LEFT JOIN b r ON r.grid_id = m.grid_id AND r.b = m.b + 1),
    t AS (SELECT *, CASE WHEN rc > lc THEN b + 1 ELSE b - 1 END AS o, greatest(lc, rc) AS oc FROM n QUALIFY row_number() OVER (PARTITION BY grid_id ORDER BY lc + c + rc DESC, b) = 1)
    SELECT grid_id, width, b::INT AS bin, round(((b * width + width / 2) * c + (o * width + width / 2) * oc) / (c + oc), 6) AS size FROM t""",
)
ENV = "SELECT grid_id, line_id, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*) AS n FROM {s} GROUP BY grid_id, line_id"
register("a23_line_envelope", "boxes", B.line_envelope, ENV.format(s="boxes"))
register("a24_drop_short_lines", "boxes", lambda d: _boxes(B.drop_short_lines(d, 6)), f"SELECT {ALL} FROM boxes QUALIFY count(*) OVER (PARTITION BY grid_id, line_id) >= 6")


def split_sql(source: str, name: str, gap: str) -> str:
    return f""", {name}_0 AS (SELECT *, CASE WHEN x - lag(x + w) OVER (PARTITION BY grid_id, line_id ORDER BY x, box_id) > {gap} THEN 1 ELSE 0 END AS g FROM {source}),
    {name} AS (SELECT * EXCLUDE (g), (sum(g) OVER (PARTITION BY grid_id, line_id ORDER BY x, box_id ROWS UNBOUNDED PRECEDING) + 1)::INT AS seg FROM {name}_0)"""


register("w04_split_lines_by_gap", "boxes", lambda d: B.split_by_gap(d, 30).select("grid_id", "box_id", "seg"), split_sql("boxes", "s", "30") + " SELECT grid_id, box_id, seg FROM s")


def merge_sql(source: str, name: str, ratio: float) -> str:
    return f""", {name}_l AS (SELECT grid_id, line_id, min(y) AS top, arg_min(y, x * 1e15 + box_id) AS fy, arg_min(h, x * 1e15 + box_id) AS fh, arg_max(y, x * 1e15 + box_id) AS ly, arg_max(h, x * 1e15 + box_id) AS lh FROM {source} GROUP BY grid_id, line_id),
    {name}_p AS (SELECT *, lag(ly) OVER o AS py, lag(lh) OVER o AS ph FROM {name}_l WINDOW o AS (PARTITION BY grid_id ORDER BY top, line_id)),
    {name}_i AS (SELECT *, sum(CASE WHEN py IS NULL OR least(fy + fh, py + ph) - greatest(fy, py) <= {ratio}::DOUBLE * (fh + ph) / 2 THEN 1 ELSE 0 END) OVER (PARTITION BY grid_id ORDER BY top, line_id ROWS UNBOUNDED PRECEDING) AS isle FROM {name}_p),
    {name}_t AS (SELECT grid_id, line_id, first_value(line_id) OVER (PARTITION BY grid_id, isle ORDER BY top, line_id) AS t FROM {name}_i),
    {name} AS (SELECT b.grid_id, t.t AS line_id, b.box_id, b.x, b.y, b.w, b.h FROM {source} b JOIN {name}_t t ON b.grid_id = t.grid_id AND b.line_id = t.line_id)"""


def _halves(d: DataFrame) -> DataFrame:
    """Each line in two, so that there is something to merge."""
    return d.withColumn("line_id", F.col("line_id") * 2 + (F.col("x") >= 200).cast("long"))


HALVES = ", hv AS (SELECT grid_id, line_id * 2 + (x >= 200)::BIGINT AS line_id, box_id, x, y, w, h FROM boxes)"
register("w05_merge_lines_by_y", "boxes", lambda d: _boxes(B.merge_by_y(_halves(d), 0.375)), HALVES + merge_sql("hv", "m", 0.375) + f" SELECT {ALL} FROM m")
register(
    "w06_reading_order", "boxes", lambda d: B.reading_order(d).select("grid_id", "box_id", "line_no", "nth"),
    """, f AS (SELECT grid_id, line_id, arg_min(y, x * 1e15 + box_id) AS fy, arg_min(x, x * 1e15 + box_id) AS fx FROM boxes GROUP BY ALL),
    l AS (SELECT grid_id, line_id, row_number() OVER (PARTITION BY grid_id ORDER BY fy // 10, fx, line_id)::INT AS line_no FROM f)
    SELECT b.grid_id, box_id, line_no, row_number() OVER (PARTITION BY b.grid_id, b.line_id ORDER BY x, box_id)::INT AS nth FROM boxes b JOIN l ON l.grid_id = b.grid_id AND l.line_id = b.line_id""",
)


def wrong_y_sql(source: str, name: str) -> str:
    return f""", {name}_h AS (SELECT *, median(h) OVER (PARTITION BY grid_id, line_id) AS mh FROM {source}),
    {name}_y AS (SELECT *, median(CASE WHEN abs(h - mh) <= mh / 2 THEN y END) OVER (PARTITION BY grid_id, line_id) AS my FROM {name}_h),
    {name} AS (SELECT {ALL} FROM {name}_y WHERE abs(y - my) < mh * 0.4::DOUBLE)"""


def _tilted(d: DataFrame) -> DataFrame:
    return d.withColumn("y", F.col("y") + (F.col("box_id") % 7 * 4).cast("int"))


register("w07_drop_wrong_y", "boxes", lambda d: _boxes(B.drop_wrong_y(_tilted(d))), ", q AS (SELECT grid_id, line_id, box_id, x, (y + box_id % 7 * 4)::INT AS y, w, h FROM boxes)" + wrong_y_sql("q", "k") + f" SELECT {ALL} FROM k")
register(
    "w08_default_boxes", "boxes", lambda d: _boxes(B.default_boxes(d, 18, 13)),
    f", m AS (SELECT *, median(h) OVER (PARTITION BY grid_id) AS mh FROM boxes WHERE h > 18 AND w > 13) SELECT {ALL} FROM m WHERE h > mh * 0.7::DOUBLE",
)
register("w09_drop_odd_sizes", "boxes", lambda d: _boxes(B.drop_odd_sizes(d, 20, 18)), f"SELECT {ALL} FROM boxes WHERE w <= 18 AND h >= 20")
register(
    "w10_two_lines", "boxes", lambda d: B.two_lines(d).select("grid_id", "box_id", "line"),
    """, p AS (SELECT *, lag(y) OVER o AS py, lag(h) OVER o AS ph FROM boxes WINDOW o AS (PARTITION BY grid_id ORDER BY y + h, box_id)),
    q AS (SELECT *, greatest(0, least(y + h, py + ph) - greatest(y, py)) AS c FROM p),
    s AS (SELECT *, sum(CASE WHEN py IS NULL OR greatest(c / h, c / ph) <= 0.4 THEN 1 ELSE 0 END) OVER (PARTITION BY grid_id ORDER BY y + h, box_id ROWS UNBOUNDED PRECEDING)::INT AS line FROM q)
    SELECT grid_id, box_id, CASE WHEN line <= 2 THEN line END AS line FROM s""",
)
register(
    "w12_longest_line", "boxes", lambda d: _boxes(B.longest_line(d)),
    f", n AS (SELECT grid_id, line_id FROM boxes GROUP BY grid_id, line_id QUALIFY row_number() OVER (PARTITION BY grid_id ORDER BY count(*) DESC, line_id) = 1) SELECT {ALL} FROM boxes JOIN n USING (grid_id, line_id)",
)
register(
    "w22_order_and_arrange", "boxes", lambda d: B.order_and_arrange(d, 20),
    lines_sql(5) + ", lb AS (SELECT grid_id, line AS line_id, box_id, x, y, w, h FROM ln)" + split_sql("lb", "s", "(0.8::DOUBLE * 20 * 2.75 - 1e-9)")
    + """, p AS (SELECT *, CASE WHEN x - lag(x) OVER o <= 4 THEN 0 ELSE 1 END AS a FROM s WINDOW o AS (PARTITION BY grid_id, line_id, seg ORDER BY x, box_id)),
    q AS (SELECT *, sum(a) OVER (PARTITION BY grid_id, line_id, seg ORDER BY x, box_id ROWS UNBOUNDED PRECEDING)::INT AS nth FROM p)
    SELECT grid_id, line_id, seg, nth, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM q GROUP BY grid_id, line_id, seg, nth""",
)


def close_sql(source: str, name: str, share: float, gap: float) -> str:
    return f""", {name}_e AS ({ENV.format(s=source)}),
    {name}_p AS (SELECT *, lag(y) OVER o AS py, lag(h) OVER o AS ph, lag(x) OVER o AS px, lag(w) OVER o AS pw FROM {name}_e WINDOW o AS (PARTITION BY grid_id ORDER BY y, x, line_id)),
    {name}_i AS (SELECT *, sum(CASE WHEN least(y + h, py + ph) - greatest(y, py) > {share}::DOUBLE * least(h, ph) AND greatest(0, x - (px + pw), px - (x + w)) < {gap}::DOUBLE * (h + ph) / 2 THEN 0 ELSE 1 END)
      OVER (PARTITION BY grid_id ORDER BY y, x, line_id ROWS UNBOUNDED PRECEDING) AS isle FROM {name}_p),
    {name} AS (SELECT grid_id, line_id, first_value(line_id) OVER (PARTITION BY grid_id, isle ORDER BY y, x, line_id) AS t FROM {name}_i)"""


for _id, _share, _gap in (("w11_reallocate_lines", 0.375, 2.75), ("w23_reallocate_again", 0.7, 4.0)):
    register(
        _id, "boxes", lambda d, s=_share, g=_gap: _boxes(B.merge_close_lines(_halves(d), s, g)),
        HALVES + close_sql("hv", "c", _share, _gap) + " SELECT b.grid_id, c.t AS line_id, box_id, x, y, w, h FROM hv b JOIN c ON c.grid_id = b.grid_id AND c.line_id = b.line_id",
    )
register(
    "w23_split_wide_gaps", "boxes", lambda d: B.split_wide_gaps(d, 5, 1.5).select("grid_id", "box_id", "seg"),
    """, m AS (SELECT *, median(h) OVER o AS mh, count(*) OVER o AS n, x - lag(x + w) OVER (PARTITION BY grid_id, line_id ORDER BY x, box_id) AS gap FROM boxes WINDOW o AS (PARTITION BY grid_id, line_id))
    SELECT grid_id, box_id, (sum(CASE WHEN gap > mh * 1.5::DOUBLE AND n >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY grid_id, line_id ORDER BY x, box_id ROWS UNBOUNDED PRECEDING) + 1)::INT AS seg FROM m""",
)
register(
    "w24_drop_stub_lines", "boxes", lambda d: _boxes(B.drop_stubs(_scattered(d), 10, 44)),
    f""", s AS (SELECT grid_id, CASE WHEN box_id % 4 = 0 THEN box_id ELSE line_id END AS line_id, box_id, x, y, w, h FROM boxes),
    k AS (SELECT grid_id, line_id FROM s GROUP BY ALL HAVING NOT ((count(*) <= 2 AND round(sum(w) / 10) <= 2) OR (count(*) = 1 AND (max(w) <= 3 OR max(h) <= 0.45::DOUBLE * 44))))
    SELECT {ALL} FROM s JOIN k USING (grid_id, line_id)""",
)
def fit_sql(source: str, p: tuple[int, int, int, int]) -> str:
    """W25 for boxes without a grid of four lines, and for those with one."""
    return f""", m AS (SELECT *, y + h AS bottom, median(h) OVER g AS mh, median(w) OVER g AS mw, median(h) OVER g * 2 / 3 + 2 AS tol FROM {source} WINDOW g AS (PARTITION BY grid_id)),
    gl AS (SELECT grid_id, count(DISTINCT line_id) AS given FROM {source} GROUP BY grid_id),
    todo AS (SELECT m.* FROM m JOIN gl USING (grid_id) WHERE given <> 4),
    b AS (SELECT grid_id, tol, floor(bottom / (mh * 2 / 3) + 1e-9) AS b, count(*) AS n, avg(bottom) AS mid FROM todo GROUP BY ALL),
    one AS (SELECT grid_id, mid AS first FROM b QUALIFY row_number() OVER (PARTITION BY grid_id ORDER BY n DESC, b) = 1),
    two AS (SELECT b.grid_id, mid AS second FROM b JOIN one USING (grid_id) WHERE abs(mid - first) > tol QUALIFY row_number() OVER (PARTITION BY b.grid_id ORDER BY n DESC, b) = 1),
    ends AS (SELECT grid_id, CASE WHEN second < first THEN second ELSE first END AS up, CASE WHEN second < first THEN first ELSE second END AS low FROM one LEFT JOIN two USING (grid_id)),
    near AS (SELECT todo.*, CASE WHEN abs(bottom - low) < abs(bottom - up) THEN 2 ELSE 1 END AS line, least(abs(bottom - up), abs(bottom - low)) AS away FROM todo JOIN ends USING (grid_id)),
    own AS (SELECT *, count(*) FILTER (away <= tol) OVER (PARTITION BY grid_id, line) AS n_own, CASE WHEN line = 1 THEN {p[0] + p[1]} ELSE {p[2] + p[3]} END AS want FROM near),
    took AS (SELECT * FROM own WHERE away <= tol UNION ALL
      SELECT * FROM (SELECT * FROM own WHERE away > tol AND away < mh) q QUALIFY row_number() OVER (PARTITION BY grid_id, line ORDER BY away, x, box_id) <= want - n_own),
    x0 AS (SELECT *, row_number() OVER o AS nth, count(*) OVER (PARTITION BY grid_id, line) AS n, x - lag(x + w) OVER o AS gap FROM took WINDOW o AS (PARTITION BY grid_id, line ORDER BY x, box_id)),
    cut AS (SELECT grid_id, line, nth AS cut_at FROM x0 WHERE gap >= mw * 2.25 QUALIFY row_number() OVER (PARTITION BY grid_id, line ORDER BY gap DESC, nth) = 1),
    cols AS (SELECT x0.*, CASE WHEN nth < CASE WHEN n = want THEN CASE WHEN line = 1 THEN {p[0]} ELSE {p[2]} END + 1 ELSE coalesce(cut.cut_at, n - CASE WHEN line = 1 THEN {p[1]} ELSE {p[3]} END + 1) END THEN 1 ELSE 2 END AS col
      FROM x0 LEFT JOIN cut USING (grid_id, line)),
    fit AS (SELECT grid_id, box_id, line, col FROM cols QUALIFY count(*) OVER (PARTITION BY grid_id, line, col) > 1),
    tops AS (SELECT grid_id, line_id, row_number() OVER (PARTITION BY grid_id ORDER BY min(y), line_id)::INT AS line FROM {source} JOIN gl USING (grid_id) WHERE given = 4 GROUP BY grid_id, line_id)
    SELECT grid_id, box_id, line, col FROM fit UNION ALL SELECT s.grid_id, box_id, tops.line, 1 FROM {source} s JOIN tops ON tops.grid_id = s.grid_id AND tops.line_id = s.line_id"""


def _uneven(d: DataFrame) -> DataFrame:
    """Boxes of every seventh grid in four lines, those of others moved up or down beyond a line's tolerance here and there."""
    d = d.withColumn("line_id", F.when((F.col("grid_id") % 7 == 0) & (F.col("box_id") % 4 == 0), 3).otherwise(F.col("line_id")))
    return d.withColumn("y", (F.col("y") + F.when(F.col("box_id") % 5 == 0, 17).otherwise(0)).cast("int"))


register(
    "w25_fit_two_by_two", "boxes", lambda d: B.fit_two_by_two(_uneven(d), (3, 4, 2, 5)).select("grid_id", "box_id", "line", "col"),
    """, uneven AS (SELECT grid_id, CASE WHEN grid_id % 7 = 0 AND box_id % 4 = 0 THEN 3 ELSE line_id END AS line_id, box_id, x, (y + CASE WHEN box_id % 5 = 0 THEN 17 ELSE 0 END)::INT AS y, w, h FROM boxes)"""
    + fit_sql("uneven", (3, 4, 2, 5)),
)


def line_sql(cw: int, ch: int, share: float, low: float, wide: float, gap: float) -> str:
    return (
        merge_sql("boxes", "m", 0.375) + drop_sql("m", "d", f"{share * cw * ch}") + f", z AS (SELECT * FROM d WHERE w <= {wide * cw}::DOUBLE AND h >= {low * ch}::DOUBLE)" + split_sql("z", "s", f"{gap * cw}::DOUBLE")
        + f", f AS (SELECT grid_id, line_id * 1000 + seg AS line_id, box_id, x, y, w, h FROM s) SELECT {ALL} FROM f QUALIFY count(*) OVER (PARTITION BY grid_id, line_id) >= 2"
    )


register("e01_line_pipeline", "boxes", lambda d: _boxes(B.line_pipeline(d, 16, 20, 2)), line_sql(16, 20, 0.075, 0.5, 2.1, 2.75))
register("e03_rearrange_lines", "boxes", lambda d: _boxes(B.line_pipeline(d, 16, 24, 2, 0.075, 0.75, 1.3, 2.5)), line_sql(16, 24, 0.075, 0.75, 1.3, 2.5))
register(
    "e02_word_pipeline", "boxes", lambda d: _boxes(B.word_pipeline(d, 16, 20)),
    merge_sql("boxes", "m", 0.375) + drop_sql("m", "d", "80") + ", z AS (SELECT * FROM d WHERE w <= 40 AND h >= 10)" + merge_sql("z", "n", 0.375) + wrong_y_sql("n", "k")
    + f", b AS (SELECT grid_id, line_id FROM k GROUP BY grid_id, line_id QUALIFY row_number() OVER (PARTITION BY grid_id ORDER BY count(*) DESC, line_id) = 1) SELECT {ALL} FROM k JOIN b USING (grid_id, line_id)",
)
register(
    "e04_derivative_plan", "boxes", B.derivative_plan,
    """, e AS (SELECT grid_id, line_id, min(x) - 10 AS x, min(y) - 10 AS y, max(x + w) - min(x) + 20 AS w, max(y + h) - min(y) + 20 AS h, median(h) AS mh, max(h) < 7 OR max(w) < 7 AS blank FROM boxes GROUP BY grid_id, line_id)
    SELECT grid_id, line_id, x, y, w, h, factor, round(28 / mh * factor, 6) AS scale_y, round(28 / (mh * 0.6::DOUBLE) * factor, 6) AS scale_x, blank FROM e, (SELECT unnest([0.7, 0.85, 1.0, 1.1, 1.2])::DOUBLE AS factor) f""",
)
