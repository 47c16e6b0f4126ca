"""Hand-made grids and properties."""

import os

import pytest
from pyspark.sql import functions as F

from partlens.functions import strings as S
from partlens.operators import components as C
from partlens.operators import grids as G
from partlens.operators import neighbours as N
from partlens.operators import readings as R
from partlens.sources import files
from partlens.streaming import views as V

CELLS = "grid_id bigint, x int, y int, v int"


def grid(spark, text, grid_id=1):
    """Rows of digits, 0 dark to 9 bright."""
    return spark.createDataFrame([(grid_id, x, y, int(c) * 255 // 9) for y, row in enumerate(text.split()) for x, c in enumerate(row)], CELLS)


def values(df):
    return {(r.x, r.y): r.v for r in df.collect()}


def test_erode_and_dilate_bound_the_value(spark):
    g = grid(spark, "01929 34567 99900 12345 00099")
    v, lo, hi = values(g), values(N.extreme(g, 3, 3)), values(N.extreme(g, 3, 3, True))
    assert all(lo[k] <= v[k] <= hi[k] for k in v)
    once = N.open_close(g, 3, 3)
    assert values(once) == values(N.open_close(once, 3, 3))


def test_step_edge(spark):
    g = grid(spark, "00099 00099 00099 00099 00099")
    edges = values(N.sobel(g, "vertical"))
    assert edges[(2, 2)] == 255 and edges[(0, 2)] == 0


def test_otsu_of_two_values(spark):
    g = grid(spark, "11199 11199 11199 99999")
    t = G.otsu(g, ["grid_id"]).first()
    assert 28 <= t.raw < 255


@pytest.mark.parametrize(("text", "n"), [("0999 0999 0009", 1), ("0999 9099 9909", 3), ("00900 09990 00000", 1), ("9999 9999", 0)])
def test_components(spark, text, n):
    assert C.boxes(C.label(grid(spark, text))).count() == n


def test_spiral_is_one_component(spark):
    g = grid(spark, "0000000 9999990 0000090 0999090 0900090 0999990 0000000")
    b = C.boxes(C.label(g)).collect()
    assert len(b) == 1 and (b[0].w, b[0].h) == (7, 7)


def test_isolated_cell_goes_and_long_run_goes(spark):
    assert values(N.salt_pepper(grid(spark, "999 909 999")))[(1, 1)] == 255
    g = grid(spark, "0000000000000 9999999999999 9900999999999")
    out = values(C.remove_long_lines(g, 11))
    assert out[(3, 0)] == 255 and out[(2, 2)] == 0
    assert values(C.remove_long_lines(g, 11, "vertical")) == values(C.remove_long_lines(g, 10)) == values(g)


@pytest.fixture
def tile(monkeypatch):
    from partlens.operators import tiles

    return lambda side: monkeypatch.setattr(tiles, "TILE", side)


def noise(spark, w=30, h=21, seed=3):
    import numpy as np

    v = np.random.default_rng(seed).integers(0, 256, (h, w))
    return spark.createDataFrame([(1, x, y, int(v[y, x])) for y in range(h) for x in range(w)], CELLS)


def test_lines_along_both_axes(spark, tile):
    """A vertical and a horizontal line of 13 cells, over borders of tiles and touching no other."""
    rows = [[9] * 16 for _ in range(16)]
    for i in range(13):
        rows[i + 1][2] = rows[15][i + 3] = 0
    rows[4][10] = 0
    g = grid(spark, " ".join("".join(map(str, r)) for r in rows))
    for side in (4, 256):
        tile(side)
        dark = lambda d: {k for k, v in values(d).items() if v == 0}
        down, across = {(2, i + 1) for i in range(13)}, {(i + 3, 15) for i in range(13)}
        assert dark(C.remove_long_lines(g, 11)) == down | {(10, 4)}
        assert dark(C.remove_long_lines(g, 11, "vertical")) == across | {(10, 4)}
        assert dark(C.remove_long_lines(g, 11, "both")) == {(10, 4)}
        assert dark(C.remove_long_lines(g, 12, "both")) == down | across | {(10, 4)}


OVER_TILES = {
    "box_mean": lambda d: N.box_mean(d, 5, 3), "erode": lambda d: N.extreme(d, 3, 5), "rank": lambda d: N.rank_filter(d, 3, 5), "wide rank": lambda d: N.rank_filter(d, 9, 9, 80), "sobel": lambda d: N.sobel(d, "nesw"),
    "gaussian": lambda d: N.gaussian(d, 3), "layer": lambda d: N.add_layer(d, 3, "W", 128), "bridges": N.join_bridges, "centre": lambda d: N.lighten_centre(d, 5, "x"), "trails": lambda d: N.clear_trails(d, 4, 3, 60),
    "rings": lambda d: N.ring_detector(d, 11, 0, 1.02), "knees": lambda d: G.knee_base(d, 9), "fill": lambda d: G.bridge_fill(d, 3, axis="y"), "runs": lambda d: G.whiten_long_runs(d, 7), "between": G.lighten_intermediates,
    "sauvola": lambda d: N.sauvola(d, 7, 0.2), "background": lambda d: N.kernel_background(d, 9, 200, 3),
}


@pytest.mark.parametrize("name", OVER_TILES)
def test_tiles_do_not_show(spark, tile, name):
    g = noise(spark)
    got = []
    for side in (4, 8, 64):
        tile(side)
        got.append(values(OVER_TILES[name](g)))
    assert got[0] == got[1] == got[2] and len(got[0]) == 30 * 21


def test_tiles_bound_what_a_task_reads(spark, tile):
    """No tile holds more than its side and two halos in each direction, and one exchange deals them out."""
    from partlens.operators import tiles

    tile(8)
    df = tiles.tiled(noise(spark, 50, 40), 3, 2)
    assert df.groupBy(*tiles.AT).count().agg(F.max("count")).first()[0] == (8 + 6) * (8 + 4)
    plan = N.box_mean(noise(spark), 7, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("side", [4, 7, 64])
def test_components_over_tiles(spark, tile, side):
    """Labels do not depend on tiles: noise, and a spiral through all of them."""
    spiral = grid(spark, "0000000 9999990 0000090 0999090 0900090 0999990 0000000", 2)
    g = noise(spark, 40, 30).withColumn("v", F.when(F.col("v") < 140, 0).otherwise(255)).unionByName(spiral)
    want = sorted(map(tuple, C.boxes(C.label(g)).collect()))
    tile(side)
    assert sorted(map(tuple, C.boxes(C.label(g)).collect())) == want


@pytest.mark.parametrize("k", [9, 15])
def test_knees_against_sorting(spark, k):
    """The histograms' knees against the sorted neighbourhoods', on few values, so that repeats abound."""
    import numpy as np

    v = np.random.default_rng(k).choice([0, 3, 3, 40, 41, 90, 200], (20, 24))
    g = spark.createDataFrame([(1, x, y, int(v[y, x])) for y in range(20) for x in range(24)], CELLS)
    from partlens.operators import ranks

    got = {(r.x, r.y): r.base for r in ranks.by_histogram(g, k, k, ["base"], ranks.knees).collect()}
    for (x, y), base in got.items():
        a = np.sort(v[max(0, y - k // 2) : y + k // 2 + 1, max(0, x - k // 2) : x + k // 2 + 1].ravel())
        d = a[2:] - 2 * a[1:-1] + a[:-2]
        assert base == a[int(d.argmax()) + 2]


def test_lattice_is_near_the_direct_form(spark, tile):
    from partlens.operators import bilateral as B

    g = noise(spark, 24, 18).withColumn("v", (100 + F.col("x") * 3 + F.col("v") % 30).cast("int"))
    exact = values(B.direct(g, 2, 30))
    for side in (8, 64):
        tile(side)
        got = values(B.by_lattice(g, 2, 30))
        assert max(abs(got[k] - exact[k]) for k in exact) <= 2


def test_polygons_by_scanlines(spark):
    """Concave, crossing itself, beside the grid, and with corners between cells."""
    from partlens.operators import regions as RG

    shapes = {1: [(1, 1), (9, 1), (9, 9), (5, 4), (1, 9)], 2: [(0, 0), (10, 10), (10, 0), (0, 10)], 3: [(-5, 2), (30, 2), (30, 6), (-5, 6)], 4: [(2.5, 2.5), (6.5, 3.25), (4.25, 8.5)], 5: [(40, 40), (50, 40), (50, 50)]}
    cells = noise(spark, 12, 12)
    df = spark.createDataFrame([(i, 1, [(float(x), float(y)) for x, y in p]) for i, p in shapes.items()], "region_id int, grid_id bigint, points array<struct<x double, y double>>")
    got = {(r.region_id, r.x, r.y) for r in RG.clip_polygon_cells(cells, df).collect()}

    def inside(p, cx, cy):
        n = 0
        for (px, py), (qx, qy) in zip(p, p[1:] + p[:1]):
            n += (py > cy) != (qy > cy) and cx < px + (cy - py) * (qx - px) / (qy - py)
        return n % 2 == 1

    assert got == {(i, x, y) for i, p in shapes.items() for x in range(12) for y in range(12) if inside(p, x + 0.5, y + 0.5)}


def test_sessions_over_many_buckets(spark):
    """Spells that last over thousands of buckets, end on their borders and stand alone."""
    rows = [(1, t) for t in range(0, 400_000, 50)] + [(1, 500_000), (2, 0), (2, 60), (2, 119), (2, 960), (2, 1020)] + [(3, t) for t in range(0, 90_000, 61)] + [(3, None), (None, 5)]
    df = spark.createDataFrame(rows, "camera_id long, t long").selectExpr("camera_id", "timestamp_seconds(t) AS ts")
    got = sorted((str(r.camera_id), r.n, r.a, r.b) for r in V.camera_sessions(df, "1 minute").selectExpr("camera_id", "n", "unix_seconds(start) AS a", "unix_seconds(end) AS b").collect())
    want = []
    for c in (1, 2, 3, None):
        ts = sorted(t for k, t in rows if k == c and t is not None)
        spell = [ts[0], ts[0], 0]
        for t in ts:
            if t >= spell[1] + 60 and spell[2]:
                want.append((str(c), spell[2], spell[0], spell[1] + 60))
                spell = [t, t, 0]
            spell = [spell[0], t, spell[2] + 1]
        want.append((str(c), spell[2], spell[0], spell[1] + 60))
    assert got == sorted(want)


def test_nulls_do_not_win_a_vote(spark):
    df = spark.createDataFrame([(1, None), (1, "A"), (1, "A"), (1, None), (1, None), (2, None), (2, ""), (3, None)], "k int, t string")
    got = {r.k: (r.t, r.votes) for r in R.consensus(df, ["k"], "t").collect()}
    assert got == {1: ("A", 2), 2: ("", 1), 3: (None, 1)}


def test_histogram_counts_every_cell(spark):
    g = grid(spark, "0123 4567 8901")
    assert G.histogram(g, 10).agg(F.sum("n")).first()[0] == 12


def test_strings(spark):
    df = spark.createDataFrame([("KA2O", "AADD"), ("1OI", "DDA"), ("O4439", "DDDDD"), ("", "AADD"), (None, "AADD"), ("KA20XYZ", "AADD")], "s string, p string")
    got = [tuple(r) for r in df.select(S.correct_to_template(F.col("s"), F.col("p")), S.verify_template(F.col("s"), F.col("p")), F.size(S.match_template(F.col("s"), F.col("p")))).collect()]
    assert got[0] == ("KA20", "KA20", 1) and got[1] == ("10I", "10I", 1) and got[2][0] == "04439"
    assert got[3][2] == 0 and got[5] == ("KA20XYZ", "", 1)


def test_consensus_does_not_depend_on_row_order(spark):
    rows = [(1, "a"), (1, "b"), (1, "a"), (2, "x"), (2, "y"), (3, None)]
    df = spark.createDataFrame(rows, "k int, t string")
    got = sorted(map(str, R.consensus(df, ["k"], "t").collect()))
    assert got == sorted(map(str, R.consensus(df.repartition(3).orderBy(F.desc("t")), ["k"], "t").collect()))


def test_images(spark, tmp_path):
    import struct
    import zlib

    def png(w, h, gray):
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        raw = b"".join(b"\0" + bytes(gray[y * w : (y + 1) * w]) for y in range(h))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")

    (tmp_path / "a.png").write_bytes(png(3, 2, [0, 10, 20, 30, 200, 255]))
    (tmp_path / "bad.png").write_bytes(b"nothing")
    (tmp_path / "note.txt").write_text("x")
    assert files.list_files(spark, str(tmp_path)).count() == 2
    images = files.image_scan(spark, str(tmp_path))
    assert images.where("bad").count() == 1
    cells = files.pixels_from_binary(images)
    assert [r.v for r in cells.where("NOT bad").orderBy("y", "x").collect()] == [0, 10, 20, 30, 200, 255]
    assert [(r.x, r.y, r.v) for r in cells.where("bad").orderBy("y", "x").collect()] == [(x, y, 0) for y in range(50) for x in range(50)]


def test_settings_and_archive_round_trip(spark, tmp_path):
    s = spark.createDataFrame([(1, "a.b", "1,2"), (2, "c", "x")], "line_no long, key string, value string")
    files.save_settings(s, str(tmp_path / "s"), "own")
    assert [r.value for r in spark.read.text(str(tmp_path / "s")).collect()] == ["# own", "a.b=1,2", "c=x"]
    df = spark.createDataFrame([(1, "r1", 2, True)], "part_id long, run string, camera long, ok boolean")
    files.archive(df, str(tmp_path / "a"), "part_id", "camera")
    assert spark.read.parquet(str(tmp_path / "a")).first().ok
    files.save_results(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1


def _stream(spark, df, folder, view, out, keys=None):
    df.coalesce(1).write.parquet(str(folder))
    live = spark.readStream.schema(df.schema).parquet(str(folder))
    q = view(live).writeStream.format("memory").queryName(out).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    return sorted(map(str, spark.table(out).collect()))


EVENTS = "event_id long, ts timestamp, camera_id long, kind string, value double"


@pytest.fixture
def events(spark):
    rows = spark.range(40).selectExpr("id AS event_id", "timestamp_seconds(1700000000 + id * 7 + IF(id > 20, 4000, 0)) AS ts", "id % 2 AS camera_id", "IF(id % 4 < 2, 'request', 'response') AS kind", "CAST(id AS DOUBLE) AS value")
    last = spark.sql("SELECT 99L AS event_id, timestamp_seconds(1700100000) AS ts, 0L AS camera_id, 'beat' AS kind, 0D AS value")
    return rows.unionByName(last)


@pytest.mark.parametrize("view", [V.sampled_frames, V.camera_sessions, V.camera_liveness])
def test_stream_equals_batch(spark, events, tmp_path, view):
    live = _stream(spark, events, tmp_path / "e", lambda d: view(V.watermarked(d, "10 seconds")), f"out_{view.__name__}")
    done = [str(r) for r in view(events).collect()]
    assert live and set(live) <= set(done)
    assert len(done) - len(live) <= 2  # what the last event's watermark has not closed


def test_stream_join_and_first_reply(spark, events, tmp_path):
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    live = V.watermarked(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")), "10 seconds")
    joined = V.capture_timeout_join(live.where("kind = 'request'"), live.where("kind = 'response'"))
    q = joined.writeStream.format("memory").queryName("joined").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    batch = V.capture_timeout_join(events.where("kind = 'request'"), events.where("kind = 'response'"))
    assert sorted(map(str, spark.table("joined").collect())) == sorted(map(str, batch.collect()))
    assert V.first_reply_wins(batch).groupBy("request_id").count().where("count > 1").isEmpty()


def test_archive_stream_restarts_where_it_ended(spark, events, tmp_path):
    def go(n):
        events.limit(n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
        V.archive_stream(live, lambda d, i: files.archive(d, str(tmp_path / "out"), "camera_id"), str(tmp_path / "ck")).awaitTermination(60)
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert go(5) == 5 and go(3) == 8


def test_strip_of_a_stream_is_the_last_outcomes(spark, tmp_path):
    from partlens.operators import results as R

    df = spark.range(400).selectExpr("id % 50 AS part_id", "timestamp_seconds(1700000000 + (id * 7919) % 400) AS run_ts", "CAST(id % 3 AS INT) AS point_id", "id % 4 <> 0 AS ok", "id AS row_id")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = V.live_strip(live).writeStream.format("memory").queryName("strip").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {}
    for r in spark.table("strip").collect():
        if r.seen > last.get(r.point_id, (0,))[0]:
            last[r.point_id] = (r.seen, list(zip(r.parts, r.oks)))
    want = {}
    for r in R.last_outcomes(df).orderBy("point_id", "nth").collect():
        want.setdefault(r.point_id, []).append((r.part_id, r.ok))
    assert {k: v[1] for k, v in last.items()} == want and sum(v[0] for v in last.values()) == 400


def test_windows_see_past_holes(spark, tile):
    """Grids whose rows lack cells: inside, at either end, and all of one; every cell's neighbours are those that are there."""
    v = {(x, y): (x * 37 + y * 53) % 200 for y in range(11) for x in range(13) if not (y > 8 and x > 4) and not (3 <= x <= 5 and 2 <= y <= 6) and y != 7 and not (x == 0 and y % 3 == 0)}
    g = spark.createDataFrame([(1, x, y, c) for (x, y), c in v.items()], CELLS)
    near = {(x, y): [c for (a, b), c in v.items() if abs(a - x) <= 3 and abs(b - y) <= 2] for x, y in v}
    for side in (4, 64):
        tile(side)
        assert values(N.box_mean(g, 7, 5)) == {k: sum(n) // len(n) for k, n in near.items()}
        assert values(N.extreme(g, 7, 5)) == {k: min(n) for k, n in near.items()}
        assert {(r.x, r.y): sorted(e.v for e in r.near) for r in N.gather(g, 7, 5).collect()} == {k: sorted(n) for k, n in near.items()}
        means = {k: (sum(n) / len(n), (sum(c * c for c in n) / len(n) - (sum(n) / len(n)) ** 2) ** 0.5) for k, n in ((k, [c for (a, b), c in v.items() if abs(a - k[0]) <= 2 and abs(b - k[1]) <= 2]) for k in v)}
        assert values(N.sauvola(g, 5, 0.2)) == {k: 0 if v[k] <= round(m * (1 + 0.2 * (sd / 128 - 1)), 6) else 255 for k, (m, sd) in means.items()}
        assert set(values(N.gaussian(g, 2))) == set(v)


def test_sorts_by_key_are_dealt_out(spark):
    """Settings and lines of boxes are sorted in many partitions that adaptive execution leaves apart."""
    from partlens.operators import boxes as B
    from partlens.operators import dealing
    from partlens.operators import regions as RG

    lines = spark.createDataFrame([(i, f"P{i % 7}.A.B.{i}.clipBox=1,1,{i},4") for i in range(40)] + [(90, "P1.A.B.1.clipBox=9"), (91, "P8=2"), (92, "P8.A=2")], "line_no int, text string")
    settings = RG.parse_settings(lines)
    boxes = spark.createDataFrame([(i % 5, i, i * 9 % 80, 3, 5, 9) for i in range(30)], "grid_id long, box_id long, x int, y int, w int, h int")
    for df in (settings, RG.region_settings(RG.key_parts(settings)), RG.walk_hierarchy(RG.key_parts(settings)), B.order_and_arrange(boxes, 20)):
        df.collect()
        assert df.rdd.getNumPartitions() >= dealing.PIECES
    assert {r.value for r in settings.collect() if r.key == "P1.A.B.1.clipBox"} == {"9"}
    walked = RG.walk_hierarchy(RG.key_parts(settings))
    assert sorted((r.path, r.processor) for r in walked.collect()) == [*((f"P{i} > A > B", "B") for i in range(7)), ("P8 > A", None)]
    assert walked._jdf.queryExecution().toString().count("Join") == 0


def test_direct_blur_shifts_tiles_and_line_medians_need_no_join(spark):
    """The direct bilateral form collects no neighbourhood into a row; W07 and W12 are windows over one input."""
    from partlens.operators import bilateral as B
    from partlens.operators import boxes as X

    plan = B.direct(noise(spark, 6, 6), 1, 30)._jdf.queryExecution().toString()
    assert "collect_list" not in plan
    boxes = spark.createDataFrame([(1, i % 3, i, i * 9, i % 3 * 30 + i % 2, 5, 9) for i in range(30)], "grid_id long, line_id long, box_id long, x int, y int, w int, h int")
    assert "Join" not in X.longest_line(X.drop_wrong_y(boxes))._jdf.queryExecution().toString()


def test_frame_streams_by_camera(spark):
    from partlens.plans import streams

    folder, path, state = (streams._shared(spark, n) for n in ("frames", "seen", "state"))
    key = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(key, None)
    for first, last in ((0, 250), (250, 260)):
        at = F.concat(F.when(F.col("id") % 50 == 0, "camera=-1/").otherwise("camera=4/"), F.col("id"), F.lit(".bmp"))
        content = F.when(F.col("id") == 7, F.lit("")).otherwise(F.repeat(F.lit("x"), 60)).cast("binary")
        files.save_frames(spark.range(first, last).select(at.alias("name"), content.alias("content")), folder)
        streams._watch(spark, folder, path, state)
    assert files.camera_folders(folder) == ["camera=-1", "camera=4"] and spark.conf.get(key, None) == before
    got = spark.read.option("recursiveFileLookup", True).parquet(path).collect()
    assert sorted((r.camera_id, r.grid_id, r.body) for r in got) == sorted((-1 if i % 50 == 0 else 4, i, "78" * 6) for i in range(260) if i != 7)
    # 245 files of camera 4 are three triggers of 100 files at most, and nine more the fourth; each is one task and no more
    local = path.removeprefix("file://")
    assert {c: len([f for f in os.listdir(f"{local}/{c}") if f.endswith(".parquet")]) for c in os.listdir(local)} == {"camera=-1": 2, "camera=4": 4}


def test_regions_parse_their_numbers_once(spark):
    from partlens.operators import regions
    from partlens.plans import regions as queries

    lines = [
        "P1.a.b.1.clipBox = 1,1,6,1,6,6,1,5", "P1.a.b.2.clipBox=0,0,1,0,1,5", "P1.a.b.3.clipBox=1,1,x,4,5,5", "P1.a.b.4.clipBox=-1.5,2,3.9,4", "P1.a.b.5.clipBox=1,2,1.9,4",
        "P1.a.b.6.clipBox=", "P2.a.b.clipBox=1,2,3,4", "P2.a.b.1.c.clipBox=1,2,3,4", "P2.a.b.1.note=clipBox", "# P3.a.b.1.clipBox=1,2,3,4", "P1.a.b.4.clipBox=5,6,7,8", None,
    ]
    settings = spark.createDataFrame(list(enumerate(lines)), "line_no long, text string")
    polygons, rects = queries.polygons(settings), queries.rects(settings)
    assert [(r.region_id, [tuple(p) for p in r.points]) for r in polygons.collect()] == [(0, [(1, 1), (6, 1), (6, 6), (1, 5)])]
    assert sorted((r.line_no, r.part, r.i, r.x, r.y, r.w, r.h) for r in rects.collect()) == [(6, "P2", None, 1, 2, 3, 4), (10, "P1", 4, 5, 6, 7, 8)]
    # a value is split once in a column, and a key's parts once in a filter by kind, however often they are named
    for parsed in (regions.parse_polygon(F.col("text")), regions.parse_rect(F.col("text"))):
        plan = settings.select(parsed.alias("p"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") == 1
    plan = settings.select(F.col("text").alias("key"), "line_no", F.lit("").alias("value"))
    plan = regions.key_parts(plan).where("kind = 'clipBox'")._jdf.queryExecution().optimizedPlan().toString()
    assert next(line for line in plan.splitlines() if "Filter" in line).count("split(") == 1


def test_region_steps_read_tables(spark, monkeypatch):
    from partlens.plans import results

    given, real = [], C.remove_long_lines
    monkeypatch.setattr(results.C, "remove_long_lines", lambda cells, *more: given.append(cells) or real(cells, *more))
    cells = spark.range(32 * 128).selectExpr("1L AS grid_id", "CAST(id % 32 AS INT) AS x", "CAST(id / 32 AS INT) AS y", "CAST(id * 7 % 256 AS INT) AS v")
    results._region_binarize(cells)
    # each reads its cells three times, so they are a table and nothing that would be worked out again
    assert len(given) == 2 and not any("Exchange" in d._jdf.queryExecution().executedPlan().toString() for d in given)
