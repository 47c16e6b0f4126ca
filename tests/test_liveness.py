"""The live form of X03 against its batch form: order of arrival, restarts, bounded state."""

import numpy as np
import pytest

from partlens.streaming import liveness as L
from partlens.streaming import views as V

SCHEMA = "ts timestamp, camera_id long"
START = 1_700_000_000


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, L.PROVIDER)
    yield spark
    spark.conf.set(key, before)


def table(spark, pairs):
    """Rows of (second, camera)."""
    return spark.createDataFrame([(int(t), c) for t, c in pairs], "t long, camera_id long").selectExpr(f"timestamp_seconds({START} + t) AS ts", "camera_id")


def feed(spark, folder, batches, silence="20 minutes", delay="30 seconds", settled=True):
    """One file a micro-batch, and a stop and a restart after each; what each of them brought out."""
    out = []
    for batch in batches:
        table(spark, batch).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        live = V.watermarked(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), delay)
        query = L.live_changes(live, silence, settled).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        query.outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
        got = spark.read.schema(L.CHANGES).parquet(f"{folder}/out").selectExpr("camera_id", f"unix_seconds(at) - {START} AS at", "state").collect()
        out.append(sorted((r.camera_id, r.at, r.state) for r in got))
    return out


def batch_rows(spark, batches, silence="20 minutes"):
    df = V.camera_liveness(table(spark, [p for b in batches for p in b]), silence).selectExpr("camera_id", f"unix_seconds(at) - {START} AS at", "state")
    return sorted((r.camera_id, r.at, r.state) for r in df.collect())


def test_on_comes_before_the_spell_ends(rocks, tmp_path):
    steps = [[(0, 1), (60, 1), (100, 2)], [(700, 2)], [(1200, 2)], [(1300, 2), (1310, 1)], [(9000, 3)]]
    got = feed(rocks, tmp_path, steps)
    assert got[0] == [(1, 0, "ON")]  # camera 2 is not yet certain: the watermark is at 70
    assert got[1] == [(1, 0, "ON"), (2, 100, "ON")]
    assert got[3] == [(1, 0, "ON"), (1, 1260, "OFF"), (2, 100, "ON")]
    last = batch_rows(rocks, steps)
    assert got[4] == [r for r in last if r[1] <= 9000 - 30] and (1, 1310, "ON") in got[4]


def test_at_once(rocks, tmp_path):
    got = feed(rocks, tmp_path, [[(100, 2)], [(1250, 2)], [(2600, 1)]], settled=False)
    assert got[0] == [(2, 100, "ON")] == got[1]
    assert got[2] == [(1, 2600, "ON"), (2, 100, "ON"), (2, 2450, "OFF")]


@pytest.mark.parametrize("seed", [1])
def test_any_order_within_the_watermark(rocks, tmp_path, seed):
    """Events up to 200 s late, in three batches: the batch form's rows, each once."""
    rng = np.random.default_rng(seed)
    times = np.cumsum(rng.choice([5, 40, 400, 1300, 1199, 1200, 1201], 150, p=[0.4, 0.3, 0.15, 0.06, 0.03, 0.03, 0.03]))
    events = [(int(t), int(c)) for t, c in zip(times, rng.integers(1, 4, len(times)))]
    arrival = sorted(events, key=lambda e: e[0] + rng.uniform(0, 200))
    steps = [arrival[i : i + 50] for i in range(0, 150, 50)] + [[(int(times[-1]) + 90_000, 9)]]
    got = feed(rocks, tmp_path, steps, delay="300 seconds")
    assert got[-1] == [r for r in batch_rows(rocks, steps) if r[0] != 9]


def test_state_does_not_grow_with_events():
    spells = []
    for i in range(100):
        spells = L.merge_spells(spells, np.arange(i * 1000, i * 1000 + 1000) * 1_000_000, 1_200_000_000)
    assert spells == [(0, 99_999_000_000, False)]


def test_spells_against_event_by_event():
    rng = np.random.default_rng(3)
    for _ in range(50):
        times = rng.integers(0, 500, 40)
        spells = []
        for part in np.array_split(times, 7):
            spells = L.merge_spells(spells, part, 12)
        want, last = [], None
        for t in sorted(times.tolist()):
            if last is None or t >= last + 12:
                want.append([t, t])
            want[-1][1] = last = t
        assert [[a, b] for a, b, _ in spells] == want


def replies_by_hand(events, timeout):
    """(camera, request, reply) event by event."""
    out = []
    for camera in {e[1] for e in events}:
        open_ = None
        for t, _, i, kind in sorted((e for e in events if e[1] == camera), key=lambda e: (e[0], e[3] == "response", e[2])):
            if kind == "request":
                if open_:
                    out.append((camera, open_[1], None))
                open_ = (t, i)
            elif open_:
                out.append((camera, open_[1], i if t <= open_[0] + timeout else None))
                open_ = None
        if open_:
            out.append((camera, open_[1], None))
    return sorted(out, key=str)


def make_events(seed, n=120):
    rng = np.random.default_rng(seed)
    times = np.cumsum(rng.choice([0, 3, 10, 29, 30, 31, 80], n))
    return [(int(t), int(c), i, k) for i, (t, c, k) in enumerate(zip(times, rng.integers(1, 3, n), rng.choice(["request", "response", "beat"], n, p=[0.4, 0.5, 0.1])))]


def event_table(spark, events):
    df = spark.createDataFrame(events, "t long, camera_id long, event_id long, kind string")
    return df.selectExpr("event_id", f"timestamp_seconds({START} + t) AS ts", "camera_id", "kind")


@pytest.mark.parametrize("seed", [1])
def test_latest_request_batch_and_stream(rocks, tmp_path, seed):
    from partlens.streaming import replies as P

    events = make_events(seed)
    asked = [e for e in events if e[3] != "beat"]
    want = replies_by_hand(asked, 30)
    df = event_table(rocks, events)
    batch = P.latest_request_replies(df.where("kind = 'request'"), df.where("kind = 'response'"))
    assert sorted(((r.camera_id, r.request_id, r.reply_id) for r in batch.collect()), key=str) == want
    rng = np.random.default_rng(seed)
    arrival = sorted(events, key=lambda e: e[0] + rng.uniform(0, 50)) + [(10**6, 9, 10**6, "beat"), (10**6, 1, 10**6 + 1, "response")]
    for i in range(0, len(arrival), 50):
        event_table(rocks, arrival[i : i + 50]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        live = V.watermarked(rocks.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "60 seconds")
        query = P.live_replies(live).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
        query.outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    got = rocks.read.schema(P.RESULTS).parquet(f"{tmp_path}/out").collect()
    assert sorted(((r.camera_id, r.request_id, r.reply_id) for r in got), key=str) == want


def test_a_superseded_request_gets_no_reply(spark):
    from partlens.streaming import replies as P

    df = event_table(spark, [(0, 1, 1, "request"), (5, 1, 2, "request"), (6, 1, 3, "response"), (7, 1, 4, "response"), (100, 1, 5, "request"), (131, 1, 6, "response")])
    got = P.latest_request_replies(df.where("kind = 'request'"), df.where("kind = 'response'")).collect()
    assert {r.request_id: r.reply_id for r in got} == {1: None, 2: 3, 5: None}
