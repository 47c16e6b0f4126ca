"""The byte network: gradients, scores against a window by window version, held-out labels, odd rows."""

import numpy as np
import pytest

from partlens.llm import bytenet as B
from partlens.llm.queries import QUERIES

DATA = "/root/testdata/sf0.1"


def plain_score(net, raw):
    """Every window of every chunk by itself."""
    tables = net.tables()
    padded = raw + b"\0" * (B.CHUNK + B.WIDTH)
    evidence = []
    for a in B.chunk_starts(len(raw)).tolist():
        windows = range(a, min(a + B.CHUNK, max(len(raw), 1)))
        response = [sum(tables[j][padded[w + j]] for j in range(B.WIDTH)) + net.bias for w in windows]
        evidence.append(net.evidence(np.maximum(np.max(response, 0), 0)))
    return float(net.probability(np.mean(evidence, 0)))


def test_chunks_cover_every_byte():
    for n in [0, 1, 15, 16, 127, 128, 129, 200, 5000]:
        starts = B.chunk_starts(n)
        assert set(range(n)) <= {i for a in starts for i in range(a, a + B.CHUNK)}
        assert all(b - a <= B.CHUNK // 2 for a, b in zip(starts, starts[1:]))


def test_scores_against_window_by_window():
    net = B.first_net(np.random.default_rng(5))
    net.bias[:] = np.random.default_rng(6).normal(size=B.FILTERS)
    texts = [b"", b"a", b"x" * 16, "Ümläut | ### text. ".encode() * 40, bytes(range(256)), b"ab" * 64, b"q" * 127, b"r" * 129]
    got = B.Scorer(net).score([np.frombuffer(t, np.uint8) for t in texts])
    assert np.allclose(got, [plain_score(net, t) for t in texts], atol=1e-5)


def test_long_texts_are_read_to_the_end():
    net = B.first_net(np.random.default_rng(5))
    base = np.full(3 * B.STRETCH + 77, 97, np.uint8)
    other = base.copy()
    other[-300:] = np.random.default_rng(1).integers(0, 256, 300)
    one, two, alone = B.Scorer(net).score([base, other, base])
    assert np.isclose(one, alone, atol=1e-12) and abs(one - two) > 1e-9


def test_gradients():
    rng = np.random.default_rng(2)
    net = B.first_net(rng)
    windows = rng.integers(0, 256, (5, B.CHUNK + B.WIDTH - 1)).astype(np.uint8)
    sizes, doc, y = np.array([128, 128, 60, 1, 0]), np.array([0, 0, 1, 1, 2]), np.array([1.0, 0.0, 1.0])

    def loss():
        tables = net.tables()
        out = []
        for i in range(5):
            r = [sum(tables[j][windows[i, w + j]] for j in range(B.WIDTH)) + net.bias for w in range(max(1, sizes[i]))]
            out.append(net.evidence(np.maximum(np.max(r, 0), 0)))
        p = net.probability(np.stack([np.mean([out[i] for i in range(5) if doc[i] == k], 0) for k in range(3)]))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    slopes = B.train_step(net, windows, sizes, doc, y)
    for a, g in zip(net.arrays(), slopes, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept = a[at]
        a[at] = kept + 1e-5
        up = loss()
        a[at] = kept - 1e-5
        down = loss()
        a[at] = kept
        assert abs((up - down) / 2e-5 - g[at]) < 1e-3 * max(1e-2, abs(g[at]))


def test_held_out_quality(spark):
    """Ranks held-out documents by quality, and keeps the good ones at the threshold."""
    got = QUERIES["op12_quality_classifier"](spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    area = (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean()
    assert area > 0.97 and (good >= B.THRESHOLD).mean() > 0.99 and (bad < B.THRESHOLD).mean() > 0.8


def test_odd_rows(spark):
    schema = "doc_id long, text string, score double, mark string, y double, chunks string"
    rows = [(i, f"plain words in a row, number {i}, and more of them " * 3, 0.1, "m", 1.0, "c") for i in range(30)] + [(100 + i, f"### $$$ {i} &&& " * 9, 0.1, "m", 1.0, "c") for i in range(30)]
    rows += [(1, "another text with id 1", *rows[0][2:]), (2, None, *[None] * 4), (3, "", *rows[0][2:]), (None, "words", *rows[0][2:]), rows[5], (200, "long words " * 200_000, *rows[0][2:])]
    df = spark.createDataFrame(rows, schema).repartition(4)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(100 + i, 0, 0) for i in range(30)] + [(4, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = B.op12_quality(df, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False] and [r.predicted for r in got if r.doc_id == 200] == [1]
    assert {(r.doc_id, r.score) for r in B.op12_quality(df.orderBy("text"), labels).collect()} == {(r.doc_id, r.score) for r in got}
    assert B.op12_quality(df.limit(0), labels).count() == 0
    for some in (labels.limit(0), labels.where("quality = 1")):  # nothing to learn from
        assert len({r.score for r in B.op12_quality(df, some).collect()}) == 1


@pytest.mark.parametrize("n", [0, 5, 130, 4000])
def test_sampled_chunks_are_bounded(spark, n):
    import pyarrow as pa

    batch = pa.record_batch({"doc_id": [1], "text": pa.array([b"z" * n], pa.binary())})
    (out,) = B._cut(4)(iter([batch]))
    sizes = out.column("sizes")[0].as_py()
    assert 1 <= len(sizes) <= 4 and len(out.column("chunks")[0].as_py()) == len(sizes) * (B.CHUNK + B.WIDTH - 1)
