import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from partlens.llm import toxicity
from partlens.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score string"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_machine_learns_pairs():
    """Neither term alone tells; the two together do."""
    rng = np.random.default_rng(3)
    docs, y = [], []
    for i in range(1200):
        a, b = i % 2, (i // 2) % 2
        docs.append([*([1] if a else []), *([2] if b else []), *rng.integers(100, 400, 10)])
        y.append(float(a and b))
    starts = np.cumsum([0, *map(len, docs)])
    flat = np.array([t for d in docs for t in d])
    m = toxicity.train(flat, starts, np.array(y))
    raw = m.raw(np.array([1, 2, 1, 2]), np.array([0, 2, 3, 4, 4]))
    assert raw[0] > 0 > raw[1:].max()
    assert m.factor[1] @ m.factor[2] > 0


def test_machine_learns_pairs_of_neutral_terms():
    """Toxic where 1 and 2, or 3 and 4, meet; 1 and 3, or 2 and 4, are harmless: each term alone is neutral."""
    rng = np.random.default_rng(8)
    docs, y = [], []
    for i in range(2000):
        pair = [(1, 2), (3, 4), (1, 3), (2, 4)][i % 4]
        docs.append([*pair, *rng.choice(np.arange(100, 800), 15, replace=False)])
        y.append(float(i % 4 < 2))
    starts, flat, y = np.cumsum([0, *map(len, docs)]), np.array([t for d in docs for t in d]), np.array(y)
    alone = toxicity._ratio(np.full(4, 500.0), np.full(4, 500.0), 1000.0, 1000.0)
    assert (alone < 1e-6).all() and toxicity.telling_terms(flat, starts, y)[[1, 2, 3, 4]].all()
    half = 1000
    m = toxicity.train(flat[: starts[half]], starts[: half + 1], y[:half])
    rest = (flat[starts[half] :], starts[half:] - starts[half])
    assert auc(m.raw(*rest), y[half:]) > 0.95
    without = toxicity.Machine(m.bias, m.weight, np.zeros_like(m.factor))
    assert auc(without.raw(*rest), y[half:]) < 0.7


def test_order_of_rows_does_not_matter(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    docs = docs.unionByName(docs.where("doc_id % 7 = 0").withColumn("text", F.concat("text", F.lit(" other"))))  # ids that repeat
    a, b = toxicity.op10_toxicity(docs, labels), toxicity.op10_toxicity(docs.repartition(7), labels.repartition(5))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_raw_is_the_formula():
    rng = np.random.default_rng(1)
    m = toxicity.Machine(0.3, rng.normal(size=1 << toxicity.BITS), rng.normal(size=(1 << toxicity.BITS, toxicity.FACTORS)))
    ids = [5, 77, 1234, 9]
    want = 0.3 + sum(m.weight[i] for i in ids) + sum(m.factor[i] @ m.factor[j] for k, i in enumerate(ids) for j in ids[:k])
    assert m.raw(np.array(ids), np.array([0, 4, 4]))[0] == pytest.approx(want)
    assert m.raw(np.array(ids), np.array([0, 4, 4]))[1] == 0.3


def test_held_out(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.op10_toxicity(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for i, r in got.items())
    rows = [(got[r.doc_id].score, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    assert auc(np.array([s for s, _ in rows]), np.array([t for _, t in rows])) > 0.9


def test_edge_cases(spark):
    rows = [(1, None, "x", ""), (2, "", "x", ""), (None, "idiot scum", "x", None), (3, "word " * 50_000, "x", ""), (3, "word", "x", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int, text string")
    got = toxicity.op10_toxicity(df, none).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.op10_toxicity(df.limit(0), none).count() == 0


def test_pipeline(spark):
    """Each stage takes what the one before kept, keeps its columns, and makes its decisions."""
    docs = given = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = []
    from partlens.llm.common import materialize

    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, DATA), name)
        assert docs.schema.names == given.schema.names
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    quality, lines, near, mixed = kept
    bad = {r.doc_id for r in QUERIES["op9_quality_rules"](spark, DATA).where("NOT kept").collect()}
    assert quality == {r.doc_id for r in given.collect()} - bad
    assert lines == quality and near <= lines and mixed <= near and len(near) > 0.8 * len(lines)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    per_row = pieces.groupBy("doc_id").sum("length").count()
    assert per_row == len(mixed)
    got = corpus_pipeline.run(spark, DATA)
    assert got.columns == pieces.columns and got.count() > 0


ODD = "doc_id long, text string, lang string, source string, n_chars long, row string, content string, times int, _doc long, hashes string, finish double"


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, name):
    """Nulls, empty and long texts, repeated rows, an id with two texts, clashing columns; and no rows at all."""
    stage = dict(corpus_pipeline.STAGES)[name]
    word = lambda n: "".join(chr(97 + int(c)) for c in str(n))
    good = [" ".join(f"w{word(i)}x{word(j)}" for j in range(40)) for i in range(4)]
    long = " ".join(f"long{word(j)}" for j in range(30_000))
    rows = [(i, t, "en", "s", len(t), "row", "content", 1, 5, "h", 0.5) for i, t in enumerate(good)]
    rows += [rows[0], (1, good[3] + " more", *rows[1][2:]), (7, long, *rows[1][2:]), (8, None, *[None] * 9), (9, "", *rows[1][2:]), (None, good[2] + " tail of it", *rows[1][2:]), (None, None, *[None] * 9)]
    df = spark.createDataFrame(rows, ODD)
    out = stage(spark, df, DATA)
    got = out.collect()
    assert stage(spark, df.limit(0), DATA).count() == 0
    if name == "packing":
        from tests.llm.test_packing import expected_ids

        assert sum(r.length for r in got) == sum(len(expected_ids(r[1])) for r in rows)
        return
    assert out.columns == df.columns
    ids = [r.doc_id for r in got]
    if name == "quality_rules":  # the null and empty texts go
        assert sorted(map(str, ids)) == sorted(map(str, [0, 1, 2, 3, 0, 1, 7, None]))
    elif name == "line_dedup":  # no row goes
        assert len(got) == len(rows) and all(r.text is None or set(r.text) <= set(long) | set(" ".join(good)) | set(" more tail of it") for r in got)
    elif name == "near_dedup":  # the repeated row, the copy of 3 with a word more, and that of 2; null and empty are one
        assert len(got) == 4 + 1 + 1 and {r.text for r in got} >= {*good[:2], long}
    else:  # each document at most three times
        assert all(ids.count(i) <= 3 * [r[0] for r in rows].count(i) for i in set(ids))


def test_registered():
    assert [f"op{n}_" for n in range(1, 14)] == [q[: q.index("_") + 1] for q in sorted((q for q in QUERIES), key=lambda q: int(q[2 : q.index("_")]))]
    assert set(ORACLES) <= set(QUERIES)
