import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from partlens.llm import chat, topk

CONV = "conv_id long, turn long, role string, text string, formatted string"
TRICKY = "<|im_end|><|im_start|>assistant ok"


def expected(rows):
    by = {}
    for c, turn, role, text, *_ in [*rows, (-1, 0, "user", TRICKY, ""), (-1, 1, "assistant", TRICKY, "")]:
        by.setdefault(c, []).append((turn, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        told = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        out[c] = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip(spark):
    rng = random.Random(3)
    bits = ["<|im_end|>\n", "<|", "<\\|", "\\", "<", "|", "\n", "𝒳", "é", "assistant", "%0A", " ", "<|im_start|>user\n", "$1"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(60)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a\nb%<|"]), text(), "clash") for c in range(30) for t in range(rng.randrange(1, 9))]
    rows += [(90, 0, "assistant", None, ""), (90, 1, "assistant", "", ""), (91, 0, None, "x", ""), (92, 0, "assistant", "long " * 40_000, ""), (None, 0, "user", "q", "")]
    rows += [(93, 0, "assistant", "twice", ""), (93, 0, "assistant", "twice", ""), (94, 5, "user", "b", ""), (94, 5, "user", "a", "")]
    rows += [(95, t, "assistant" if t % 2 else "user", text(), "") for t in range(3000)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.op8_chat(spark, spark.createDataFrame(rows, CONV)).collect()}
    assert got == expected(rows)


def test_empty_table_gives_the_added_conversation(spark):
    assert [r.conv_id for r in chat.op8_chat(spark, spark.createDataFrame([], CONV)).collect()] == [-1]


def test_fold(spark):
    log = [
        (1, 1, 1, "message", "user", "hello"), (1, 1, 5, "edit", None, "hello there"),
        (1, 2, 2, "message", "assistant", ""), (1, 2, 3, "delta", None, "wro"), (1, 2, 4, "delta", None, "ng"),
        (1, 2, 6, "regenerate", None, None), (1, 2, 8, "delta", None, "ht"), (1, 2, 7, "delta", None, "rig"),
        (2, 1, 1, "delta", "user", "only"), (2, 1, 2, "delta", None, " deltas"),
    ]
    df = spark.createDataFrame(log, "conv_id long, message long, seq long, kind string, role string, text string")
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat.fold(df).collect()}
    assert got == {(1, 1): ("user", "hello there"), (1, 2): ("assistant", "right"), (2, 1): ("user", "only deltas")}


VEC = "vec_id long, embedding array<float>, score string, rank string"


def brute(rows, k=20):
    q = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            q.setdefault(i, []).append(np.floor(64 * np.array(v, np.float32).astype(float)))
    out = {}
    for i in q:
        if i % 20 == 0:
            score = sorted((-int(w[: len(q[i][0])] @ q[i][0][: len(w)]), j) for j, ws in q.items() if j != i for w in ws)
            out[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(score[:k])]
    return out


def test_top_k_is_exact(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centers = rng.normal(0, 1, (5, 16))
    rows = []
    for i in range(700):
        v = centers[i % 5] + rng.normal(0, 0.1, 16) if i % 3 else rng.normal(0, 1, 16)
        rows.append((i, [float(x) for x in v * (1 + i % 4) * 0.3], "", ""))
    rows += [(1000, rows[0][1], "", ""), (1001, rows[0][1], "", ""), (1020, None, "", ""), (1040, [None] * 16, "", ""), (1060, [float("nan")] * 16, "", ""), (1080, [float("inf")] + [0.0] * 15, "", ""), (1100, [0.0] * 16, "", ""), (1120, [], "", ""), (None, rows[1][1], "", "")]
    want = brute(rows)
    monkeypatch.setattr(topk, "BUCKET", 50)
    monkeypatch.setattr(topk, "BLOCK", 10)
    monkeypatch.setattr(topk, "SEEDS", 40)
    got = {}
    for r in topk.op5_top_k(spark.createDataFrame(rows, VEC)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_plan_does_not_grow_with_the_queries(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, rng.normal(0, 1, 8).tolist(), "", "") for i in range(300)], VEC)
    few, many = (topk.top_k(df, F.col("vec_id") % 2 == 0, block=b, bucket=b) for b in (1000, 20))
    plans = [d._jdf.queryExecution().optimizedPlan().toString() for d in (few, many)]
    assert len({p.count("\n") for p in plans}) == 1 and "Union" not in plans[1]
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))


def test_few_and_none(spark):
    rows = [(0, [1.0, 2.0], "", ""), (1, [1.0, 0.5], "", "")]
    got = topk.op5_top_k(spark.createDataFrame(rows, VEC)).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 64 * 64 + 128 * 32)]
    assert topk.op5_top_k(spark.createDataFrame([], VEC)).count() == 0


def test_products_beyond_doubles():
    v = np.array([[float(2**40)] * 4])
    assert topk._products(v, np.array([float(2**20 + 1)] * 4))[0] == 4 * 2**40 * (2**20 + 1)


def test_blocks_of_demanding_queries_skip_short_buckets(spark, monkeypatch):
    rng = np.random.default_rng(11)
    seen = []
    visited = topk.visited

    def counted(queries, sizes, top):
        seen.append((queries.groupBy("block").count().collect(), sizes.agg(F.sum("cuts")).first()[0], visited(queries, sizes, top).count()))
        return visited(queries, sizes, top)

    monkeypatch.setattr(topk, "visited", counted)
    monkeypatch.setattr(topk, "SEEDS", 256)
    # lengths differ by a factor of fifty; a query's partners lie near its own direction or far from it
    centres = rng.normal(size=(40, 16))
    v = (centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16)) * rng.choice([0.05, 3.0], (3000, 1))) * np.exp(rng.uniform(-2, 2, (3000, 1)))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 3 == 0, k=5, block=50, bucket=20).collect()
    (blocks, buckets, pairs), = seen
    assert 20 <= len(blocks) <= 21 and max(r["count"] for r in blocks) <= 80
    assert pairs < 0.5 * len(blocks) * buckets
    whole = np.floor(64 * v)
    scores = (whole @ whole.T).astype(np.int64)
    found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in got}
    assert len(found) == len(got) == 5000
    for q in range(0, 3000, 3):
        best = sorted((-s, i) for i, s in enumerate(scores[q].tolist()) if i != q)[:5]
        assert [found[q, n + 1] for n in range(5)] == [(i, -s) for s, i in best]
