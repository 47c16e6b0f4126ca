import random
from collections import Counter

import numpy as np
import pytest

from partlens.llm import neardup
from partlens.llm.components import components

SCHEMA = "doc_id long, text string, content string, total string"


def shingle_counts(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def classes(rows, weight=lambda s: 1.0, threshold=0.8):
    """Brute force over all pairs of different texts."""
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(t or "", []).append(i)
    keys = list(texts)
    counts = [shingle_counts(t) for t in keys]
    parent = list(range(len(keys)))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a in range(len(keys)):
        for b in range(a):
            if not counts[a] or not counts[b]:
                continue
            common = sum(weight(s) * min(n, counts[b][s]) for s, n in counts[a].items() if s in counts[b])
            every = sum(weight(s) * n for s, n in counts[a].items()) + sum(weight(s) * n for s, n in counts[b].items()) - common
            if common >= threshold * every:
                parent[find(a)] = find(b)
    groups = {}
    for k, t in enumerate(keys):
        groups.setdefault(find(k), []).extend(texts[t])
    return {i: min(g) for g in groups.values() for i in g}


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}x" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = []
    # a large group of near copies with one to six words changed, so that many pairs are just below the threshold
    base = words(rng, 100)
    for i in range(160):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 6])):
            w[rng.randrange(100)] = f"z{rng.randrange(40)}"
        if i % 10 == 0:
            w = w[: rng.randrange(80, 100)]
        out.append(" ".join(w))
    # a passage that many documents share
    passage = words(rng, 50)
    out += [" ".join(words(rng, 60, 5000) + passage) for _ in range(60)]
    out += [" ".join(words(rng, rng.randrange(5, 300), 5000)) for _ in range(60)]
    out += [out[0]] * 5 + [None, "", "", " \n ", "one two", "one two", "One  TWO", "three four", "a b c d e"]
    long = words(rng, 20_000, 9000)
    out += [" ".join(long), " ".join(long[:10_000] + ["changed"] + long[10_001:])]
    return [(i * 3 % 1009, t, "clash", None) for i, t in enumerate(out)]


def test_classes(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.class_id for r in neardup.op4_near_dedup(df).collect()}
    near = neardup.NearDuplicates(df)
    level = near.weights.astype(float)
    # the same weights, by brute force: every shingle's bucket
    ids = {}
    for _, t, *_ in rows:
        w = (t or "").lower().split()
        ids.update({s: None for s in shingle_counts(t)} if w else {})
    order = list(ids)
    hashed = spark.createDataFrame([(i, " ".join(s)) for i, s in enumerate(order)], "i long, t string").selectExpr("i", "transform(split(t, ' '), w -> xxhash64(w)) AS h").collect()
    for r in hashed:
        a = np.array(r.h, np.int64)
        _, shingle, _ = neardup.shingles(a, np.array([0, len(a)]))
        ids[order[r.i]] = level[neardup._bucket(shingle)][0]
    assert got == classes(rows, ids.get)


def test_kept_and_columns(spark, rows):
    df = spark.createDataFrame([*rows, rows[0], (None, "null id text here now", "c", "t"), (None, None, None, None)], SCHEMA)
    out = neardup.drop_near_duplicates(df)
    assert out.columns == df.columns
    got = sorted(str(r.doc_id) for r in out.collect())
    want = {c for c in classes(rows).values()}
    assert len(got) == len(set(got)) + (got.count("None") > 1) and {int(x) for x in got if x != "None"} >= want - {r[0] for r in rows if not (r[1] or "").strip()}
    assert neardup.op4_near_dedup(df.limit(0)).count() == 0


def test_no_class_is_gathered_in_one_task(spark, rows):
    near = neardup.NearDuplicates(spark.createDataFrame(rows[:40] + [(None, rows[0][1], "c", "t"), (None, "no id here", "c", "t")], SCHEMA))
    out = near.assigned()
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "collect" not in plan
    got = out.collect()
    assert len(got) == 42 and {r.doc_id for r in got if r.kept} == {r.class_id for r in got}
    assert all(r.class_id == min(x.doc_id for x in got if x.class_id == r.class_id and x.doc_id is not None) for r in got if r.class_id is not None)


def test_components(spark):
    rng = random.Random(1)
    edges = [(f"{rng.randrange(80):03d}", f"{rng.randrange(80):03d}") for _ in range(60)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)]
    comp = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: c for x, c in comp.items() if any(a != b and x in (a, b) for a, b in edges)}


def family(n, values, links=0, seed=4):
    """Documents of one template of 40 words with two fields; pairs that share a field are just no links. ``links`` of them
    come with a copy whose last word differs."""
    rng = random.Random(seed)
    base = words(rng, 40, 100_000)
    picks = rng.sample(range(values * values), n)
    out = []
    for k, i in enumerate(picks):
        w = list(base)
        w[10], w[28] = f"a{i % values}", f"b{i // values}"
        out.append(" ".join(w))
        if k < links:
            out.append(" ".join([*w[:-1], "other"]))
    return [(i, t, "c", None) for i, t in enumerate(out)]


def test_pairs_grow_with_the_documents(spark, monkeypatch):
    """Families of a template in which groups that share a field grow with the documents, and no pair is a link."""
    made = []
    join = neardup.NearDuplicates._join
    monkeypatch.setattr(neardup.NearDuplicates, "_join", lambda self, pairs, *rest: made.append(pairs.count()) or join(self, pairs, *rest))
    of = {}
    for n in (500, 2000):
        made.clear()
        got = neardup.op4_near_dedup(spark.createDataFrame(family(n, 48), SCHEMA)).collect()
        assert all(r.kept for r in got)
        of[n] = sum(made)
    assert all(made < 20 * n for n, made in of.items()), of


def test_links_in_a_family_are_found(spark):
    """In the same family, pairs that are links, among groups that are split."""
    rows = family(600, 25, links=120)
    got = {r.doc_id: r.class_id for r in neardup.op4_near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == classes(rows)


def test_split_groups_lose_nothing(spark, monkeypatch, rows):
    """With every group split down to pairs, the classes are the same."""
    df = spark.createDataFrame(rows[:280], SCHEMA)
    want = {r.doc_id: r.class_id for r in neardup.op4_near_dedup(df).collect()}
    monkeypatch.setattr(neardup, "FEW", 2)
    assert {r.doc_id: r.class_id for r in neardup.op4_near_dedup(df).collect()} == want


def test_splits_take_a_node_once(spark):
    near = neardup.NearDuplicates.__new__(neardup.NearDuplicates)
    near.percent = 80
    e = lambda i: i << 8 | 64
    texts = {"h": range(20), "a": [*range(6, 20), 30, 31, 40, 41], "b": [*range(6, 20), 30, 31, 50], "c": [*range(5, 20), 30, 60]}
    of = {k: [e(i) for i in v] for k, v in texts.items()}
    elements = spark.createDataFrame([(k, v, 64 * len(v)) for k, v in of.items()], "content string, elements array<long>, total long")
    alone = {k: [x for x in v if sum(x in o for o in of.values()) == 1] for k, v in of.items()}
    ranked = spark.createDataFrame([(k, alone[k] + [x for x in v if x not in alone[k]], len(alone[k])) for k, v in of.items()], "content string, elements array<long>, single int")
    comps = spark.createDataFrame([(k, k) for k in of], "content string, comp string")
    # three groups of two pivots with the same nearest node; c is open and early enough for nodes that are not open only
    rows = [(p, 0, g, k, 64 * len(of[k]), k, 1, True, k != "c", ("h", "h", 1280)) for p, g in (("p", 1), ("p", 2), ("q", 1)) for k in "abc"]
    rows = spark.createDataFrame(rows, "pivot string, lost int, element long, content string, total long, comp string, open int, as_open boolean, as_any boolean, b struct<content:string,comp:string,total:long>")
    got = near._split(rows, ranked, elements, comps).collect()
    assert {r.pivot for r in got} == {"h"} and len({(r.content, r.lost, r.element) for r in got}) == len(got) and {r.content for r in got} == set("abc")
    gone = {k: [x for x in of["h"] if x not in v] for k, v in of.items()}
    for r in got:
        gained = [x for x in of[r.content] if x not in of["h"]]
        assert r.d == 64 * (len(gained) + len(gone[r.content]))  # all of the difference, with elements that make no rows
        assert r.element in (gone[r.content] if r.lost else set(gained) - set(alone[r.content]))
        assert r.rest <= r.d - 64 * len(set(alone[r.content]) - set(of["h"]))


def test_pairs_with_one_open_node_stay(spark):
    """A pair of an open node, early enough as an open one only, and one that is not open."""
    near = neardup.NearDuplicates.__new__(neardup.NearDuplicates)
    near.percent = 80
    rows = [("p", "a", "a", 1, 1000, 300, 0, 7, 300, True, False), ("p", "b", "p", 0, 1000, 100, 0, 7, 100, True, True)]
    rows += [("p", "c", "c", 1, 1000, 300, 0, 8, 300, True, False), ("p", "d", "p", 0, 1000, 100, 0, 8, 20, True, True)]  # d has too little left
    rows += [("p", "e", "e", 1, 1000, 300, 0, 9, 300, True, False), ("p", "f", "f", 1, 1000, 300, 0, 9, 300, True, False)]  # none that any may meet
    rows = spark.createDataFrame(rows, "pivot string, content string, comp string, open int, total long, d long, lost int, element long, rest long, as_open boolean, as_any boolean")
    early = near._early_enough(rows)
    assert {(r.content, r.as_open, r.as_any) for r in early.collect()} == {("a", True, False), ("b", False, True)}
    assert [(r.element, r.opens) for r in near._groups(early).collect()] == [(7, 1)]
    got = near._by_difference(early).collect()
    assert [(r.a, r.b) for r in got] == [("a", "b")]


def test_only_groups_of_many_pairs_are_split(spark, monkeypatch):
    """Forty open nodes of which each may be linked to the nearest one only, forty that may all be linked to each other, and
    these once more, in a group too large to be counted."""
    near = neardup.NearDuplicates.__new__(neardup.NearDuplicates)
    near.percent = 80
    group = lambda p, first, rest, d: [(p, i, i, 1, 1000, d if i == first else 300, 0, p, rest, True, True) for i in range(first, first + 40)]
    rows = group(1, 100, 170, 240) + group(2, 200, 300, 300)
    comps = spark.createDataFrame([(r[1], r[1]) for r in rows], "content long, comp long")
    schema = "pivot long, content long, comp long, open int, total long, d long, lost int, element long, rest long, as_open boolean, as_any boolean"
    made, split = [], []
    monkeypatch.setattr(neardup.NearDuplicates, "_join", lambda self, pairs, elements, comps: made.append({(r.a, r.b) for r in pairs.collect()}) or (0, 0, comps))
    monkeypatch.setattr(neardup.NearDuplicates, "_split", lambda self, rows, *rest: split.append({r.pivot for r in rows.collect()}) or rows.where("false"))
    near._settle(spark.createDataFrame(rows, schema), None, None, comps)
    assert split == [{2}]
    assert made[1] == {(100, i) for i in range(101, 140)}
    made.clear(), split.clear()
    monkeypatch.setattr(neardup, "COUNTED", 39)
    near._settle(spark.createDataFrame(rows, schema), None, None, comps)
    assert split == [{1, 2}] and made[1] == set()
    made.clear(), split.clear()
    monkeypatch.setattr(neardup, "LEVELS", 0)
    near._settle(spark.createDataFrame(rows, schema), None, None, comps)
    assert not split and len(made[1]) == 39 + 780


def test_first_round_needs_no_tables_of_open_buckets(spark, monkeypatch, rows):
    """Every bucket is open then and led by its pivot; nodes are numbers in all that follows."""
    wrote, write = [], neardup.materialize
    monkeypatch.setattr(neardup, "materialize", lambda df, name: wrote.append((name, dict(df.dtypes))) or write(df, name))
    neardup.op4_near_dedup(spark.createDataFrame(rows[:60], SCHEMA))
    names = [n for n, _ in wrote]
    assert not {"near-now", "near-heads", "near-open", "near-lead"} & set(names[: names.index("near-pairs")])
    assert all(kinds.get("content", "bigint") == "bigint" for _, kinds in wrote[names.index("near-sizes") :])
