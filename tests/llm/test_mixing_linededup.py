import hashlib
import random

import duckdb
import pandas as pd
import pyarrow as pa
import pytest

from partlens.llm import linededup, mixing

SCHEMA = "doc_id long, text string, source string, n_chars long, size string"


def duck(rows, sql):
    con = duckdb.connect()
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source", "n_chars", "size"]).astype({"doc_id": "Int64"})
    con.register("documents", documents)
    return sorted(con.execute(sql).fetchall(), key=str)


def rows_of(n=400):
    out = [(i, " ".join(["w"] * (i * 37 % 50 + 1)), f"s{i % 7 if i % 3 else 0}", 1, "clash") for i in range(n)]
    out += [(None, f"no id {i} here", "s2", 1, "") for i in range(6)]
    return [*out, (1000, "null source here", None, 1, ""), (1001, "", "s1", 0, ""), (1002, "w " * 3000, "tiny", 0, "")]


def test_mix_matches_sql(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.op2_mixing(df).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, got), key=str) == duck(rows, mixing.OP2_SQL)
    taken, target, size = {}, {}, {}
    assert sum(r.doc_id is None and r.taken > 0 for r in got) > 2
    got = [r for r in got if r.doc_id is not None]
    rows = [r for r in rows if r[0] is not None]
    source = {r[0]: r[2] for r in rows}
    for r in got:
        assert r.taken <= 3 * r.size
        s = source[r.doc_id]
        taken[s] = taken.get(s, 0) + r.taken
        target[s], size[s] = r.target, r.source_size
    assert sum(target.values()) == pytest.approx(sum(size.values()), rel=0.01)
    for s in taken:
        assert target[s] <= 3 * size[s] and abs(taken[s] - target[s]) <= 3000


def test_mix_rows(spark):
    df = spark.createDataFrame([*rows_of(60), (5, "same id other text", "s5", 1, ""), (None, None, None, None, None)], SCHEMA)
    one = mixing.mix(df)
    assert one.columns == df.columns
    a, b = sorted(map(str, one.collect())), sorted(map(str, mixing.mix(df.repartition(3)).collect()))
    assert a == b
    taken = {r.doc_id: r.taken for r in mixing.op2_mixing(df).where("doc_id > 5").collect()}
    counts = {r.doc_id: r["count"] for r in one.groupBy("doc_id").count().collect()}
    sizes = {r.doc_id: r.size for r in mixing.op2_mixing(df).collect()}
    assert all(counts.get(i, 0) * sizes[i] == t for i, t in taken.items())
    assert mixing.mix(df.limit(0)).count() == 0


def passage(k, n=60):
    return " ".join(f"p{k}w{i}" for i in range(n))


def test_line_dedup_matches_sql(spark):
    own = lambda i: "\n".join(f"line {i} {j} " + "x " * (j % 9) for j in range(12))
    rows = [(i, own(i) + "\n" + passage(i % 3) + "\n" + own(i + 100), "s", 1, "") for i in range(30)]
    rows += [(50, rows[0][1], "s", 1, ""), (50, "other", "s", 1, ""), (51, None, None, None, None), (52, "", "s", 0, ""), (None, passage(1), "s", 0, "")]
    rows += [(60, passage(9, 30000), "s", 0, ""), (61, "intro\n" + passage(9, 30000) + "\n" + passage(9, 30000), "s", 0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = linededup.op1_line_dedup(df).collect()
    assert sorted(map(tuple, got), key=str) == duck(rows, linededup.OP1_SQL)
    text = {(r.doc_id, r.text) for r in got}
    assert sum(passage(2) in t for _, t in text) == 1
    assert sum(passage(9, 30000) in t for _, t in text) == 1
    again = linededup.dedup_lines(df)
    assert again.columns == df.columns and again.count() == len(rows)
    assert sorted(str(r.text or "") for r in again.collect()) == sorted(r.text for r in got)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert linededup.op1_line_dedup(df).count() == 0 and mixing.op2_mixing(df).count() == 0


def test_shifted_multi_line_passage(spark):
    block = "\n".join(" ".join(f"b{j}c{i}" for i in range(12)) for j in range(40))
    rows = [(i, "\n".join(f"own {i} {j}" for j in range(i)) + "\n" + block, "s", 1, "") for i in range(1, 9)]
    out = {r.doc_id: r.text for r in linededup.op1_line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert block in out[1]
    assert all(len(out[i]) < 0.2 * len(block) for i in range(2, 9))  # all but the chunks at its edges


def repeated_lines(rows, least=20):
    """Brute force: what is left of each text without the lines of runs of lines that occur before."""
    texts = sorted({(r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest(), r[1] or "") for r in rows})
    seen, out = {}, {}
    for d, (_, _, _, text) in enumerate(texts):
        lines = text.split("\n")
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                seen.setdefault(tuple(lines[a : b + 1]), (d, a))
    for d, (known, doc_id, _, text) in enumerate(texts):
        lines, gone = text.split("\n"), set()
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                run = lines[a : b + 1]
                if run[0].split() and run[-1].split() and sum(len(x.split()) for x in run) >= least and seen[tuple(run)] < (d, a):
                    gone.update(range(a, b + 1))
        left = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out[doc_id if known else None, text] = left if left.split() or not gone else ""
    return out


def test_repeated_passages_go_up_to_their_edges(spark):
    deal = random.Random(3)
    line = lambda: " ".join(deal.choice("abcdefgh") + str(deal.randrange(90)) for _ in range(deal.choice([3, 8, 14, 25])))
    blocks = [[line() if j % 4 else deal.choice(["", line()]) for j in range(deal.randrange(3, 9))] for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [[line() for _ in range(deal.randrange(3))] + (b := deal.choice(blocks))[deal.randrange(2) : len(b) - deal.randrange(2)] for _ in range(3)]
        rows.append((i // 2, "\n".join(x for p in parts for x in p), "s", 1, ""))
    short = "\n".join(f"short {j} " + "y " * 9 for j in range(6))  # 66 words, no line over 30
    rows += [(100 + i, f"before {i}\n{short}\nafter {i}", "s", 1, "") for i in range(8)] + [(None, rows[5][1], "s", 1, ""), (7, None, "s", 1, ""), rows[3]]
    want = repeated_lines(rows)
    docs = spark.createDataFrame([(*r[:4], f"{r[0]} {r[1] or ''}") for r in rows], SCHEMA)
    got = linededup.dedup_lines(docs).collect()
    assert len(got) == len(rows)
    before = {f"{r[0]} {r[1] or ''}": (r[0], r[1] or "") for r in rows}
    assert all((r.text or "") == want[before[r.size]] for r in got)
    assert sum(short in (r.text or "") for r in got) == 1
    assert {r.text for r in got if (r.doc_id or 0) > 100} == {f"before {i}\nafter {i}" for i in range(1, 8)}


def test_words_parted_by_tabs_count(spark):
    line = "\t".join(f"t{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"own {i}\n{line}\nend {i}", "s", 1, "") for i in range(3)] + [(9, line, "s", 1, "")], SCHEMA)
    got = {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()}
    assert got == {0: f"own 0\n{line}\nend 0", 1: "own 1\nend 1", 2: "own 2\nend 2", 9: ""}


def test_stage_takes_chunks_first_and_checks_the_rest(spark, monkeypatch):
    """Repeated chunks go by the method's own cuts; runs of lines are compared only beyond them, with the same result."""
    block = "\n".join(["", *(" ".join(f"b{j}c{i}" for i in range(12)) for j in range(40)), ""])
    rows = [(i, "\n".join(f"own {i} {j}" for j in range(i)) + "\n" + block + f"\nend {i}", "s", 1, "") for i in range(1, 9)]
    docs = spark.createDataFrame(rows, SCHEMA)
    gone, runs = [], []
    kept_gone, kept_later = linededup._gone, linededup._later

    def later(base, compared, place, equal, light=None):
        if light is not None:
            runs.append(light.count())
        return kept_later(base, compared, place, equal, light)

    monkeypatch.setattr(linededup, "_gone", lambda *a: gone.append(kept_gone(*a)) or gone[-1])
    monkeypatch.setattr(linededup, "_later", later)
    got = {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()}
    want = repeated_lines(rows)
    assert all(got[r[0]] == want[r[0], r[1]] for r in rows)
    taken = {}
    for r in gone[0].collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.last - r.first + 1
    assert 1 not in taken and all(taken[i] >= 30 for i in range(2, 9))  # of 40 lines
    everything = sum(len(x) for x in linededup._runs(pa.array([r[1] for r in rows]), 20).to_pylist())
    assert runs[0] < 0.6 * everything
