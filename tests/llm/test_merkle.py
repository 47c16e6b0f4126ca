"""The Merkle manifest against a tree built row by row, and against its SQL."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from partlens.llm import merkle

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, g string, h string, pos long, leaf string"


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text):
    fields = (row[0], row[1], row[2], row[3], text)
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def path(tree, i):
    out = []
    for level in tree[:-1]:
        b = i // 16 * 16
        out.append(("".join(level[b:i]), "".join(level[i + 1 : b + 16])))
        i //= 16
    return out


def expected(rows):
    lower = str.maketrans(merkle.UPPER, merkle.LOWER)
    by = defaultdict(list)
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), leaf(r, r[4].translate(lower)) if hit else leaf(r, r[4])))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(by[s])]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (there, doc_id, given, now) in enumerate(sorted(by[s])):
            steps = path(trees[s], i) + path(top, k)
            h = now
            for a, b in steps:
                h = H(a + h + b)
            out.append((doc_id if there else None, given, trees[s][-1][0], top[-1][0], H("".join(a + b for a, b in steps)), h, h == top[-1][0]))
    return Counter(out)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def got(df):
    return Counter(tuple(r) for r in merkle.op13_merkle(df).select(*COLUMNS).collect())


def odd_rows():
    rows = [(i, "big", "en", i, f"Text NUMBER {i}") for i in range(300)]  # three levels
    rows += [(i, "seventeen", "de", None, f"Ä{i}") for i in range(17)]  # a last run of one
    rows += [(7, None, None, None, None), (8, None, "en", 0, ""), (None, None, "en", 1, "A"), (None, "big", "en", 1, "B")]
    rows += [(5, f"s{i}", "en", 1, "ALONE") for i in range(20)]  # lone leaves; two levels of sources
    rows += [(1, "", "en", 1, "The empty source"), (5, "big", "en", 5, "Another with id 5"), *[(9, "same", "en", 3, "ABC")] * 18]
    rows += [(2, "long", "en", 3, "Very LONG text " * 20_000)]
    return rows


def test_against_row_by_row(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "x", "y", 3, "z") for r in rows], SCHEMA).repartition(5)
    assert got(df) == expected(rows)


def test_small_tables(spark):
    df = spark.createDataFrame([(3, "s", "en", 2, "Ab", None, None, None, None)], SCHEMA)
    (row,) = got(df)
    assert row[1] == row[2] == row[3] == leaf((3, "s", "en", 2), "Ab") and row[4] == H("")
    assert merkle.op13_merkle(df.limit(0)).count() == 0


def test_changes_are_seen(spark):
    """Any changed text leaves its proof; nothing else does."""
    rows = [(i, "s", "en", 1, f"text {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    out = merkle.manifest(df, F.when(F.col("doc_id") == 33, merkle.leaf_of(F.lit("other"))))
    bad = [r.doc_id for r in out.where(merkle.fold(F.col("now"), F.col("steps")) != F.col("root")).collect()]
    assert bad == [33]


@pytest.mark.parametrize("odd", [False, True])
def test_same_as_sql(spark, odd):
    con = duckdb.connect()
    if odd:
        df = spark.createDataFrame(odd_rows(), "doc_id long, source string, lang string, n_chars long, text string")
        table = df.toArrow()
        con.register("documents", table)
    else:
        df = spark.read.parquet(f"{DATA}/documents.parquet")
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    found = con.execute(merkle.OP13_SQL)
    at = [[c[0] for c in found.description].index(n) for n in COLUMNS]
    assert got(df) == Counter(tuple(r[i] for i in at) for r in found.fetchall())
