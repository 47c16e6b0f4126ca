"""Every registered query of the library against its SQL twin, on the smallest tables."""

import datetime
import os
from collections import Counter

import duckdb
import pytest

from partlens import plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def norm(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, float):
        return repr(round(x, 6) + 0.0) if x == x else "nan"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(norm, x)) + "]"
    return str(float(x)) if type(x).__name__ == "Decimal" else str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(norm(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_as_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    got = rows(df.columns, df.collect())
    found = duck.execute(plans.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    want = rows(names, found.fetchall())
    assert got == want, (list((got - want))[:3], list((want - got))[:3])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, DATA).count() > 0


@pytest.mark.parametrize("name", ["n01_box_mean", "n05_rank_median", "n20_gaussian", "p09_blend_min", "a05_local_otsu", "t09_match_template", "e05_reading_pipeline", "w06_reading_order"])
def test_plans_have_no_python_and_no_cartesian_product(spark, name):
    plan = plans.QUERIES[name](spark, DATA)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("PythonUDF", "ArrowEvalPython", "CartesianProduct", "MapInArrow", "MapInPandas"))


def test_one_exchange_serves_both_passes(spark):
    from partlens.operators import neighbours as N

    cells = spark.range(64).selectExpr("id % 3 AS grid_id", "CAST(id % 8 AS INT) AS x", "CAST(id / 8 AS INT) AS y", "CAST(id AS INT) AS v")
    plan = N.gather(cells, 3, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
