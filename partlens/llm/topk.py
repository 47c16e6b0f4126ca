"""Exact top-k search by inner product, with candidates grouped by length.

Candidates are dealt to buckets of like length and bounded size. A query carries a lower bound of its
k-th best score. In a bucket whose longest vector has length l the bound gives a local cosine
threshold, bound / (|q| l): above 1 the bucket is skipped; where it is high, the sorted coordinates of
the bucket leave only vectors that can reach it (coordinate pruning); else the vectors sorted by length
do (length pruning). What is left is verified by its products.

Queries are a table too, sorted by the least length that a vector needs to reach their bound and cut into blocks of
bounded size. So the queries of a block need like lengths, and a demanding block skips all shorter buckets. A block meets
a bucket where one of its queries can reach its bound with the bucket's lengths; each such pair of a block and a bucket is
one group of one grouping, so neither the plan nor what a task or the driver holds grows with the number of queries. The
first bounds are computed on the executors against a fixed number of vectors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, plain

SCALE = 64
K = 20
BLOCK = 32768  #: queries in a block, about: 16 MB at 64 dimensions; each block is sent the vectors it may need
BUCKET = 4096  #: candidates in a bucket, about
SEEDS = 4096  #: longest vectors, and as many hash-chosen ones, that give the first bounds
PER_DOUBLING = 8  #: steps of squared length in a doubling of it
COORDINATE_FROM = 0.35  #: local cosine threshold from which coordinates prune better than lengths


def usable(v: Column) -> Column:
    """Not null, and all components there and finite."""
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(ok, F.lit(False))


def quantized(vectors: DataFrame) -> DataFrame:
    """vec_id, v = floor(64 x) as doubles, and n2, the squared length."""
    rows = plain(vectors, "vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    scaled = F.transform("embedding", lambda x: F.rint(F.lit(float(SCALE)) * x.cast("double") - 0.5))
    # rint(y - 0.5) is floor(y) but where y is whole or just below it; put those right
    exact = F.transform(F.arrays_zip(F.col("embedding").alias("x"), scaled.alias("r")), lambda z: _floor(F.lit(float(SCALE)) * z["x"].cast("double"), z["r"]))
    out = rows.select("vec_id", exact.alias("v"))
    return out.withColumn("n2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))


def _floor(y: Column, r: Column) -> Column:
    return F.when(r > y, r - 1.0).when(r + 1.0 <= y, r + 1.0).otherwise(r)


def _matrix(t: pa.Table | pa.RecordBatch, width: int | None = None) -> np.ndarray:
    """Vectors as rows; shorter ones are padded with zeros, which add nothing to a product."""
    col = t.column("v")
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    ends = col.offsets.to_numpy().astype(np.int64)
    n = np.diff(ends)
    flat = col.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]] if len(n) else np.zeros(0)
    width = width or int(max(n, default=0))
    out = np.zeros((len(n), width))
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], n)
    inside = place < width
    out[row[inside], place[inside]] = flat[inside]
    return out


def _products(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whole numbers; beyond what doubles hold exactly, by Python's integers and held to 64 bits."""
    most = float(np.abs(c).max(initial=0.0)) * float(np.abs(q).max(initial=0.0)) * max(1, c.shape[1])
    if most < 2**53:
        return (c @ q).astype(np.int64)
    whole = [[int(x) for x in row] for row in c]
    other = [int(x) for x in q]
    sums = [sum(a * b for a, b in zip(row, other, strict=True)) for row in whole]
    return np.array([max(-(2**63), min(2**63 - 1, s)) for s in sums], np.int64)


class Bucket:
    """Candidates of like length, longest first."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        length = np.sqrt((v * v).sum(1))
        order = np.lexsort((ids, -length))
        self.ids, self.v, self.length = ids[order], v[order], length[order]
        self.unit = self.v / np.maximum(self.length, 1e-300)[:, None]
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.sorted:
            order = np.argsort(self.unit[:, f])
            self.sorted[f] = order, self.unit[order, f]
        return self.sorted[f]

    def candidates(self, q: np.ndarray, bound: float) -> np.ndarray | slice:
        """Places of the vectors whose product with q may reach the bound."""
        norm = math.sqrt(float(q @ q))
        if not len(self.ids) or bound > norm * self.length[0] * (1 + 1e-9):
            return slice(0, 0)
        if bound <= 0 or norm == 0:
            return slice(None)
        local = min(1.0, bound / (norm * self.length[0]))
        if local < COORDINATE_FROM:
            return slice(0, int(np.searchsorted(-self.length, -bound / norm * (1 - 1e-9), "right")))
        best: np.ndarray | None = None
        wide = math.acos(local)
        for f in np.argsort(-np.abs(q))[:3]:
            angle = math.acos(max(-1.0, min(1.0, float(q[f]) / norm)))
            low, high = math.cos(min(math.pi, angle + wide)) - 1e-9, math.cos(max(0.0, angle - wide)) + 1e-9
            order, values = self.coordinate(int(f))
            got = order[np.searchsorted(values, low) : np.searchsorted(values, high, "right")]
            if best is None or len(got) < len(best):
                best = got
        return best

    def best(self, own: int, q: np.ndarray, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k best, of those that reach the bound."""
        at = self.candidates(q, bound)
        ids, score = self.ids[at], _products(self.v[at], q)
        keep = (ids != own) & (score >= bound)
        ids, score = ids[keep], score[keep]
        if len(ids) > k:
            low = np.partition(score, len(score) - k)[len(score) - k]
            ids, score = ids[score >= low], score[score >= low]
        order = np.lexsort((ids, -score))[:k]
        return ids[order], score[order]


def _search(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        q = _matrix(queries)
        bucket = Bucket(candidates.column("vec_id").to_numpy(), _matrix(candidates, q.shape[1]))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for own, v, bound in zip(queries.column("vec_id").to_numpy(), q, queries.column("bound").to_numpy(), strict=True):
            got, score = bucket.best(own, v, bound, k)
            if len(got):
                out.append((np.full(len(got), own), got, score))
        cols = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else ((), (), ()))]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    return run


def _bounded(seeds: list[tuple[np.ndarray, np.ndarray]], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, q = batch.column("vec_id").to_numpy(), _matrix(batch)
            bound = np.full(len(ids), -np.inf)
            for of, c in seeds:
                for i in range(0, len(ids), 64):
                    bound[i : i + 64] = np.maximum(bound[i : i + 64], _first_bounds(ids[i : i + 64], q[i : i + 64], of, c, k))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bound)], names=[*batch.schema.names, "bound"])

    return run


def _first_step() -> Column:
    """The lowest step whose vectors may be long enough for a query's bound, less one for rounding."""
    least = F.when((F.col("bound") > 0) & (F.col("n2") > 0), F.col("bound") * F.col("bound") / F.col("n2") * (1 - 1e-9)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0), F.floor(F.log2(least + 1) * PER_DOUBLING).cast("int") - 1)


def in_blocks(queries: DataFrame, block: int) -> DataFrame:
    """Adds ``block``: queries in the order of their first step, about ``block`` of them each. Queries of one step are
    spread over its blocks by a hash, however many there are."""
    # a row a step: at most PER_DOUBLING for each of the 1024 doublings of a double, so one task and a broadcast hold them
    steps = queries.groupBy("first").agg(F.count("*").alias("n"))
    steps = steps.withColumn("before", F.sum("n").over(Window.orderBy("first")) - F.col("n"))
    place = F.col("before") + F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("n"))
    return queries.join(F.broadcast(steps), "first").withColumn("block", F.floor(place / block).cast("int")).drop("n", "before")


def visited(queries: DataFrame, sizes: DataFrame, top: int) -> DataFrame:
    """block, step, cut: the buckets whose vectors may be long enough for one of a block's queries."""
    out = queries.groupBy("block").agg(F.min("first").alias("first"))
    out = out.select("block", F.explode(F.sequence("first", F.lit(top))).alias("step")).join(sizes, "step")
    return out.select("block", "step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("cut"))


def top_k(vectors: DataFrame, is_query: Column, k: int = K, block: int | None = None, bucket: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products, ties to the smaller vec_id.

    Vectors that are null or hold null or non-finite components, and rows without an id, take no part. Vectors
    of unequal sizes meet in their common components. Rows that share a query's id count as its own. Empty
    vectors score 0; products beyond 64 bits are held to the largest or smallest long; an empty table gives no rows.
    """
    block, bucket = block or BLOCK, bucket or BUCKET
    step = F.floor(F.log2(F.col("n2") + 1) * PER_DOUBLING).cast("int")
    rows = materialize(quantized(vectors).withColumn("step", step), "vectors")
    # like lengths: steps of 1/16 of a doubling; crowded steps are cut by a hash of the id
    sizes = rows.groupBy("step").agg(F.ceil(F.count("*") / bucket).alias("cuts"))
    total, top = rows.agg(F.count("*"), F.max("step")).first()
    top = top or 0
    longest = rows.orderBy(F.desc("n2"), "vec_id").limit(SEEDS).select("vec_id", "v").toArrow()
    share = min(1.0, SEEDS / max(1, total))
    drawn = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1_000_000)) < int(1_000_000 * share) + 1).select("vec_id", "v").limit(2 * SEEDS).toArrow()
    seeds = [(t.column("vec_id").to_numpy(), _matrix(t)) for t in (longest, drawn)]
    queries = rows.where(is_query).select("vec_id", "v", "n2")
    queries = materialize(queries.mapInArrow(_bounded(seeds, k), "vec_id long, v array<double>, n2 double, bound double"), "queries")
    queries = in_blocks(queries.withColumn("first", _first_step()).where(F.col("first") <= top), block)
    visits = visited(queries, sizes, top)
    visits = materialize(visits, "visits")
    dealt = rows.join(sizes, "step").withColumn("cut", F.pmod(F.xxhash64("vec_id"), F.col("cuts")))
    dealt = dealt.join(visits, ["step", "cut"]).select("block", "step", "cut", "vec_id", "v")
    sent = queries.join(visits, "block").select("block", "step", "cut", "vec_id", "v", "bound")
    key = ["block", "step", "cut"]
    found = sent.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _first_bounds(ids: np.ndarray, q: np.ndarray, of: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query over some candidates: no more than over all."""
    width = min(c.shape[1], q.shape[1]) if len(of) else 0
    if len(of) <= k or float(np.abs(c).max(initial=0.0)) * float(np.abs(q).max(initial=0.0)) * max(1, width) >= 2**53:
        return np.full(len(ids), -np.inf)  # no bound is a bound
    score = q[:, :width] @ c[:, :width].T
    score[ids[:, None] == of[None, :]] = -np.inf
    return np.partition(score, len(of) - k, axis=1)[:, len(of) - k]


def op5_top_k(vectors: DataFrame) -> DataFrame:
    return top_k(vectors, F.col("vec_id") % 20 == 0)


OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
