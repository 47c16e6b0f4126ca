"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of shuffled documents that may pass up to three times. A document's virtual
finish time is the words its source has served up to and including it, divided by the source's
target. Documents are taken in the order of that time until the total budget is used up.

Nothing is gathered by source: the shuffle key is a digest, its leading digits cut every source into
buckets of bounded size, and running sums are bucket sums plus sums inside a bucket. The cut at the
budget works likewise on buckets of virtual time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, plain, text_of

MOST_PASSES = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_PASSES) -> DataFrame:
    """source, source_size, target for a table of source, source_size (one row a source).

    Sources by code point, null last, weigh as in ``weights``, repeating. They share the sum of all
    sizes by weight; none gets over ``most`` times its size, and the excess goes to the others by
    weight. Sources that fill up are those with the smallest limit per weight, so running sums in
    that order give the level at which the rest share what is left: no iteration.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(order) - 1) % len(weights)
    df = sizes.withColumn("w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (nth + 1).cast("int")).cast("long"))
    df = df.withColumn("limit", F.lit(int(most)) * F.col("source_size"))
    everything = Window.partitionBy()
    by_limit = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
    df = df.withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    df = df.withColumn("full", F.col("limit") * F.col("w_left") <= F.col("left") * F.col("w"))
    # the first source that stays below its limit fixes the share of all after it
    df = df.withColumn("share", F.min(F.when(~F.col("full"), F.struct(F.col("limit") / F.col("w"), F.col("source").isNull(), "source", "left", "w_left"))).over(everything))
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(
        F.col("w") * F.col("share.left") / F.col("share.w_left")
    )
    return df.select("source", "source_size", target.alias("target"))


def _keyed(docs: DataFrame, seed: str) -> DataFrame:
    """Adds the size, the shuffle key and the content's digest."""
    return docs.withColumns({
        "content": F.md5(text_of().cast("binary")),
        "size": word_count(text_of()),
        "key": F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.md5(text_of().cast("binary")))), F.lit(":" + seed))),
    })


def _finish(p: Column) -> Column:
    """Virtual finish time of the document's pass p; 0 where nothing is to be served."""
    return F.coalesce(F.try_divide(p * F.col("source_size") + F.col("cumulative"), F.col("target")), F.lit(0.0))


class Schedule:
    """When each document of a table is served, and where the budget ends.

    The plan is made once, on (doc_id, source, size, digests) without the texts; ``mark`` then finds
    the decisions for any table of the same documents in one shuffle.

    Null or empty texts have size 0: they cost nothing and are taken once. A null source is a source
    of its own, the last. Ties in the shuffle key are broken by the content's digest; repeated rows are
    documents of their own, and it does not matter which of them is taken. An empty table gives none.
    """

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix", bucket_rows: int = 50_000):
        self.seed = seed
        light = _keyed(plain(docs, "doc_id", "source", "text"), seed).drop("text")
        self.light = materialize(light, "mix-sizes")
        rows, self.budget = self.light.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        self.digits = max(1, min(8, math.ceil(math.log(max(rows, 2) / bucket_rows, 16)) + 1))
        self.slots = max(16, math.ceil(4 * rows / bucket_rows))
        self.sums = materialize(self._bucket_sums(weights), "mix-buckets")
        self._find_cut()

    def _bucket_sums(self, weights: tuple[int, ...]) -> DataFrame:
        """source, bucket, words served before the bucket, source_size, target."""
        sums = self._bucketed(self.light).groupBy("source", "bucket").agg(F.sum("size").alias("words"))
        before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("served", F.coalesce(F.sum("words").over(before), F.lit(0)))
        goal = targets(self.light.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
        same = F.col("s.source").eqNullSafe(F.col("g.source"))
        return sums.alias("s").join(goal.alias("g"), same).select("s.source", "s.bucket", "s.served", "g.source_size", "g.target")

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.substring("key", 1, self.digits))

    def _served(self, df: DataFrame) -> DataFrame:
        """Adds source_size, target and cumulative: the words of the source up to each document."""
        inside = Window.partitionBy("source", "bucket").orderBy("key", "content").rowsBetween(Window.unboundedPreceding, 0)
        df = self._bucketed(df).withColumn("within", F.sum("size").over(inside)).alias("d")
        same = F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.bucket") == F.col("s.bucket"))
        df = df.join(self.sums.alias("s"), same).select("d.*", "s.source_size", "s.target", (F.col("s.served") + F.col("d.within")).alias("cumulative"))
        return df.drop("bucket", "within")

    def _find_cut(self) -> None:
        """The budget ends in one slot of virtual time; only that slot's passes need an order."""
        passes = self._served(self.light).withColumn("pass", F.explode(F.array(*[F.lit(i) for i in range(MOST_PASSES)])))
        passes = passes.withColumn("finish", _finish(F.col("pass"))).withColumn("slot", F.floor(F.col("finish") * self.slots))
        passes = passes.where(F.col("finish") <= 1.5)  # all sources reach their targets at 1, within a document
        per_slot = passes.groupBy("slot").agg(F.sum("size").alias("words"))
        per_slot = per_slot.withColumn("upto", F.sum("words").over(Window.orderBy("slot")))
        edge = per_slot.where(F.col("upto") > self.budget).orderBy("slot").first()
        self.cut = None
        if edge:
            room = self.budget - (edge["upto"] - edge["words"])
            order = Window.partitionBy("slot").orderBy("finish", "key", "content", "pass").rowsBetween(Window.unboundedPreceding, 0)
            last = passes.where(F.col("slot") == edge["slot"]).withColumn("upto", F.sum("size").over(order))
            at = last.where(F.col("upto") <= room).agg(F.max(F.struct("finish", "key", "content", "pass"))).first()[0]
            self.cut = tuple(at) if at else (edge["slot"] / self.slots, "", "", -1)

    def mark(self, docs: DataFrame) -> DataFrame:
        """Adds size, source_size, target, and times: the finish times of the passes that are taken."""
        df = self._served(_keyed(docs, self.seed) if "size" not in docs.columns else docs)

        def inside(p: Column) -> Column:
            if not self.cut:
                return _finish(p) <= 1.5
            now = F.struct(_finish(p).alias("finish"), F.col("key"), F.col("content"), p.alias("pass"))
            finish, key, content, last = self.cut
            return now <= F.struct(F.lit(float(finish)).alias("finish"), F.lit(key).alias("key"), F.lit(content).alias("content"), F.lit(int(last)).alias("pass"))

        times = F.array(*[F.when(inside(F.lit(p)), _finish(F.lit(p))) for p in range(MOST_PASSES)])
        times = F.when(F.col("size") > 0, F.array_compact(times)).otherwise(F.array(_finish(F.lit(0))))
        return df.withColumn("times", times).drop("key", "content", "cumulative")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix") -> DataFrame:
    """The mixed documents, range-sorted by virtual finish time and cut at the budget: a document that
    is taken n times stands n times. Columns as in ``docs``; edge cases as in ``Schedule``."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), "doc_id", "source", "text")
    marked = Schedule(docs, weights, seed).mark(_keyed(rows, seed).drop("text"))
    out = marked.select("row", F.explode("times").alias("finish"))
    return out.orderBy("finish").select("row.*")


def op2_mixing(docs: DataFrame) -> DataFrame:
    """For each document: its size, its source's size and target, and the words the mix takes of it."""
    plan = Schedule(docs)
    taken = F.col("size") * F.size("times")
    target = F.coalesce("target", F.lit(0.0))
    return plan.mark(plan.light).select("doc_id", "size", "source_size", target.alias("target"), taken.alias("taken"))


OP2_SQL = r"""
WITH l AS (SELECT doc_id, source, md5(coalesce(text, '')) AS content, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '-' || md5(coalesce(text, ''))) || ':mix') AS key FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM l GROUP BY source),
s1 AS (SELECT *, 3 * source_size AS lim, 1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS w FROM s0),
s2 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER b, 0))::BIGINT AS lft, (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::BIGINT AS wl
       FROM s1 WINDOW b AS (ORDER BY lim / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, lim * wl <= lft * w AS is_full FROM s2),
s4 AS (SELECT lft, wl FROM s3 WHERE NOT is_full ORDER BY lim / w, encode(source) NULLS LAST LIMIT 1),
s AS (SELECT source, source_size, CASE WHEN is_full THEN lim::DOUBLE ELSE (w * s4.lft)::DOUBLE / s4.wl END AS target FROM s3 LEFT JOIN s4 ON true),
c AS (SELECT l.*, s.source_size, s.target, sum(size) OVER (PARTITION BY l.source ORDER BY key, content ROWS UNBOUNDED PRECEDING)::BIGINT AS cum
      FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source),
p AS (SELECT *, coalesce((pass * source_size + cum)::DOUBLE / nullif(target, 0), 0) AS finish FROM c, range(0, 3) AS r(pass)),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, key, content, pass ROWS UNBOUNDED PRECEDING) AS upto FROM p),
t AS (SELECT doc_id, source, content, sum(size)::BIGINT AS taken FROM o WHERE upto <= (SELECT sum(size) FROM l) GROUP BY ALL)
SELECT c.doc_id, c.size, c.source_size, c.target, coalesce(t.taken, 0) AS taken
FROM c LEFT JOIN t ON c.doc_id IS NOT DISTINCT FROM t.doc_id AND c.content = t.content AND c.source IS NOT DISTINCT FROM t.source
"""
