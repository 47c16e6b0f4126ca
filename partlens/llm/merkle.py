"""Manifest of a table as a Merkle tree, by slot pivots.

Each document is a leaf; the leaves of a source, by doc_id, are the lowest level of the source's tree, and the
roots of the sources are the lowest level of the table's tree. A node has ``FANOUT`` children, each in a slot. A
level is one grouping by parent: conditional aggregates spread the children into one column a slot. All columns joined
and hashed give the parent; all but a child's own give its siblings. On the way down each row of slots is opened
again, with the siblings of all levels above, so a leaf meets its whole proof without a join of its own.

Nothing is sorted in one place: positions come from a range sort of all leaves and the counts of its partitions, so a
source with a third of all rows spreads like the rest. The driver reads three numbers and the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, plain

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of one partition in ``monotonically_increasing_id``.
IN_PARTITION = 33


def field(value: Column) -> Column:
    """A value so that neighbours cannot be mistaken for parts of it: its length in bytes, a colon and itself."""
    s = value.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_of(text: Column) -> Column:
    return digest(*[field(text if n == "text" else F.col(n)) for n in FIELDS])


def placed(rows: DataFrame, group: str, *order: str) -> tuple[DataFrame, int]:
    """Adds pos, the place from 0 of each row in its group, and n, the group's rows; also gives the largest n. Equal rows
    take places in any order.

    Rows are range-sorted by group and order; a row's place is its place in its partition, less that of its group's first
    row there, plus the group's rows in the partitions before."""
    at = F.monotonically_increasing_id()
    cut = materialize(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", at), "leaves")
    cut = cut.withColumn("_part", F.shiftright("_at", IN_PARTITION))
    parts = cut.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = materialize(parts.select(group, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("n")), "leaf-counts")
    most = parts.agg(F.max("n")).first()[0] or 0
    return cut.join(parts, [group, "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift"), most


def joined(first: int, last: int) -> str:
    """The digests in the slots ``first`` to ``last`` - 1 beside each other; empty slots add nothing."""
    return f"concat_ws('', {', '.join(f'c{i}.h' for i in range(first, last)) or 'NULL'})"


def pivot(nodes: DataFrame) -> DataFrame:
    """Parents of nodes (g, pos, n, item): g, pos and n of the parent, its slots c0, c1, ... and its digest h."""
    slots = [F.expr(f"max(CASE WHEN pos % {FANOUT} = {i} THEN item END) AS c{i}") for i in range(FANOUT)]
    up = nodes.groupBy("g", F.floor(F.col("pos") / FANOUT).alias("pos"), F.ceil(F.col("n") / FANOUT).alias("n")).agg(*slots)
    return up.withColumn("h", F.expr(f"sha2({joined(0, FANOUT)}, 256)"))


class Tree:
    """The levels of the trees of all groups at once. ``nodes`` have g, pos, n and item, a struct with the digest h; no group
    has more than ``most`` of them."""

    def __init__(self, nodes: DataFrame, most: int, name: str):
        self.levels: list[DataFrame] = []
        self.tops = [nodes.where("n = 1").select("g", "item")]
        while most > 1:
            level = materialize(pivot(nodes.where("n > 1")), name)
            self.levels.append(level)
            nodes = level.select("g", "pos", "n", F.struct("h").alias("item"))
            self.tops.append(nodes.where("n = 1").select("g", "item"))
            most = -(-most // FANOUT)

    def roots(self) -> DataFrame:
        """g, h of each tree."""
        out = self.tops[0].select("g", "item.h")
        for top in self.tops[1:]:
            out = out.unionByName(top.select("g", "item.h"))
        return out

    def proofs(self, above: DataFrame) -> DataFrame:
        """g, item, steps, subroot for each of the lowest nodes: steps are the siblings to the left and to the right (joined),
        level by level, and then the ``above`` steps of the tree (g, above, subroot)."""
        at_top = [t.join(above, "g").select("g", F.lit(0).cast("long").alias("pos"), "item", F.col("above").alias("steps"), "subroot") for t in self.tops]
        out = at_top[-1]
        for level, top in zip(reversed(self.levels), reversed(at_top[:-1]), strict=True):
            opened = level.join(out.select("g", "pos", "steps", "subroot"), ["g", "pos"])
            slots = F.expr("array(" + ", ".join(f"struct(c{i} AS item, struct({joined(0, i)} AS l, {joined(i + 1, FANOUT)} AS r) AS step)" for i in range(FANOUT)) + ")")
            opened = opened.select("g", "pos", "steps", "subroot", F.posexplode(slots).alias("slot", "c")).where("c.item IS NOT NULL")
            steps = F.concat(F.array("c.step"), "steps")
            out = opened.select("g", (F.col("pos") * FANOUT + F.col("slot")).alias("pos"), "c.item", steps.alias("steps"), "subroot").unionByName(top)
        return out


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(steps, leaf, lambda h, s: digest(s["l"], h, s["r"]))


def siblings(steps: Column) -> Column:
    """All siblings of a proof, joined."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["l"], s["r"])), "")


def manifest(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """doc_id, source, leaf, now (the leaf of ``changed``, a text in place of the given one), steps, subroot, root.

    Null fields count as ``-``; null ids come first in a source and the null source before all others. Equal rows are leaves
    of their own side by side, of rows with one id the smaller digest first. Further columns play no part. A source of one
    leaf has it as its root; an empty table gives no rows.
    """
    given = plain(docs, *FIELDS)
    now = leaf_of(F.col("text")) if changed is None else F.coalesce(changed, leaf_of(F.col("text")))
    # the null source sorts before all others and the others by their bytes
    g = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    leaves = given.select(g.alias("g"), "doc_id", leaf_of(F.col("text")).alias("h"), now.alias("now"))
    nodes, most = placed(leaves, "g", "doc_id", "h")
    tree = Tree(nodes.select("g", "pos", "n", F.struct("h", "doc_id", "now").alias("item")), most, "merkle")
    tops, most = placed(tree.roots().select(F.lit(0).alias("all"), F.col("g").alias("source"), "h"), "all", "source")
    top = Tree(tops.select(F.col("all").alias("g"), "pos", "n", F.struct("h", "source").alias("item")), most, "merkle-top")
    root = top.roots().select("h").first()
    root = root[0] if root else None
    start = docs.sparkSession.createDataFrame([(0,)], "g int").select("g", F.array().cast("array<struct<l string, r string>>").alias("above"), F.lit(None).cast("string").alias("subroot"))
    above = materialize(top.proofs(start).select(F.col("item.source").alias("g"), F.col("steps").alias("above"), F.col("item.h").alias("subroot")), "merkle-above")
    source = F.when(F.col("g") != "", F.expr("substr(g, 2)")).alias("source")
    return tree.proofs(above).select("item.doc_id", source, F.col("item.h").alias("leaf"), "item.now", "steps", "subroot", F.lit(root).cast("string").alias("root"))


def op13_merkle(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row; see ``manifest`` for odd rows. Rows
    with a null id are never tampered with."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = manifest(docs, changed=F.when(hit, leaf_of(F.translate("text", UPPER, LOWER))))
    folded = fold(F.col("now"), F.col("steps"))
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("steps")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field_sql(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR)) || ':' || {value}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(text if n == "text" else n) for n in FIELDS) + ")"


#: CRC-32 bit by bit: each byte of the decimal id, then eight steps.
_CRC_SQL = """xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_concat([ord(c)::BIGINT], list_transform(range(8), lambda i: -1::BIGINT))))),
 lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END))"""

OP13_SQL = f"""
WITH RECURSIVE l AS (SELECT row_number() OVER () AS id, doc_id, source, {_leaf_sql("text")} AS leaf,
  CASE WHEN doc_id IS NOT NULL AND {_CRC_SQL} % 5 = 0 THEN {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {_leaf_sql("text")} END AS now FROM documents),
node AS (SELECT 0 AS lvl, source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, leaf AS h, id FROM l
  UNION ALL SELECT lvl + 1, source, pos // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(h, '' ORDER BY pos)), NULL FROM node WHERE n > 1 GROUP BY lvl, source, pos // {FANOUT}, n),
top AS (SELECT 0 AS lvl, source, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, h FROM node WHERE n = 1
  UNION ALL SELECT lvl + 1, NULL, pos // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // {FANOUT}, n),
side AS (SELECT lvl, source, pos, string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b
  FROM node WHERE n > 1 WINDOW w AS (PARTITION BY lvl, source, pos // {FANOUT} ORDER BY pos)),
top_side AS (SELECT lvl, pos, string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b
  FROM top WHERE n > 1 WINDOW w AS (PARTITION BY lvl, pos // {FANOUT} ORDER BY pos)),
climb AS (SELECT n.id, 0 AS lvl, n.source, n.pos, l.now AS h, '' AS seen FROM node n JOIN l ON l.id = n.id
  UNION ALL SELECT c.id, c.lvl + 1, c.source, c.pos // {FANOUT}, sha256(coalesce(s.a, '') || c.h || coalesce(s.b, '')), c.seen || coalesce(s.a, '') || coalesce(s.b, '')
  FROM climb c JOIN side s ON s.lvl = c.lvl AND s.source IS NOT DISTINCT FROM c.source AND s.pos = c.pos),
rise AS (SELECT c.id, 0 AS lvl, t.pos, c.h, c.seen, t.h AS subroot FROM (SELECT * FROM climb QUALIFY row_number() OVER (PARTITION BY id ORDER BY lvl DESC) = 1) c JOIN top t ON t.lvl = 0 AND t.source IS NOT DISTINCT FROM c.source
  UNION ALL SELECT o.id, o.lvl + 1, o.pos // {FANOUT}, sha256(coalesce(s.a, '') || o.h || coalesce(s.b, '')), o.seen || coalesce(s.a, '') || coalesce(s.b, ''), o.subroot
  FROM rise o JOIN top_side s ON s.lvl = o.lvl AND s.pos = o.pos),
root AS (SELECT h FROM top WHERE n = 1)
SELECT l.doc_id, l.leaf, o.subroot, r.h AS root, sha256(o.seen) AS proof_sha256, o.h AS folded_root, o.h = r.h AS verified
FROM (SELECT * FROM rise QUALIFY row_number() OVER (PARTITION BY id ORDER BY lvl DESC) = 1) o JOIN l ON l.id = o.id, root r
"""
