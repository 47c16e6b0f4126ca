"""Near-duplicate documents by weighted MinHash.

Documents are multisets of five-word shingles, weighted by term frequency times a damped inverse
document frequency. Improved consistent weighted sampling draws ``BANDS * ROWS`` samples of each; two
documents draw the same sample with probability equal to their weighted Jaccard similarity. Documents
that share the samples of a band are candidates, and candidates are verified with the exact weighted
Jaccard similarity.

Equal texts are one node. In a bucket, pairs are not enumerated: its most central node, the pivot, is
compared with the others, what is linked becomes one component, and the next round compares the most
central node outside the pivot's component with all nodes of other components, as long as rounds find
links. What is still open then is settled by differences from the pivot: whatever an open node is linked
to shares one of the rare elements by which it differs from the pivot, so only nodes that share one are
compared (``_prefixes``). Elements of whole groups of copies make no pairs, and no link between candidates
is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, plain, small_batches, text_of
from .components import components
from .quality import word_hashes

SHINGLE = 5
BANDS, ROWS = 12, 3
#: Buckets of the table of document frequencies: 2 MB on the driver, 256 KB as weights, at any input size.
DF_BITS = 18
#: Inverse document frequency moves a weight between UNIT (in all documents) and UNIT * (1 + STRENGTH) (in a share of
#: RARE or less), the same at any number of documents.
UNIT, STRENGTH, RARE = 64, 0.25, 0.001
#: Rounds that compare one node a bucket with the others go on while this share of the pairs they compare are links.
LEAST_LINKED = 0.1
#: Open nodes of a group up to which they are compared with all others in it, or pairs a node that are left to compare in a
#: group of up to COUNTED nodes; and how often groups with more are split; after that their pairs are compared as well.
FEW, COUNTED, LEVELS = 16, 4096, 12

_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _K[2]
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of documents whose word hashes stand one after the other: the document's number,
    a 48-bit id and the count of each, by document and id. A text of fewer than five words is one shingle."""
    n, lengths = len(words), np.diff(starts)
    w = words.view(np.uint64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    with np.errstate(over="ignore"):
        short = np.flatnonzero((lengths > 0) & (lengths < SHINGLE))
        tail = np.zeros(len(short), np.uint64)
        for j, i in enumerate(short):
            for x in w[starts[i] : starts[i + 1]]:
                tail[j] = _mix((tail[j : j + 1] ^ x) * _K[1])[0]
        m = max(0, n - SHINGLE + 1)
        key = np.zeros(m, np.uint64)
        for k in range(SHINGLE):
            key = _mix((key ^ w[k : k + m]) * _K[1])
    at = np.flatnonzero(doc[:m] == doc[SHINGLE - 1 :]) if m else np.zeros(0, np.int64)
    ids = np.concatenate([key[at], tail]) >> np.uint64(16)
    docs = np.concatenate([doc[at], short])
    both = np.sort((docs.astype(np.uint64) << np.uint64(48)) | ids)  # at most 65,536 documents at once
    if not len(both):
        return docs, ids, docs
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    count = np.diff(np.concatenate([first, [len(both)]]))
    both = both[first]
    return (both >> np.uint64(48)).astype(np.int64), both & np.uint64(0xFFFFFFFFFFFF), count


def _blocks(batch: pa.RecordBatch, most: int = 250_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows i:j of a batch with their word hashes, ``most`` words (or one row) at once."""
    lists = batch.column("hashes")
    ends = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False)
    i = 0
    while i < batch.num_rows:
        j = min(i + 50_000, max(i + 1, int(np.searchsorted(ends, ends[i] + most, "right")) - 1))
        yield i, j, flat[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
        i = j


def _bucket(ids: np.ndarray) -> np.ndarray:
    return (ids >> np.uint64(48 - DF_BITS)).astype(np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << DF_BITS, np.int64)
    for batch in batches:
        for _, _, words, starts in _blocks(batch):
            counts += np.bincount(_bucket(shingles(words, starts)[1]), minlength=1 << DF_BITS)
    at = np.flatnonzero(counts)
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bucket", "n"])


def shingle_weights(hashed: DataFrame, n_docs: int) -> np.ndarray:
    """Weight of one occurrence of a shingle, by bucket of its id.

    Document frequencies of all documents are counted by bucket; the mean load of a bucket is taken off,
    so that what remains is the frequency of the bucket's common shingles. Shares of documents below ``RARE`` weigh
    alike, so chance loads, which become smaller against the number of documents as it grows, do not count. Tables of
    2^18 counts meet in one table of that size, whatever the input.
    """
    rows = small_batches(hashed).select("hashes").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << DF_BITS)
    counts[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    share = np.clip((counts - counts.mean()) / max(n_docs, 1), RARE, 1)
    idf = np.log(share) / np.log(RARE)
    return np.rint(UNIT * (1 + STRENGTH * np.clip(idf, 0, 1))).astype(np.uint8)


class _Sampler:
    """Improved consistent weighted sampling. The random numbers of a shingle for sample k come from a table
    of 65,536 draws, at a place that differs from k to k."""

    def __init__(self) -> None:
        rng = np.random.default_rng(20_240_229)
        k, n = BANDS * ROWS, 1 << 16
        self.r = rng.gamma(2.0, 1.0, (k, n)).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, (k, n))).astype(np.float32)
        self.beta = rng.random((k, n), np.float32)
        self.odd = rng.integers(1, 2**63, k, np.uint64) | np.uint64(1)

    def bands(self, doc: np.ndarray, ids: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
        """One key a band for each document that has shingles; documents' shingles stand together."""
        has, first, count = np.unique(doc, return_index=True, return_counts=True)
        out = np.zeros((n_docs, BANDS), np.uint64)
        log_w = np.log(weight).astype(np.float32)
        of = np.repeat(np.arange(len(has)), count)
        at = np.empty(len(has), np.int64)
        with np.errstate(over="ignore"):
            for k in range(BANDS * ROWS):
                idx = ((ids * self.odd[k]) >> np.uint64(40)) & np.uint64(0xFFFF)
                r, beta = self.r[k][idx], self.beta[k][idx]
                t = np.floor(log_w / r + beta)
                a = self.log_c[k][idx] - r * (t - beta + 1)
                hit = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, first), count))[::-1]
                at[of[hit]] = hit
                sample = _mix(ids[at] * _K[0] + t[at].astype(np.int64).view(np.uint64))
                out[has, k // ROWS] = _mix((out[has, k // ROWS] ^ sample) * _K[1])
        return out


_sampler: list[_Sampler] = []  # a Python worker serves many tasks


def _signatures(weights: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _sampler:
            _sampler.append(_Sampler())
        for batch in batches:
            for i, j, words, starts in _blocks(batch):
                doc, ids, count = shingles(words, starts)
                n = j - i
                if not len(doc):
                    continue
                weight = count * weights[_bucket(ids)].astype(np.int64)
                total = np.bincount(doc, weight, n).astype(np.int64)
                keys = _sampler[0].bands(doc, ids, weight, n)
                has = np.flatnonzero(total)
                flat = pa.array(keys[has].view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * BANDS), flat)
                yield pa.RecordBatch.from_arrays([batch.column("content").slice(i, n).take(pa.array(has)), lists, pa.array(total[has])], names=["content", "keys", "total"])

    return run


def _elements(weights: np.ndarray) -> Callable:
    """A document as a set of longs: one for each occurrence of a shingle, its weight in the low 8 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words, starts in _blocks(batch):
                doc, ids, count = shingles(words, starts)
                nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                with np.errstate(over="ignore"):
                    x = _mix(np.repeat(ids, count) + nth.astype(np.uint64) * _K[0])
                x = (x & ~np.uint64(0xFF)) | np.repeat(weights[_bucket(ids)], count).astype(np.uint64)
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, count, j - i).astype(np.int64))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(x.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("content").slice(i, j - i), lists], names=["content", "elements"])

    return run


PREFIXES = "pivot long, content long, comp long, open int, total long, d long, lost int, element long, rest long, as_open boolean, as_any boolean"


def _prefixes(percent: int) -> Callable:
    """Of each node's difference D from its pivot, the elements of which a linked node must share one.

    With w the weight of a node, t the threshold and c = (1 - t) / (1 + t), linked nodes X and Y differ by c (wX + wY) at
    most, so their Ds share o = (dX + dY - c (wX + wY)) / 2. As dY is at least dX - c (wX + wY), that is at least
    dX - c wX (1 + 1 / t); and where Y is open, dY is above c (wY + wP), it is at least (dX + c (wP - wX)) / 2. In any
    order of elements, the first shared one has a weight of o from it on (``rest``).
    """
    t = percent / 100
    c = (1 - t) / (1 + t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, pivot = batch.column("elements"), batch.column("of_pivot")
            total, single = batch.column("total").to_numpy(), batch.column("single").to_numpy()
            found: list[tuple] = []
            for i in range(batch.num_rows):
                x, p = own[i].values.to_numpy(), pivot[i].values.to_numpy()
                shared = np.isin(x, p)
                gained = np.flatnonzero(~shared)
                lost = np.setdiff1d(p, x[shared])
                e = np.concatenate([x[gained], lost])
                w = e & 255
                d = int(w.sum())
                rest = d - np.cumsum(w) + w
                least = d - c * total[i] * (1 + 1 / t)
                as_open = rest >= least - 1e-6
                as_any = rest >= max(least, (d + c * (int((p & 255).sum()) - total[i])) / 2) - 1e-6
                keep = as_open.copy()
                keep[: int((gained < single[i]).sum())] = False  # no other node has these
                at = np.flatnonzero(keep)
                found.append((np.full(len(at), i), np.full(len(at), d), at >= len(gained), e[at], rest[at], as_open[at], as_any[at]))
            cols = [np.concatenate(x) for x in zip(*found, strict=True)]
            row = pa.array(cols[0])
            named = [batch.column(n).take(row) for n in ("pivot", "content", "comp", "open", "total")]
            arrays = [*named, pa.array(cols[1], pa.int64()), pa.array(cols[2].astype(np.int32)), *(pa.array(x) for x in cols[3:])]
            yield pa.RecordBatch.from_arrays(arrays, names=["pivot", "content", "comp", "open", "total", "d", "lost", "element", "rest", "as_open", "as_any"])

    return run


def _many_pairs(percent: int, few: int, block: int = 256) -> Callable:
    """The groups whose nodes make more than ``few`` pairs a node in ``_by_difference``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("nodes")
            ends = lists.offsets.to_numpy()
            flat = {f.name: lists.values.field(f.name).to_numpy(zero_copy_only=False) for f in lists.type.value_type}
            many = np.zeros(batch.num_rows, bool)
            for g in range(batch.num_rows):
                x = {n: v[ends[g] : ends[g + 1]] for n, v in flat.items()}
                x["excess"] = x["d"] * (100 + percent) - x["total"] * (100 - percent)
                x["has"] = x["rest"] * 2 * (100 + percent) - x["excess"]
                b = {n: v[x["as_any"]] for n, v in x.items()}
                at, pairs = np.flatnonzero((x["open"] == 1) & x["as_open"]), 0
                for i in range(0, len(at), block):
                    a = {n: v[at[i : i + block], None] for n, v in x.items()}
                    meet = (a["has"] >= b["excess"]) & (b["has"] >= a["excess"]) & (a["comp"] != b["comp"]) & ((b["open"] == 0) | (a["content"] < b["content"]))
                    meet &= np.minimum(a["total"], b["total"]) * 100 >= np.maximum(a["total"], b["total"]) * percent
                    pairs += int(meet.sum())
                many[g] = pairs > few * (ends[g + 1] - ends[g])
            yield pa.RecordBatch.from_arrays([batch.column(n).filter(pa.array(many)) for n in ("pivot", "lost", "element")], names=["pivot", "lost", "element"])

    return run


def _weight(elements: Column) -> Column:
    return F.aggregate(elements, F.lit(0).cast("long"), lambda s, x: s + x.bitwiseAND(F.lit(255).cast("long")))


def similar(a: str, b: str, threshold_percent: int = 80) -> Column:
    """Whether the weighted Jaccard similarity of two sets of elements reaches the threshold; in whole numbers."""
    common = _weight(F.array_intersect(F.col(f"{a}.elements"), F.col(f"{b}.elements")))
    return common * (100 + threshold_percent) >= (F.col(f"{a}.total") + F.col(f"{b}.total")) * threshold_percent


class NearDuplicates:
    """Finds classes of near-duplicate documents.

    ``nodes``: content (digest of a text), first (its smallest doc_id); ``classes``: content, comp for
    texts that are linked to others. Null and empty texts are equal to each other; texts without words
    have no shingles and are linked to equal texts only. Repeated rows, ties and extra columns change
    nothing: a node is a text. An empty table gives no nodes.
    """

    def __init__(self, docs: DataFrame, threshold_percent: int = 80):
        base = plain(docs, "doc_id", "text").select("doc_id", text_of().alias("text"))
        base = base.withColumn("content", F.md5(F.col("text").cast("binary")))
        self.docs = base
        self.percent = threshold_percent
        light = materialize(base.select("doc_id", "content"), "near-ids")
        self.light = light
        self.nodes = light.groupBy("content").agg(F.min("doc_id").alias("first"))
        hashed = base.select("content", word_hashes(F.lower("text")).alias("hashes"))
        self.weights = shingle_weights(hashed, light.count())
        signed = hashed.mapInArrow(_signatures(self.weights), "content string, keys array<long>, total long")
        signed = signed.groupBy("content").agg(F.first("keys").alias("keys"), F.first("total").alias("total"))
        # from here on a node is a number, fixed by the table that holds it: rows are half as long, and its least and
        # largest need no sort
        signed = materialize(signed.withColumn("node", F.monotonically_increasing_id()), "near-signatures")
        self.numbers = signed.select("content", "node")
        comps = self._link(signed.select(F.col("node").alias("content"), "keys", "total"))
        self.classes = comps.withColumnRenamed("content", "node").join(self.numbers, "node").select("content", "comp")

    def _members(self, signed: DataFrame) -> DataFrame:
        """content, total, band, key of all nodes in buckets of two or more, with the node's centrality: the
        number of nodes it meets over its bands."""
        each = signed.select("content", "total", F.posexplode("keys").alias("band", "key"))
        # what a bucket's rows are joined with is a table of its own, so that adaptive execution may split a hot bucket
        sizes = materialize(each.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"), "near-sizes")
        shared = materialize(each.join(sizes, ["band", "key"]), "near-shared")
        central = shared.groupBy("content").agg(F.sum("n").alias("central"))
        return materialize(shared.drop("n").join(central, "content"), "near-members")

    def _link(self, signed: DataFrame) -> DataFrame:
        members = self._members(signed)
        elements = self._elements_of(members.select("content").distinct())
        comps = elements.select("content", F.col("content").alias("comp"))
        rank = F.struct("central", "content")
        first = members.groupBy("band", "key").agg(F.max_by(F.struct("content", "total"), rank).alias("f"))
        pivots = materialize(first.select("band", "key", F.col("f.content").alias("pivot"), F.col("f.total").alias("tb")), "near-pivots")
        # the first round: every node is a component of its own, all buckets are open and led by their pivots
        pairs = members.join(pivots, ["band", "key"]).where("content <> pivot")
        pairs = pairs.select(F.col("content").alias("a"), F.col("total").alias("ta"), F.col("pivot").alias("b"), "tb")
        served = pivots.select("band", "key", F.col("pivot").alias("content"), F.lit(True).alias("served"))  # nodes that were compared with all others of a bucket
        pivots, now = pivots.drop("tb"), members
        compared, linked, comps = self._join(pairs, elements, comps)
        while compared and linked >= LEAST_LINKED * compared:
            now = members.join(comps, "content").join(served, ["band", "key", "content"], "left").withColumn("served", F.coalesce("served", F.lit(False)))
            now = materialize(now, "near-now")
            left = now.where("NOT served").groupBy("band", "key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
            # a bucket is open while two nodes that were not served are in different components
            left = left.where("low <> high").select("band", "key")
            heads = pivots.join(comps, F.col("pivot") == F.col("content")).select("band", "key", F.col("comp").alias("main"))
            now = materialize(now.join(materialize(heads.join(left, ["band", "key"]), "near-heads"), ["band", "key"]), "near-open")
            lead = now.where("NOT served AND comp <> main").groupBy("band", "key").agg(F.max_by(F.struct("content", "comp", "total"), rank).alias("lead"))
            lead = materialize(lead, "near-lead")
            pairs = now.join(lead, ["band", "key"]).where("comp <> lead.comp")
            pairs = pairs.select(F.col("content").alias("a"), F.col("total").alias("ta"), F.col("lead.content").alias("b"), F.col("lead.total").alias("tb"))
            served = served.unionByName(lead.select("band", "key", F.col("lead.content").alias("content"), F.lit(True).alias("served")))
            now = now.drop("comp", "served", "main")
            compared, linked, comps = self._join(pairs, elements, comps)
        now = now.join(comps, "content").join(served, ["band", "key", "content"], "left_anti").join(pivots, ["band", "key"])
        now = materialize(now.join(materialize(self._main_of(pivots, comps), "near-main"), "pivot"), "near-last")
        rows, ranked = self._differences(now, elements)
        return self._settle(rows, ranked, elements, comps)

    @staticmethod
    def _main_of(pivots: DataFrame, comps: DataFrame) -> DataFrame:
        return pivots.select("pivot").distinct().join(comps, F.col("pivot") == F.col("content")).select("pivot", F.col("comp").alias("of_pivot"))

    def _join(self, pairs: DataFrame, elements: DataFrame, comps: DataFrame) -> tuple[int, int, DataFrame]:
        """How many pairs were compared, how many are links, and the components after these links."""
        pairs = materialize(pairs.where(self._sizes("ta", "tb")).select("a", "b").distinct(), "near-pairs")
        compared = pairs.count()
        if not compared:
            return 0, 0, comps
        links = materialize(self._verified(pairs, elements), "near-links")
        linked = links.count()
        if not linked:
            return compared, 0, comps
        # links between components join them
        ends = links.join(comps.select(F.col("content").alias("a"), F.col("comp").alias("ca")), "a").join(comps.select(F.col("content").alias("b"), F.col("comp").alias("cb")), "b")
        joined = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        comps = comps.join(joined.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left")
        return compared, linked, materialize(comps.select("content", F.coalesce("to", "comp").alias("comp")), "near-comps")

    def _differences(self, now: DataFrame, elements: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What is left to compare: nodes of a bucket that were not served, in different components, with the rare
        differences by which every link of one that is outside the pivot's component would show; and elements in order.

        ``D`` of a node is its difference from the pivot: elements it has beyond it and elements of the pivot it lacks.
        Two nodes differ by the elements that one D alone holds. A node outside the pivot's component differs from the
        pivot by more than a link allows, so whatever it is linked to shares part of its D; of D's elements, rare ones
        first, a prefix must then hold a shared one (``_prefixes``). Elements that all copies have, or that all but
        the pivot have, come last and make no pairs.
        """
        buckets = now.groupBy("band", "key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("band", "key")
        now = now.join(materialize(buckets, "near-left"), ["band", "key"])
        nodes = now.groupBy("pivot", "content", "total", "comp").agg(F.max((F.col("comp") != F.col("of_pivot")).cast("int")).alias("open"))
        some = materialize(nodes.where("open = 1").select("pivot").distinct(), "near-some")
        nodes = materialize(nodes.join(some, "pivot"), "near-rest")

        # elements in the order of their number of nodes, and how many of them no other node has
        wanted = nodes.select(F.explode(F.array("content", "pivot")).alias("content")).distinct()
        each = elements.drop("total").join(wanted, "content").select("content", F.explode("elements").alias("e"))
        each = materialize(each, "near-each")
        often = materialize(each.groupBy("e").agg(F.count("*").alias("n")).where("n > 1"), "near-often")
        ranked = each.join(often, "e", "left").groupBy("content").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "e"))).alias("ranked"))
        ranked = materialize(ranked.select("content", F.col("ranked.e").alias("elements"), F.size(F.filter("ranked", lambda x: x["n"] == 1)).alias("single")), "near-ranked")

        x, y = ranked, ranked.select(F.col("content").alias("p"), F.col("elements").alias("of_pivot"))
        # pivots first: rows of a large bucket are short there, and long ones are dealt by their own node
        rows = nodes.join(y, F.col("pivot") == F.col("p")).join(x, "content")
        rows = small_batches(rows.select("pivot", "content", "comp", "open", "total", "single", "elements", "of_pivot"))
        return materialize(rows.mapInArrow(_prefixes(self.percent), PREFIXES), "near-prefixes"), ranked

    def _settle(self, rows: DataFrame, ranked: DataFrame, elements: DataFrame, comps: DataFrame) -> DataFrame:
        """Components after all links among nodes that share a difference from their pivot early enough."""
        key = ["pivot", "lost", "element"]
        for level in range(LEVELS + 1):
            rows = self._early_enough(rows)
            groups = materialize(self._groups(rows), "near-groups")
            if groups.isEmpty():
                return comps
            rows = materialize(rows.join(groups.select(*key, "opens", "b"), key), "near-grouped")
            # most nodes that are linked at all are linked to the nearest one: one link is enough to join two components, so
            # these pairs, one a row at most, come before all others; in a group that may be split all nodes meet the next pivot
            near = rows.where(F.expr(f"(open = 1 AND as_open OR opens > {FEW}) AND comp <> b.comp"))
            comps = self._join(near.select(F.col("content").alias("a"), F.col("total").alias("ta"), F.col("b.content").alias("b"), F.col("b.total").alias("tb")), elements, comps)[2]
            rows = rows.drop("comp").join(comps, "content")
            left = rows.groupBy(*key).agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n"), F.count_if((F.col("open") == 1) & F.col("as_open")).alias("still")).where("low <> high AND still > 0")
            rows = materialize(rows.join(materialize(left.select(*key, "n", "still"), "near-left"), key), "near-remaining")
            large = rows.where((F.least("opens", "still") > FEW) & F.lit(level < LEVELS))
            large = materialize(self._crowded(large), "near-crowded")
            comps = self._join(self._by_difference(rows.join(large, key, "left_anti")), elements, comps)[2]
            rows = rows.drop("n").join(large, key)
            if rows.isEmpty():
                return comps
            rows = self._split(rows.drop("comp").join(comps, "content"), ranked, elements, comps)
        return comps

    def _early_enough(self, rows: DataFrame, passes: int = 2) -> DataFrame:
        """Rows that some node of their group may be linked to: what a node has from the difference on must make up for what is
        too much in its own differences and in those of its partner with the least too much. A partner of one that is open
        is any that is early enough for an open one, and the reverse: of a pair, one may be early enough as an open node
        only. A second pass goes by the nodes that the first one leaves."""
        key = ["pivot", "lost", "element"]
        rows = rows.withColumn("excess", F.col("d") * (100 + self.percent) - F.col("total") * (100 - self.percent)).withColumn("as_open", (F.col("open") == 1) & F.col("as_open"))
        for _ in range(passes):
            ends = rows.groupBy(*key).agg(F.count("*").alias("m"), F.min(F.when(F.col("as_any"), F.col("excess"))).alias("any"), F.min(F.when(F.col("as_open"), F.col("excess"))).alias("opened"))
            ends = ends.where("m > 1 AND any IS NOT NULL AND opened IS NOT NULL").drop("m")
            has = F.col("rest") * 2 * (100 + self.percent) - F.col("excess")
            rows = rows.join(materialize(ends, "near-ends"), key).withColumns({"as_open": F.col("as_open") & (has >= F.col("any")), "as_any": F.col("as_any") & (has >= F.col("opened"))})
            rows = materialize(rows.where("as_open OR as_any").drop("any", "opened"), "near-early")
        return rows.drop("excess")

    def _groups(self, rows: DataFrame) -> DataFrame:
        """pivot, lost, element, opens (open nodes) and b, the nearest node, of groups of nodes that share a difference and hold a pair that may
        be a link. Of differences that the same nodes share, the first in order stands for all."""
        each = rows.groupBy("pivot", "lost", "element").agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64("content")).alias("h"), F.bit_xor(F.xxhash64("content", F.lit(1))).alias("g"), F.sum("rest").alias("rest"),
            F.min("comp").alias("low"), F.max("comp").alias("high"), F.count_if((F.col("open") == 1) & F.col("as_open")).alias("opens"), F.count_if("as_any").alias("others"), F.min_by(F.struct("content", "comp", "total"), F.struct("d", "content")).alias("b"),
        )
        each = each.where("low <> high AND opens > 0 AND others > 0")
        # along the order of differences what a node has from one on grows less
        first = each.groupBy("pivot", "n", "h", "g").agg(F.max_by(F.struct("lost", "element", "opens", "b"), F.struct("rest", "lost", "element")).alias("f"))
        return first.select("pivot", "f.lost", "f.element", "f.opens", "f.b")

    def _crowded(self, rows: DataFrame) -> DataFrame:
        """pivot, lost, element of groups to split: those that have more than FEW pairs a node left to compare, or more nodes than
        are counted. A split makes a row of each element by which a node differs from each of its groups' nearest nodes, so
        it costs more than all pairs where groups overlap and most pairs are ruled out by their differences."""
        key = ["pivot", "lost", "element"]
        nodes = F.collect_list(F.struct("content", "comp", "open", "total", "d", "rest", "as_open", "as_any")).alias("nodes")
        counted = small_batches(rows.where(f"n <= {COUNTED}").groupBy(*key).agg(nodes))
        counted = counted.mapInArrow(_many_pairs(self.percent, FEW), rows.select(*key).schema)
        return counted.unionByName(rows.where(f"n > {COUNTED}").select(*key).distinct())

    def _split(self, rows: DataFrame, ranked: DataFrame, elements: DataFrame, comps: DataFrame) -> DataFrame:
        """Rows as those of ``_differences``, of groups as buckets of their own: each node's differences from its group's
        nearest node, those of the fewest nodes first. Groups with one nearest node are one bucket, as their differences from
        it are the same, however many groups a node is in. Elements that no other node has come before all others and make
        no rows; their weight is enough."""
        nodes = rows.where("as_any OR open = 1 AND as_open").select(F.col("b.content").alias("pivot"), F.col("b.content").alias("head"), "content", "total", "comp").distinct()
        nodes = nodes.join(comps.select(F.col("content").alias("head"), F.col("comp").alias("of_pivot")), "head").where("content <> head")
        nodes = nodes.withColumn("open", (F.col("comp") != F.col("of_pivot")).cast("int"))
        some = materialize(nodes.where("open = 1").select("pivot").distinct(), "near-some")
        alone = F.slice("elements", F.lit(1), F.col("single"))
        common = F.slice("elements", F.col("single") + 1, F.greatest(F.size("elements") - F.col("single"), F.lit(0)))
        x = ranked.select("content", _weight(alone).alias("alone"), F.col("elements").alias("all_x"), common.alias("x"))
        y = elements.select(F.col("content").alias("head"), F.col("elements").alias("y"), F.col("total").alias("of_head"))
        nodes = nodes.join(some, "pivot").join(y, "head").join(x, "content")
        # a lambda of two parameters would get the place as the second one
        marked = lambda lost, found: F.transform(found, lambda e: F.struct(F.lit(lost).alias("lost"), e.alias("element")))
        differ = F.concat(marked(0, F.array_except("x", "y")), marked(1, F.array_except("y", "all_x")))
        each = nodes.select("pivot", "content", "comp", "open", "total", "alone", "of_head", F.explode(differ).alias("e")).select("pivot", "content", "comp", "open", "total", "alone", "of_head", "e.lost", "e.element")
        each = materialize(each, "near-each")
        often = materialize(each.groupBy("pivot", "lost", "element").agg(F.count("*").alias("often")), "near-often")
        w = Window.partitionBy("pivot", "content")
        weight = F.col("element").bitwiseAND(F.lit(255).cast("long"))
        each = each.join(often, ["pivot", "lost", "element"]).withColumn("d", F.col("alone") + F.sum(weight).over(w))
        upto = F.sum(weight).over(w.orderBy("often", "lost", "element").rowsBetween(Window.unboundedPreceding, 0))
        each = each.withColumn("rest", F.col("d") - F.col("alone") - upto + weight)
        t = self.percent / 100
        c = (1 - t) / (1 + t)
        least = F.col("d") - F.col("total") * (c * (1 + 1 / t))
        each = each.withColumn("as_open", F.col("rest") >= least - 1e-6).withColumn("as_any", F.col("rest") >= F.greatest(least, (F.col("d") + (F.col("of_head") - F.col("total")) * c) / 2) - 1e-6)
        return materialize(each.where("often > 1 AND (as_open OR as_any)").select("pivot", "content", "comp", "open", "total", "d", "lost", "element", "rest", "as_open", "as_any"), "near-prefixes")

    def _by_difference(self, rows: DataFrame) -> DataFrame:
        """Pairs in different components, one of them open, that share a difference early enough in both orders."""
        a, b = rows.where("open = 1 AND as_open").alias("a"), rows.where("as_any").alias("b")
        on = (F.col("a.pivot") == F.col("b.pivot")) & (F.col("a.lost") == F.col("b.lost")) & (F.col("a.element") == F.col("b.element"))
        on = on & (F.col("a.comp") != F.col("b.comp")) & self._sizes("a.total", "b.total") & ((F.col("b.open") == 0) | (F.col("a.content") < F.col("b.content")))
        # what both have from here on must make up for what is too much in their differences
        least = (F.col("a.d") + F.col("b.d")) * (100 + self.percent) - (F.col("a.total") + F.col("b.total")) * (100 - self.percent)
        on = on & (F.least("a.rest", "b.rest") * 2 * (100 + self.percent) >= least)
        return a.join(b, on).select(F.col("a.content").alias("a"), F.col("a.total").alias("ta"), F.col("b.content").alias("b"), F.col("b.total").alias("tb"))

    def _sizes(self, a: str, b: str) -> Column:
        return F.least(a, b) * 100 >= F.greatest(a, b) * self.percent

    def _elements_of(self, wanted: DataFrame) -> DataFrame:
        """Elements of the wanted nodes, read from one row of each."""
        one = self.numbers.join(wanted.withColumnRenamed("content", "node"), "node").join(self.nodes, "content").select(F.col("content").alias("c"), F.col("first").alias("f"), "node")
        rows = self.docs.join(one, (F.col("content") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("f")))
        hashed = rows.select(F.col("node").alias("content"), word_hashes(F.lower("text")).alias("hashes"))
        out = hashed.mapInArrow(_elements(self.weights), "content long, elements array<long>")
        return materialize(out.withColumn("total", _weight(F.col("elements"))).dropDuplicates(["content"]), "near-elements")

    def _verified(self, pairs: DataFrame, elements: DataFrame) -> DataFrame:
        x, y = elements.alias("x"), elements.alias("y")
        # many pairs have one b: they are joined with it while they are short
        got = pairs.join(y, F.col("b") == F.col("y.content")).join(x, F.col("a") == F.col("x.content"))
        return got.where(similar("x", "y", self.percent)).select("a", "b")

    def assigned(self) -> DataFrame:
        """doc_id, content, class_id (smallest doc_id of the class), one row a document row."""
        # the lowest of a class by map-side minima and one row a class: no task holds a class
        of = self.classes.join(self.nodes, "content").groupBy("comp").agg(F.min("first").alias("class_id"), F.min(F.struct(F.col("first").isNull(), "first", "content"))["content"].alias("keeper"))
        of = self.classes.join(of, "comp").select("content", "class_id", "keeper")
        nodes = self.nodes.join(of, "content", "left")
        nodes = nodes.withColumn("class_id", F.coalesce("class_id", "first")).withColumn("keeper", F.coalesce("keeper", "content"))
        return self.light.join(nodes.select("content", "first", "class_id", (F.col("keeper") == F.col("content")).alias("keeper")), "content").select(
            "doc_id", "content", "class_id", (F.col("keeper") & F.col("doc_id").eqNullSafe(F.col("first"))).alias("kept"),
        )


def drop_near_duplicates(docs: DataFrame, threshold_percent: int = 80) -> DataFrame:
    """One document of each class: the one with the smallest doc_id (of repeated rows, one row)."""
    names = docs.columns
    kept = NearDuplicates(docs, threshold_percent).assigned().where("kept").select(F.col("doc_id").alias("_doc"), F.col("content").alias("_content")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), "doc_id", F.md5(text_of().cast("binary")).alias("content"))
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("content") == F.col("_content")), "left_semi")
    return rows.dropDuplicates(["doc_id", "content"]).select("row.*")


def op4_near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, kept of every document."""
    return NearDuplicates(docs).assigned().select("doc_id", "class_id", "kept")
