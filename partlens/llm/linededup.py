"""Line dedup on content-defined chunks of lines.

A text is cut into chunks of consecutive lines. A chunk ends where a rolling digest over the digests of
the last two lines falls into a fixed share of its range, so an insertion moves only the boundaries
next to it; long lines are chunks of their own. Chunks that occur before, in the order of
(doc_id, content digest, position), in any document or in the same one are removed, after their bytes
have been compared with those of the first occurrence. A chunk too short to count alone is compared
together with the chunk before it or after it, so short chunks inside a longer repeated passage go too.

These rules are those of ``OP1_SQL``, and ``op1_line_dedup`` keeps to them: a repeated line stays where it shares its
chunk with lines that do not repeat. ``dedup_lines``, the stage of the pipeline, takes the repeated chunks in the same way and
then checks what they leave by all shortest runs of lines with enough words (``remove_passages``), so repeated passages go
up to their edges.

Only digests and positions are shuffled to find repeats (with map-side minima, so a chunk that stands
in a third of the documents is no hot key); texts move twice, by document: to compare, and to rewrite.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize, plain, row_key, small_batches, text_of
from .spans import let

LONG_WORDS = 30
MIN_WORDS = 20
#: A chunk ends where the rolling hash of the last two lines, modulo 16, is below this: every third line.
BOUNDARY = 5


def chunks(text: Column, long_words: int = LONG_WORDS) -> Column:
    """array<struct<pos:int, text:string, blanks:int, first:int, last:int>>: the chunks of a text, from line first to
    last; joined by newlines they give it back. ``blanks`` counts blanks and newlines: one less than the words, in plain text."""

    def describe(x: Column) -> Column:
        digest = F.md5(x.cast("binary"))
        value = F.ascii(F.substring(digest, 1, 1)) * 31 + F.ascii(F.substring(digest, 2, 1))
        blanks = F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
        return F.struct(x.alias("x"), value.alias("h"), blanks.alias("blanks"))

    def ends(a: Column) -> Column:
        last = F.size(a) - 1

        def is_end(now: Column, i: Column) -> Column:
            before, after = F.get(a, i - 1), F.get(a, i + 1)
            rolling = (F.coalesce(before["h"], F.lit(0)) * 7 + now["h"]) % 16
            split = (now["blanks"] >= long_words - 1) | F.coalesce(after["blanks"] >= long_words - 1, F.lit(False))
            return F.when((i == last) | split | (rolling < BOUNDARY), i)

        return F.filter(F.transform(a, is_end), lambda i: i.isNotNull())

    def cut(a: Column) -> Column:
        return let(ends(a), lambda e: F.transform(e, lambda end, k: _chunk(a, end, F.coalesce(F.get(e, k - 1), F.lit(-1)) + 1, k)))

    return let(F.transform(F.split(text, "\n"), describe), cut)


def _chunk(a: Column, end: Column, start: Column, k: Column) -> Column:
    def of(part: Column) -> Column:
        blanks = F.aggregate(part, F.size(part) - 1, lambda s, x: s + x["blanks"])
        text = F.array_join(F.transform(part, lambda x: x["x"]), "\n")
        return F.struct(k.alias("pos"), text.alias("text"), blanks.alias("blanks"), start.alias("first"), end.alias("last"))

    return let(F.slice(a, start + 1, end - start + 1), of)


def units(cut: Column, min_words: int = MIN_WORDS) -> Column:
    """array<struct<pos, side, text, first, last>>: what is compared to decide on the chunk at pos. A chunk of
    ``min_words`` words or more stands alone (side 0); a shorter one stands with the chunk before it (1) and with
    the one after it (2), if they have so many words together."""

    def of(c: Column, i: Column) -> Column:
        before, after = F.get(cut, i - 1), F.get(cut, i + 1)

        def unit(side: int, text: Column) -> Column:
            return F.struct(c["pos"].alias("pos"), F.lit(side).alias("side"), text.alias("text"), c["first"].alias("first"), c["last"].alias("last"))

        def paired(side: int, other: Column, text: Column) -> Column:
            return F.when(c["blanks"] + other["blanks"] + 1 >= min_words - 1, unit(side, text))

        pairs = F.array(
            paired(1, before, F.concat(before["text"], F.lit("\n"), c["text"])),
            paired(2, after, F.concat(c["text"], F.lit("\n"), after["text"])),
        )
        return F.when(c["blanks"] >= min_words - 1, F.array(unit(0, c["text"]))).otherwise(F.array_compact(pairs))

    return F.flatten(F.transform(cut, of))


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """doc_id, content, n_chunks, removed (positions, ascending) and the remaining text of each row.

    Null texts count as empty and come out empty. Lines that only repeat as part of different chunks stay,
    as do chunks that have fewer than ``min_words`` words together with a neighbour. Rows equal in doc_id and text are one document
    and share their fate; rows that share only the id are told apart. A text of nothing but repeats
    becomes empty; no row is dropped, and an empty table stays empty.
    """
    base = _texts(docs)
    later = _later_chunks(base, min_words, long_words)
    removed = later.groupBy("f.doc_id", "f.content").agg(F.sort_array(F.collect_set("f.pos")).alias("removed"))
    out = base.alias("b").join(removed.alias("r"), _same("b", "r"), "left")
    out = out.select("b.doc_id", "b.content", F.col("b.text").alias("before"), "r.removed")
    return out.withColumn("text", F.when(F.col("removed").isNull(), F.col("before")).otherwise(without(F.col("before"), F.col("removed"), long_words)))


def _later_chunks(base: DataFrame, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """The units of chunks, as ``f``, that occurred before."""

    def compared(df: DataFrame, *more: str) -> DataFrame:
        """One row a unit, with its text as ``chunk``."""
        cut = df.withColumn("cut", chunks(F.col("text"), long_words))
        cut = cut.select("doc_id", "content", *more, F.explode(units(F.col("cut"), min_words)).alias("u"))
        return cut.select("doc_id", "content", *more, "u.pos", "u.side", "u.first", "u.last", F.col("u.text").alias("chunk")).withColumn("h", F.xxhash64("side", "chunk"))

    return _later(base, compared, ["pos", "side"], ["side", "h", "chunk"])


def _texts(docs: DataFrame) -> DataFrame:
    return plain(docs, "doc_id", "text").select(*row_key(F.col("doc_id"), text_of()), text_of().alias("text"))


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.content") == F.col(f"{b}.content"))


def _later(base: DataFrame, compared: Callable[..., DataFrame], place: list[str], equal: list[str], light: DataFrame | None = None) -> DataFrame:
    """The occurrences, as ``f``, of what ``compared`` makes of the texts that are not the first of their text.

    ``place`` names a unit in its document, its position first; units are the same if ``equal`` columns are. ``light``:
    all units with a hash and a length instead of their text, if there is a shorter way to them.
    """
    key = F.struct("doc_id", "content", place[0])
    if light is None:
        light = compared(base).select("doc_id", "content", *place, "h", F.length("chunk").alias("len"))
    light = materialize(light, "line-chunks")
    repeated = light.groupBy("h", "len").agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"))
    # tables of their own on one side of each join: adaptive execution may then split a common chunk's occurrences
    repeated = materialize(repeated.where(F.col("first_key") != F.col("last_key")).select("h", "len"), "line-repeated")

    # every occurrence of a repeated chunk, with its text
    places = light.join(repeated, ["h", "len"], "left_semi")
    wanted = places.groupBy("doc_id", "content").agg(F.collect_set(F.struct(*place)).alias("wanted"))
    found = base.alias("b").join(wanted.alias("w"), _same("b", "w")).select("b.doc_id", "b.content", "b.text", "w.wanted")
    found = compared(found, "wanted").where(F.array_contains("wanted", F.struct(*place))).drop("wanted")
    found = materialize(found, "line-repeats")

    # byte comparison: groups are of equal text, not of equal hash
    firsts = materialize(found.groupBy(*equal).agg(F.min(key).alias("first_key")), "line-firsts")
    on = F.lit(True)
    for c in equal:
        on = on & (F.col(f"f.{c}") == F.col(f"g.{c}"))
    later = found.alias("f").join(firsts.alias("g"), on)
    return later.where(F.struct("f.doc_id", "f.content", f"f.{place[0]}") != F.col("g.first_key"))


def _runs(text: pa.Array, min_words: int) -> pa.Array:
    """For each text the shortest runs of lines with ``min_words`` words: one from each line onwards and one up to
    each line, so that every longer run is made of them. Lines without words neither begin nor end a run."""
    firsts, lasts, offsets = [], [], [0]
    for t in text.cast(pa.large_binary()):
        words = [(i, len(line.split(None, min_words))) for i, line in enumerate(t.as_py().split(b"\n"))]
        words = [(i, n) for i, n in words if n]
        found = set()
        total, lo = 0, 0
        for i, n in words:
            total += n
            while total >= min_words:
                found.add((words[lo][0], i))
                total -= words[lo][1]
                lo += 1
        total, hi = 0, len(words) - 1
        for i, n in reversed(words):
            total += n
            while total >= min_words:
                found.add((i, words[hi][0]))
                total -= words[hi][1]
                hi -= 1
        for first, last in sorted(found):
            firsts.append(first)
            lasts.append(last)
        offsets.append(len(firsts))
    runs = pa.StructArray.from_arrays([pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32())], ["first", "last"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs)


def _gone(later: DataFrame, min_words: int) -> DataFrame:
    """doc_id, content, first, last: the lines, from the first with a word to the last one, of chunks that occurred before
    as units of ``min_words`` words by any white space."""

    def worded(lines: Column) -> Column:
        n = F.col("f.last") - F.col("f.first") + 1
        skip = F.when(F.col("f.side") == 1, F.size(lines) - n).otherwise(0)  # the lines of the chunk before it
        return F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(lines, skip + i).rlike(WORD))

    enough = F.size(F.regexp_extract_all("f.chunk", F.lit(WORD), F.lit(0))) >= min_words
    rows = later.where(enough).select("f.doc_id", "f.content", "f.first", let(F.split("f.chunk", "\n"), worded).alias("at")).where(F.size("at") > 0)
    return rows.select("doc_id", "content", (F.col("first") + F.array_min("at")).alias("first"), (F.col("first") + F.array_max("at")).alias("last")).distinct()


def _outside(gone: pa.Array, of: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which runs do not lie in one of their text's stretches of lines that go anyway. Those are apart and in order."""
    counts = gone.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = gone.flatten()
    if not len(flat):
        return np.ones(len(of), bool)
    text = np.repeat(np.arange(len(counts)), counts)
    i = np.searchsorted((text << 32) + flat.field(0).to_numpy(), (of.astype(np.int64) << 32) + first, "right") - 1
    return ~((i >= 0) & (text[i] == of) & (last <= flat.field(1).to_numpy()[i]))


def _hashed_runs(min_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id, content, first, last, h, len of each shortest run that no chunk that goes holds: digests instead of texts
    leave Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = _runs(batch.column("text"), min_words)
            counts = runs.value_lengths().to_numpy(zero_copy_only=False)
            at = np.repeat(np.arange(len(counts)), counts)
            first, last = runs.values.field(0).to_numpy(), runs.values.field(1).to_numpy()
            left = _outside(batch.column("gone"), at, first, last)
            at, first, last = at[left], first[left], last[left]
            counts, of = np.bincount(at, minlength=len(counts)), pa.array(at)
            h, size = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
            k = 0
            for text, n in zip(batch.column("text"), counts, strict=True):
                if n:
                    data = text.as_py().encode()
                    ends = _line_ends(data)
                    for j in range(k, k + n):
                        part = data[ends[first[j]] : ends[last[j] + 1] - 1]
                        h[j], size[j] = int.from_bytes(hashlib.blake2b(part, digest_size=8).digest(), "little", signed=True), len(part)
                    k += n
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(of), batch.column("content").take(of), pa.array(first), pa.array(last), pa.array(h), pa.array(size)],
                names=["doc_id", "content", "first", "last", "h", "len"],
            )

    return run


def _line_ends(data: bytes) -> np.ndarray:
    """Where each line begins, and one past the newline that the last one lacks."""
    return np.concatenate([[0], np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1, [len(data) + 1]])


def remove_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, content and removed (line numbers from 0, ascending) of each document that repeats a passage.

    A passage is a run of whole lines of ``min_words`` words or more. A line goes if it lies in a passage that occurs
    before, in the order of (doc_id, content digest, line), in any document or in the same one; so of each line
    that goes an equal one stays. Rows equal in doc_id and text are one document, as in ``remove_repeats``.

    Repeated chunks go first, by content-defined cuts (those of ``min_words`` words by any white space). What they leave is
    checked exactly, by all shortest runs of lines: runs that lie in a chunk that goes are no first occurrences, as its first
    one comes before, so they need no comparison.
    """
    base = small_batches(_texts(docs))
    gone = materialize(_gone(_later_chunks(base, min_words), min_words), "line-gone")
    of = gone.groupBy("doc_id", "content").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("gone"))
    marked = base.alias("b").join(of.alias("g"), _same("b", "g"), "left").select("b.doc_id", "b.content", "b.text", "g.gone")

    @F.arrow_udf("array<struct<first:int,last:int>>")
    def runs(text: pa.Array) -> pa.Array:
        return _runs(text, min_words)

    def compared(df: DataFrame, *more: str) -> DataFrame:
        """One row a shortest run, with its text as ``chunk``."""

        def texts(lines: Column) -> Column:
            of = lambda r: F.array_join(F.slice(lines, r["first"] + 1, r["last"] - r["first"] + 1), "\n")
            return F.transform("runs", lambda r: F.struct(r["first"].alias("first"), r["last"].alias("last"), of(r).alias("text")))

        cut = df.withColumn("runs", runs("text"))
        cut = cut.select("doc_id", "content", *more, F.explode(let(F.split("text", "\n"), texts)).alias("u"))
        return cut.select("doc_id", "content", *more, "u.first", "u.last", F.col("u.text").alias("chunk")).withColumn("h", F.xxhash64("chunk"))

    id_type = docs.schema["doc_id"].dataType.simpleString()
    light = marked.mapInArrow(_hashed_runs(min_words), f"doc_id {id_type}, content string, first int, last int, h long, len long")
    later = _later(base, compared, ["first", "last"], ["h", "chunk"], light)
    both = later.select("f.doc_id", "f.content", "f.first", "f.last").unionByName(gone)
    lines = F.flatten(F.transform(F.collect_set(F.struct("first", "last")), lambda r: F.sequence(r["first"], r["last"])))
    return both.groupBy("doc_id", "content").agg(F.sort_array(F.array_distinct(lines)).alias("removed"))


def without_lines(text: Column, removed: Column) -> Column:
    """The text without the lines of these numbers; empty if no word remains."""

    def rest(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    return let(let(F.split(text, "\n"), rest), lambda t: F.when(t.rlike(WORD), t).otherwise(""))


def without(text: Column, removed: Column, long_words: int = LONG_WORDS) -> Column:
    kept = F.filter(chunks(text, long_words), lambda c: ~F.array_contains(removed, c["pos"]))
    return F.array_join(F.transform(kept, lambda c: c["text"]), "\n")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the lines that ``remove_passages`` finds; all other columns as they are, but that an
    ``n_chars`` column is brought up to date."""
    names = docs.columns
    done = remove_passages(docs, min_words)
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), *row_key(F.col("doc_id"), text_of()))
    df = rows.alias("b").join(done.alias("r"), _same("b", "r"), "left").select("b.row", "r.removed")
    df = df.select("row.*", F.col("removed").alias("_removed"))
    text = F.when(F.col("_removed").isNull(), F.col("text")).otherwise(without_lines(F.col("text"), F.col("_removed")))
    df = df.withColumn("text", text)
    if "n_chars" in names:
        df = df.withColumn("n_chars", F.when(F.col("_removed").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return df.select(*[F.col(f"`{n}`") for n in names])


def op1_line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_removed chunks, removed_chars and the text that remains, for every document."""
    out = remove_repeats(docs)
    return out.select(
        "doc_id", F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"),
        (F.length("before") - F.length("text")).cast("long").alias("removed_chars"), "text",
    )


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, md5(coalesce(text, '')) AS content FROM documents),
l0 AS (SELECT r, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
l1 AS (SELECT *, length(x) - length(replace(x, ' ', '')) AS b, ascii(substr(md5(x), 1, 1)) * 31 + ascii(substr(md5(x), 2, 1)) AS h FROM l0),
l2 AS (SELECT *, b >= 29 OR coalesce(lead(b) OVER w >= 29, true) OR (coalesce(lag(h) OVER w, 0) * 7 + h) % 16 < 5 AS e FROM l1 WINDOW w AS (PARTITION BY r ORDER BY i)),
l3 AS (SELECT *, coalesce(sum(e::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM l2),
c AS (SELECT r, pos, string_agg(x, chr(10) ORDER BY i) AS chunk, sum(b) + count(*) - 1 AS b FROM l3 GROUP BY r, pos),
n AS (SELECT *, lag(chunk) OVER w AS before, lag(b) OVER w AS bb, lead(chunk) OVER w AS after, lead(b) OVER w AS ba FROM c WINDOW w AS (PARTITION BY r ORDER BY pos)),
u AS (SELECT r, pos, 0 AS side, chunk AS t FROM n WHERE b >= 19
      UNION ALL SELECT r, pos, 1, before || chr(10) || chunk FROM n WHERE b < 19 AND b + bb + 1 >= 19
      UNION ALL SELECT r, pos, 2, chunk || chr(10) || after FROM n WHERE b < 19 AND b + ba + 1 >= 19),
m AS (SELECT u.r, pos, rank() OVER (PARTITION BY side, t ORDER BY d.doc_id NULLS FIRST, d.content, pos) > 1 AS gone FROM u JOIN d USING (r)),
x AS (SELECT r, pos FROM m WHERE gone GROUP BY r, pos),
k AS (SELECT c.r, c.pos, c.chunk, x.r IS NOT NULL AS gone FROM c LEFT JOIN x ON c.r = x.r AND c.pos = x.pos),
o AS (SELECT r, count(*) FILTER (gone) AS n, coalesce(string_agg(chunk, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM k GROUP BY r)
SELECT d.doc_id, o.n::INT AS n_removed, (length(d.text) - length(o.text))::BIGINT AS removed_chars, o.text FROM o JOIN d USING (r)
"""
