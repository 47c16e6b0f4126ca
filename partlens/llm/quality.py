"""Quality rules as a short-circuit cascade.

Each rule is a predicate over a document's features that says "reject". A bounded sample is
scored with every rule to estimate its cost (seconds a document, the least of repeated timed runs of the features
it needs) and its selectivity (share rejected). Rules then run by rejection per cost, and a
document that one rule rejects is not shown to the later ones. The order changes the work and the
name of the first failed rule, never the verdict.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import SPACE, SPACE_CHARS, WORD, materialize, plain, small_batches, text_of
from .spans import let

SYMBOLS = "#*$%&|<>"
#: Timed runs of each rule over the sample.
TIMED_RUNS = 2
WINDOW = 5


def word_hashes(text: Column) -> Column:
    """One 64-bit hash for each word, in order."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def base_features(text: Column) -> dict[str, Column]:
    """Counts over a whole text that built-in functions give."""
    spaces = F.length(text) - F.length(F.translate(text, SPACE_CHARS, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE_CHARS, "") != "")
    again = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return {
        "n_words": F.regexp_count(text, F.lit(WORD)).cast("long"),
        "word_chars": (F.length(text) - spaces).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": again.cast("long"),
        "n_upper": (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long"),
        "n_digits": (F.length(text) - F.length(F.translate(text, "0123456789", ""))).cast("long"),
    }


#: Features that only rules ask for, in SQL over ``text``.
LAZY = {
    "n_lines": r"size(filter(split(coalesce(text, ''), '\n'), x -> translate(x, ' \t\n\u000b\u000c\r', '') <> ''))",
    "n_upper": "length(coalesce(text, '')) - length(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))",
    "n_digits": "length(coalesce(text, '')) - length(translate(coalesce(text, ''), '0123456789', ''))",
}


def repeat_words(hashes: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each document, the number of its words inside a window that occurs twice or more in it.

    ``hashes``: the words of all documents, one after the other; document i has
    ``hashes[starts[i]:starts[i + 1]]``.
    """
    n = len(hashes)
    lengths = np.diff(starts)
    covered = np.zeros(n + 1, np.int64)
    if n >= window:
        doc = np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)
        with np.errstate(over="ignore"):
            key = doc[: n - window + 1] * np.uint64(0x9E3779B97F4A7C15)
            for k in range(window):
                key = (key ^ hashes[k : n - window + 1 + k].view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
                key ^= key >> np.uint64(32)
        at = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
        order = at[np.argsort(key[at], kind="stable")]
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(order), bool)
        again[1:] |= same
        again[:-1] |= same
        hit = order[again]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + window, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
    return inside[starts[1:]] - inside[starts[:-1]]


def _counted(lists: pa.Array, most: int = 2_000_000) -> pa.Array:
    """Repeated words of each list of word hashes, at most ``most`` words at once (or one document)."""
    ends = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False)
    out = np.empty(len(lists), np.int64)
    i = 0
    while i < len(lists):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, "right")) - 1)
        out[i:j] = repeat_words(flat[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
        i = j
    return pa.array(out)


@F.arrow_udf(LongType())
def n_repeats(hashes: pa.Array) -> pa.Array:
    """Repeated words of a list of word hashes; nothing else of a row goes to Python."""
    return _counted(hashes)


def _replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The column of word hashes, replaced by the count of repeated words."""
    for batch in batches:
        rest = batch.drop_columns(["hashes"])
        yield pa.RecordBatch.from_arrays([*rest.columns, _counted(batch.column("hashes"))], names=[*rest.schema.names, "n_repeat_words"])


@dataclass(frozen=True)
class Rule:
    """``sql`` is true for documents to reject; ``needs`` are the features it reads."""

    name: str
    sql: str
    needs: tuple[str, ...]


RULES = (
    Rule("too_short", "n_words < 10", ("n_words",)),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words", ("n_words", "n_repeat_words")),
    Rule("symbols", "10 * n_symbols > n_words", ("n_words", "n_symbols")),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 12 * n_words", ("n_words", "word_chars")),
    Rule("duplicate_lines", "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines", ("n_lines", "n_dup_lines")),
    Rule("shouting", "2 * n_upper > word_chars", ("word_chars", "n_upper")),
    Rule("digits", "2 * n_digits > word_chars", ("word_chars", "n_digits")),
)


@dataclass(frozen=True)
class RuleEstimate:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        """Rejections a second of work."""
        return self.rejected / max(self.seconds, 1e-9)


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 500) -> list[RuleEstimate]:
    """Cost and selectivity of each rule, from a hash-chosen sample of about ``sample_rows`` rows.

    The sample is a fixed share of all partitions, so it is bounded and follows no row order. Each
    rule's features are computed over the sample by one task, and the runs are timed ``TIMED_RUNS`` times in
    turns, so that a pause of the machine does not decide.
    """
    total = docs.count()
    if not total:
        return [RuleEstimate(r, 1.0, 0.0) for r in rules]
    share = min(1.0, sample_rows / total)
    chosen = F.pmod(F.xxhash64(text_of(), F.lit("cascade")), F.lit(1_000_000)) < int(share * 1_000_000) + 1
    sample = materialize(plain(docs, "text").where(chosen).limit(2 * sample_rows), "rule-sample")
    rows = max(1, sample.count())

    def timed(rule: Rule | None) -> tuple[float, float]:
        began = time.perf_counter()
        df = _features(sample.coalesce(1), set(rule.needs)) if rule else sample.coalesce(1)
        got = df.agg(F.avg(F.expr(rule.sql if rule else "text IS NULL").cast("double"))).first()[0]
        return time.perf_counter() - began, got or 0.0

    idle, least, rejected = float("inf"), dict.fromkeys(rules, float("inf")), {}
    for _ in range(TIMED_RUNS):
        idle = min(idle, timed(None)[0])  # what any job costs
        for rule in rules:
            seconds, rejected[rule] = timed(rule)
            least[rule] = min(least[rule], seconds)
    return [RuleEstimate(r, max(least[r] - idle, 1e-4) / rows, rejected[r]) for r in rules]


def _features(df: DataFrame, names: set[str]) -> DataFrame:
    """``df`` with the named features; keeps ``text``."""
    cheap = {k: v for k, v in base_features(text_of()).items() if k in names}
    if "n_repeat_words" in names:
        cheap["n_repeat_words"] = n_repeats(word_hashes(text_of()))
    return small_batches(df.withColumns(cheap))


def order_rules(estimates: list[RuleEstimate]) -> list[Rule]:
    """By rejection per cost; rules that reject nothing of the sample go last, the cheap ones first."""
    return [e.rule for e in sorted(estimates, key=lambda e: (-e.worth, e.seconds, e.rule.name))]


def measure(docs: DataFrame, names: tuple[str, ...] | None = None, **more: Column) -> DataFrame:
    """doc_id, counts of ``base_features`` (all, or the named ones), what ``more`` makes of text and counts, and
    n_repeat_words of every document.

    Null or empty text: all counts 0. Repeated rows are measured each. An empty table gives none.
    """
    counts = {k: v for k, v in base_features(text_of()).items() if names is None or k in names}
    counts["n_words"] = F.size("hashes").cast("long")  # the words are at hand
    given = plain(docs, "doc_id", "text").withColumn("hashes", word_hashes(text_of())).withColumns(counts).withColumns(more).drop("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.drop("hashes").schema)
    return small_batches(given).mapInArrow(_replaced, f"{fields}, n_repeat_words long")


def verdict(rules: list[Rule]) -> Column:
    """Name of the first rule in this order that rejects, or null. Later rules are not evaluated."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(F.expr(rule.sql), F.lit(rule.name)).otherwise(out)
    return out


def lazy_verdict(rules: list[Rule], known: tuple[str, ...]) -> Column:
    """The same for a row with its text and the ``known`` counts: a rule's other features are computed where the
    rule's turn comes, so not for rows that an earlier rule rejects."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        test = re.sub(r"[a-z_]+", lambda m: m[0] if m[0] in known else f"({LAZY[m[0]]})" if m[0] in LAZY else m[0], rule.sql)
        out = F.when(F.expr(test), F.lit(rule.name)).otherwise(out)
    return out


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 500) -> DataFrame:
    """Documents that no rule rejects, with all their columns.

    Rules that need only built-in functions run in one pass in their estimated order, each seen only
    by rows that passed the ones before. The repeated-window rule runs on Arrow batches: what ranks
    before it is a filter below it, so its input is only the survivors.

    Null or empty text counts as no words and is rejected as too short. Ties and repeated rows are
    judged alike; extra columns pass through; an empty table stays empty.
    """
    ordered = order_rules(estimate(docs, rules, sample_rows))
    first = next((i for i, r in enumerate(ordered) if "n_repeat_words" in r.needs), len(ordered))
    names = docs.columns
    features = base_features(text_of())
    inner = F.struct(*[F.col(f"`{n}`") for n in names]).alias("row")
    df = docs.select(inner, F.col("text"))
    needed = sorted({n for r in ordered for n in r.needs if n in features})
    df = df.withColumns({n: features[n] for n in needed})
    if first:
        df = df.where(verdict(ordered[:first]).isNull())
    if first < len(ordered):
        df = small_batches(df).withColumn("n_repeat_words", n_repeats(word_hashes(text_of())))
        df = df.where(verdict(ordered[first:]).isNull())
    return df.select("row.*")


#: Counts that ``op9_quality`` reports of every document.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines")


def op9_quality(docs: DataFrame, sample_rows: int = 500) -> DataFrame:
    """Base counts of every document, whether a base rule fails, and the cascade's verdict.

    The base counts are due for every row, so rules over them cost nothing more and stand first; the others' features
    are computed in the estimated order, for the rows that the rules before them leave.
    """
    ordered = order_rules(estimate(docs, RULES, sample_rows))
    free = [r for r in ordered if set(r.needs) <= set(REPORTED)]
    costly = [r for r in ordered if r not in free and "n_repeat_words" not in r.needs]
    late = [r for r in ordered if "n_repeat_words" in r.needs]
    out = measure(docs, REPORTED, failed=lazy_verdict(free + costly, REPORTED).isNotNull())
    base = F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~F.col("failed") & verdict(late).isNull()).alias("kept"),
    )


OP9_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS g
      FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM hit, range(0, 5) AS o(k) GROUP BY r),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(w.t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
             (len(l) - coalesce(len(list_distinct(l)), 0))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             len(regexp_extract_all(w.t, '[A-Z]'))::BIGINT AS n_upper, len(regexp_extract_all(w.t, '[0-9]'))::BIGINT AS n_digits
      FROM d JOIN w USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words OR word_chars < 2 * n_words
            OR word_chars > 12 * n_words OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)
            OR 2 * n_upper > word_chars OR 2 * n_digits > word_chars) AS kept
FROM f
"""
