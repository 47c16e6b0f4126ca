from collections import Counter
import re

import pytest

from partlens.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n_words string, source string"


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    count = Counter(zip(w, w[1:], w[2:], w[3:], w[4:]))
    covered = set()
    for i in range(len(w) - 4):
        if count[tuple(w[i : i + 5])] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \n\t", "one two three four five six seven eight nine ten eleven", "a b c d e a b c d e a b c d e", "x " * 20000,
    "same line here\nother\nsame line here\n\n\n same", "été 𝒳𝒳 # * | <> %$", "a b c\x0bd", "SHOUT " * 3 + "\n" + " ".join(map(str, range(300))),
    " ".join(f"w{i % 7}" for i in range(50)), "tail head " + " ".join(f"u{i}" for i in range(100)) + " tail head u0 u1 u2",
]


def test_counts(spark):
    rows = [(i, t, "clash", "s") for i, t in enumerate(TEXTS)] + [(None, TEXTS[3], "x", None), (3, TEXTS[3], "x", None)]
    got = quality.op9_quality(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = TEXTS[3 if r.doc_id is None else r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text), text
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_cascade_keeps_what_no_rule_rejects(spark):
    good = " ".join(f"word{i}x" for i in range(40))
    rows = [(1, good, "a", "s"), (2, "short", "b", None), (3, good + " ###" * 30, None, "s"), (4, None, "d", "s"), (1, good, "a", "s")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = quality.cascade(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 1]
    assert quality.cascade(df.limit(0)).count() == 0


def test_order_is_by_rejection_per_cost():
    a, b, c = (quality.Rule(x, "true", ()) for x in "abc")
    est = [quality.RuleEstimate(a, 1.0, 0.1), quality.RuleEstimate(b, 0.1, 0.1), quality.RuleEstimate(c, 0.01, 0.0)]
    assert [r.name for r in quality.order_rules(est)] == ["b", "a", "c"]


@pytest.mark.parametrize("order", [quality.RULES, quality.RULES[::-1]])
def test_order_does_not_change_the_verdict(spark, monkeypatch, order):
    monkeypatch.setattr(quality, "order_rules", lambda _: list(order))
    rows = [(i, t, "", "s") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = {r.doc_id for r in quality.op9_quality(df).where("kept").collect()}
    assert kept == {r.doc_id for r in quality.cascade(df).collect()}


def test_later_features_are_computed_for_what_earlier_rules_leave(spark):
    """A rule that an earlier one spares its turn would fail on rows that the earlier one rejects."""
    rules = [quality.Rule("short", "n_words < 10", ("n_words",)), quality.Rule("lines", "n_lines > 0", ("n_lines",))]
    old = quality.LAZY["n_lines"]
    quality.LAZY["n_lines"] = "CASE WHEN n_words < 10 THEN raise_error('computed') ELSE 1 END"
    try:
        df = spark.createDataFrame([(1, "a b", 2), (2, "a " * 30, 30)], "doc_id long, text string, n_words long")
        got = {r.doc_id: r.v for r in df.select("doc_id", quality.lazy_verdict(rules, ("n_words",)).alias("v")).collect()}
    finally:
        quality.LAZY["n_lines"] = old
    assert got == {1: "short", 2: "lines"}


def test_lazy_features_are_the_base_features(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    both = df.select(*[(F.expr(q) == quality.base_features(quality.text_of())[n]).alias(n) for n, q in quality.LAZY.items()])
    assert all(all(r) for r in both.collect())
