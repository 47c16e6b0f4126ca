"""Secrets by patterns and a battery of randomness tests.

Besides the base patterns, every token is a candidate that is long, or of 12 characters or more with letters and
digits, or a chain of hexadecimal pairs. Its encoding is inferred from its characters, without separators where
the rest is of a smaller alphabet; against that alphabet it is tested for uniformity (chi-squared), for runs of character classes and for
serial correlation; separators do not count as a change of class. Each test gives a p-value of "ordinary text": how likely an ordinary token of that
length looks as random. Fisher's method joins the three, and the Benjamini-Hochberg step over the
candidates of all documents controls false discoveries; p-values are weighted by the bits that a token of
its length and alphabet carries, so long tokens need less and short ones more.

Everything is built-in functions. The driver gets one number, the threshold, from a histogram of fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, plain, text_of
from .spans import digest, let, listed, matches

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
TOKEN = (
    r"(?<![A-Za-z0-9+/_=:-])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){7,}+(?![A-Za-z0-9:])"  # pairs, as fingerprints are written
    r"|(?<![A-Za-z0-9+/_=-])(?:(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{12,}+|[A-Za-z0-9+/_-]{20,}+)={0,2}"
)
SEPARATORS = "-:_="

#: In ordinary text, the sum of squared letter shares (English letters have 0.066), and the share of places
#: where the class of character changes.
TEXT_REPEAT = 0.066
TEXT_CHANGES = 0.10
#: Serial z-values of ordinary tokens spread so many times as wide as those of random ones.
TEXT_SPREAD = 3.0
FALSE_SHARE = 0.001
#: No test alone says more than this against an ordinary token, so names in mixed case need a second one.
LEAST_P = 1e-5
BINS, PER_UNIT = 4000, 20


def normal_cdf(x: Column) -> Column:
    """The normal distribution, within 0.0002 (Page's logistic form)."""
    x = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), x))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(x * 1.5976 + x * x * x * 0.070565992)))


def alphabet(token: Column) -> Column:
    """Number of characters of the inferred encoding."""
    return (
        F.when(token.rlike("^[0-9]+$"), 10.0).when(token.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), 16.0).when(token.rlike("^(?:[a-z]+|[A-Z]+)$"), 26.0)
        .when(token.rlike("^[A-Z2-7]+$"), 32.0).when(token.rlike("^(?:[a-z0-9]+|[A-Z0-9]+)$"), 36.0).otherwise(64.0)
    )


def bare(token: Column) -> Column:
    """What is tested: the token without separators, if what is left is digits, hexadecimal, of one case or base 32;
    else without padding (``-`` and ``_`` are letters of base 64)."""
    rest = F.translate(token, SEPARATORS, "")
    return F.when(alphabet(rest) < 64, rest).otherwise(F.regexp_replace(token, "=+$", ""))


def ordinary(token: Column) -> Column:
    """p-value of the three tests together: small where an ordinary token would hardly look as random."""
    body = bare(token)

    def tests(v: Column) -> Column:
        t, n, k = v["t"], v["n"], v["k"]
        chars = F.filter(F.split(t, ""), lambda c: c != "")
        counts = F.transform(F.array_distinct(chars), lambda c: n - F.length(F.replace(t, c, F.lit(""))))
        squares = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x)
        chi = squares * k / n - n
        excess = F.greatest(k * F.greatest(F.lit(TEXT_REPEAT), F.lit(1.6) / k) - 1, F.lit(0.3))
        uniform = normal_cdf((chi - (k - 1) - n * excess) / F.sqrt(2 * (k - 1) + 4 * n * excess))

        classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.translate(t, "_/+-", ""), "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "0")
        changes = F.regexp_count(classes, F.lit("a+|B+|0+")) - 1
        runs = 1 - normal_cdf((changes - (n - 1) * TEXT_CHANGES - 0.5) / F.sqrt((n - 1) * TEXT_CHANGES * (1 - TEXT_CHANGES)))

        codes = F.transform(chars, lambda c: F.ascii(c).cast("double"))

        def serial(x: Column) -> Column:
            mean = F.aggregate(x, F.lit(0.0), lambda s, y: s + y) / n
            spread = F.aggregate(x, F.lit(0.0), lambda s, y: s + (y - mean) * (y - mean))
            pairs = F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: (a - mean) * (b - mean))
            z = F.coalesce(F.try_divide(F.aggregate(pairs, F.lit(0.0), lambda s, y: s + y), spread), F.lit(1.0)) * F.sqrt(n)
            return 2 * normal_cdf(F.abs(z) / TEXT_SPREAD) - 1

        parts = [F.greatest(p, F.lit(LEAST_P)) for p in (uniform, runs, let(codes, serial))]
        half = -(F.log(parts[0]) + F.log(parts[1]) + F.log(parts[2]))  # half of Fisher's statistic, six degrees of freedom
        return let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))

    return let(F.struct(body.alias("t"), F.length(body).cast("double").alias("n"), alphabet(body).alias("k")), tests)


def _kind(name: str, found: Column) -> Column:
    return F.transform(found, lambda m: F.struct(
        m["start"].alias("start"), F.lit(KINDS.index(name)).alias("nth"), m["end"].alias("end"), F.lit(name).alias("kind"),
        F.lit(None).cast("double").alias("p"), F.lit(None).cast("double").alias("bits"),
    ))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and tested candidates of each row's whole text."""
    text = F.col("text")
    rows = plain(docs, "doc_id", "text").select("doc_id", text_of().alias("text"))
    assign = matches(text, ASSIGN, F.contains(text, F.lit(":")) | F.contains(text, F.lit("=")))
    assign = F.filter(assign, lambda m: F.length(F.regexp_extract(m["text"], ASSIGN, 1)) >= 8)
    base = F.concat(_kind("assign", assign), _kind("access", matches(text, ACCESS, F.contains(text, F.lit("AKIA")))), _kind("hex", matches(text, HEX)))
    out = rows.select("doc_id", base.alias("base"), matches(text, TOKEN).alias("tokens"))
    free = F.filter("tokens", lambda c: ~F.exists("base", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])))
    tested = F.transform(free, lambda m: F.struct(
        m["start"].alias("start"), F.lit(3).alias("nth"), m["end"].alias("end"), F.lit("random").alias("kind"),
        ordinary(m["text"]).alias("p"), let(bare(m["text"]), lambda t: F.length(t) * F.log2(alphabet(t))).alias("bits"),
    ))
    return out.select("doc_id", "base", tested.alias("tested"))


def _bin(p: Column, weight: Column) -> Column:
    """Bin of a weighted p-value, by its logarithm; rounded to the side of larger p-values."""
    return F.least(F.lit(BINS), F.greatest(F.lit(0), F.floor(-F.log(F.greatest(p / weight, F.lit(1e-80))) * PER_UNIT))).cast("int")


def find_secrets(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """doc_id, base and random spans (start, nth kind, end, kind, p, bits) of every row.

    Null text counts as empty and has no spans. Repeated rows are searched each, and each counts as a
    candidate of its own for the false-discovery control; other columns are not looked at; an empty table
    gives none.
    """
    found = materialize(candidates(docs), "secrets")
    each = found.select(F.explode("tested").alias("t")).select("t.p", "t.bits")
    n, mean_bits = each.agg(F.count("*"), F.avg("bits")).first()
    if not n:
        return found.select("doc_id", "base", F.col("tested").alias("random"))
    weight = F.lit(1.0 / mean_bits)
    bins = each.groupBy(_bin(F.col("p"), F.col("bits") * weight).alias("bin")).agg(F.count("*").alias("n"))
    # Benjamini-Hochberg on the bins' upper edges: the largest p with p * m <= rank * share
    ranked = bins.withColumn("rank", F.sum("n").over(Window.orderBy(F.desc("bin"))))
    passes = ranked.where(F.exp(-F.col("bin") / PER_UNIT) * n <= F.col("rank") * false_share)
    edge = passes.agg(F.min("bin")).first()[0]
    taken = F.lit(False) if edge is None else None
    random = F.filter("tested", lambda t: taken if taken is not None else _bin(t["p"], t["bits"] * weight) >= edge)
    return found.select("doc_id", "base", random.alias("random"))


def op7_secrets(docs: DataFrame) -> DataFrame:
    out = find_secrets(docs).select("doc_id", F.sort_array("base").alias("base"), "random")

    def n(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    spans = listed(F.sort_array(F.concat("base", "random")))
    return out.select("doc_id", *[n(k) for k in KINDS[:3]], digest(listed(F.col("base"))).alias("base_sha256"), spans.alias("spans"))
