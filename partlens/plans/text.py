"""Queries on readings and their strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlens.functions import strings as S
from partlens.operators import readings as R

from .registry import register


def _string(name: str, f, sql: str) -> None:
    """A function of the raw reading."""
    register(name, "readings", lambda df: df.select("reading_id", f(F.col("raw")).alias("out")), f"SELECT reading_id, {sql} AS out FROM readings")


# the characters to delete, each by its own replacement
PUNCT = "raw"
for _c in "()[]-_.,{'\"}/|\\;:!<>*©’%@#$^&~`?":
    PUNCT = "replace({}, '{}', '')".format(PUNCT, _c.replace("'", "''"))
_string("t01_clean_text", S.clean_text, f"upper(trim({PUNCT}))")
_string("t02_remove_spaces", S.remove_spaces, "upper(trim(replace(raw, ' ', '')))")
_string("t03_letters_to_digits", S.letters_to_digits, "trim(translate(raw, 'BCDGIJLOQSTZ', '860617400512'))")
_string("t04_digits_to_letters", S.digits_to_letters, "upper(trim(translate(raw, '8174052', 'BITLOSZ')))")
_string(
    "t05_numeral_for_char", S.numeral_for_char,
    "regexp_replace(translate(raw, 'abcefgijloqstzBCDEGHIJLOQSTXZ', '86081917109512860664171005782'), '[^0-9]', '?', 'g')",
)
_string("t06_char_for_numeral", S.char_for_numeral, "regexp_replace(translate(raw, '1256780', 'IZSBTBO'), '[^A-Z]', '?', 'g')")
register(
    "t07_template_to_regex", "readings",
    lambda df: df.select("reading_id", S.template_to_regex(F.col("raw")).alias("out")),
    "SELECT reading_id, replace(replace(regexp_replace(raw, '[^AD]', '', 'g'), 'D', '[0-9]'), 'A', '[A-Za-z]') AS out FROM readings",
)

_LETTER = "upper(translate({c}, '8174052', 'BITLOSZ'))"
_DIGIT = "translate({c}, 'BCDGIJLOQSTZ', '860617400512')"


def _place(s: str, i: int) -> str:
    return f"substr({s}, {i}, 1)"


def _verified(s: str) -> str:
    """T08 for the template AADD."""
    fixed = " || ".join((_LETTER if i < 3 else _DIGIT).format(c=_place(s, i)) for i in range(1, 5))
    return f"CASE WHEN length({s}) = 4 AND regexp_matches({fixed}, '^[A-Za-z][A-Za-z][0-9][0-9]$') THEN {fixed} ELSE '' END"


def _corrected(s: str) -> str:
    """T10 for the template AADD."""
    letter = "CASE WHEN regexp_matches({c}, '[A-Z]') THEN {c} WHEN strpos('1256780', {c}) > 0 THEN translate({c}, '1256780', 'IZSBTBO') ELSE '?' END"
    digit = (
        "CASE WHEN regexp_matches({c}, '[0-9]') THEN {c} WHEN strpos('abcefgijloqstzBCDEGHIJLOQSTXZ', {c}) > 0"
        " THEN translate({c}, 'abcefgijloqstzBCDEGHIJLOQSTXZ', '86081917109512860664171005782') ELSE '?' END"
    )
    fixed = " || ".join((letter if i < 3 else digit).format(c=_place(s, i)) for i in range(1, 5))
    return f"CASE WHEN length({s}) = 4 THEN {fixed} ELSE {s} END"


CLEAN = f"upper(trim({PUNCT}))"
CANDIDATES = f"""
, clean AS (SELECT part_id, reading_id, template, upper(trim(replace({CLEAN}, ' ', ''))) AS s FROM readings),
hits AS (SELECT *, regexp_extract_all(s, '[A-Za-z][A-Za-z][0-9][0-9]') AS m FROM clean),
cand AS (SELECT part_id, reading_id, template, text, CAST(floor(length(text) * 100 / length(s)) AS INT) AS score FROM (SELECT *, unnest(m) AS text FROM hits) q
  UNION ALL SELECT part_id, reading_id, template, s, CAST(floor(60 * (1 - (length(s) - 4) / greatest(length(s), 4))) AS INT)
  FROM hits WHERE len(m) = 0 AND length(s) >= 4)"""

register(
    "t08_verify_template", "readings",
    lambda df: df.select("reading_id", S.verify_template(S.clean_text(F.col("raw")), F.col("template")).alias("out")),
    f", c AS (SELECT reading_id, {CLEAN} AS s FROM readings) SELECT reading_id, {_verified('s')} AS out FROM c",
)
register("t09_match_template", "readings", lambda df: R.candidates(df).select("reading_id", "text", "score"), CANDIDATES + " SELECT reading_id, text, score FROM cand")
register(
    "t10_correct_to_template", "readings",
    lambda df: df.select("reading_id", S.correct_to_template(S.clean_text(F.col("raw")), F.col("template")).alias("out")),
    f", c AS (SELECT reading_id, {CLEAN} AS s FROM readings) SELECT reading_id, {_corrected('s')} AS out FROM c",
)
register(
    "t11_mash", "readings", lambda df: df.select("reading_id", S.mash(F.col("template"), F.col("raw")).alias("out")),
    "SELECT reading_id, template || substr(raw, length(template) + 1) AS out FROM readings",
)


def _reshaped(df: DataFrame) -> DataFrame:
    lists = df.groupBy("part_id").agg(F.sort_array(F.collect_list("raw")).alias("a"))
    rows = F.transform(S.reshape_rows(F.col("a"), 3), lambda r: F.array_join(r, "|"))
    return lists.select("part_id", F.array_join(rows, "\n").alias("out"))


register(
    "t12_reshape_rows", "readings", _reshaped,
    """, n AS (SELECT part_id, raw, row_number() OVER (PARTITION BY part_id ORDER BY raw) - 1 AS i FROM readings),
    r AS (SELECT part_id, i // 3 AS k, string_agg(raw, '|' ORDER BY i) AS line FROM n GROUP BY ALL)
    SELECT part_id, string_agg(line, chr(10) ORDER BY k) AS out FROM r GROUP BY part_id""",
)
register(
    "t13_drop_spurious", "detections", lambda df: df.select("scan_id", "variant", S.drop_spurious(F.col("code")).alias("out")),
    "SELECT scan_id, variant, CASE WHEN code IS NULL OR code IN ('DataMatrix', 'null') THEN '' ELSE code END AS out FROM detections",
)
register(
    "t14_run_timestamp", "capture_events", lambda df: df.select("event_id", S.run_timestamp(F.col("ts")).alias("out")),
    "SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS out FROM capture_events",
)

VOTES = ", v AS (SELECT part_id, raw, count(*) AS votes FROM {source} GROUP BY ALL), s AS (SELECT *, votes / sum(votes) OVER (PARTITION BY part_id) AS share FROM v)"
for _source, _gaps in (("readings", ""), ("gappy_readings", "_with_nulls")):
    for _fallback, _sign in (("most", "-"), ("least", "")):
        register(
            f"a16_consensus_string_{_fallback}{_gaps}", _source,
            lambda df, f=_fallback: R.consensus(df, ["part_id"], "raw", fallback=f).select("part_id", "raw", "votes", F.round("share", 9).alias("share")),
            VOTES.format(source=_source) + f""" SELECT part_id, raw, votes, round(share, 9) AS share FROM s
            QUALIFY row_number() OVER (PARTITION BY part_id ORDER BY raw IS NULL, raw = '', share <= 0.5, {_sign}votes, raw) = 1""",
        )
    register(
        f"a16_consensus_string_mashed{_gaps}", _source, lambda df: R.consensus_mashed(df, ["part_id"], "raw"),
        VOTES.format(source=_source) + f""", r AS (SELECT *, sum(votes) OVER (PARTITION BY part_id ORDER BY votes, raw ROWS UNBOUNDED PRECEDING) AS upto, round(votes / share) AS n FROM s WHERE raw <> ''),
        l AS (SELECT part_id, max(raw) FILTER (votes > 0.6 * n) AS winner, list(raw ORDER BY votes, raw) FILTER (votes > 0.6 * n OR upto - votes <= 0.6 * n) AS a FROM r GROUP BY part_id)
        SELECT p.part_id, coalesce(winner, list_reduce(a, lambda x, y: x || substr(y, length(x)::INT + 1)), '') AS text FROM (SELECT DISTINCT part_id FROM {_source}) p LEFT JOIN l USING (part_id)""",
    )
register(
    "a17_consensus_for_pattern", "readings",
    lambda df: R.consensus_for_pattern(df.withColumn("raw", S.clean_text(F.col("raw"))), ["part_id"], "raw", "template"),
    f""", c AS (SELECT part_id, {CLEAN} AS s FROM readings), f AS (SELECT part_id, {_verified('s')} AS t FROM c),
    v AS (SELECT part_id, t, count(*) AS n FROM f WHERE t <> '' GROUP BY ALL),
    w AS (SELECT part_id, t FROM v QUALIFY row_number() OVER (PARTITION BY part_id ORDER BY n DESC, t) = 1)
    SELECT p.part_id, coalesce(w.t, '') AS text FROM (SELECT DISTINCT part_id FROM f) p LEFT JOIN w USING (part_id)""",
)
register(
    "w20_rank_candidates", "readings",
    lambda df: R.rank_candidates(R.candidates(df), ["part_id"], "text", "reading_id").select("part_id", "reading_id", "text", "score", "rank"),
    CANDIDATES + " SELECT part_id, reading_id, text, score, row_number() OVER (PARTITION BY part_id ORDER BY score DESC, text, reading_id)::INT AS rank FROM cand",
)


def _sorted_entries(df: DataFrame) -> DataFrame:
    """A map's entries by key, and by value (ties by key), up or down."""
    votes = df.groupBy("part_id", "raw").agg(F.count("*").alias("n"))
    maps = votes.groupBy("part_id").agg(F.map_from_entries(F.collect_list(F.struct("raw", "n"))).alias("m"))
    entries = F.map_entries("m")
    by_value = F.array_sort(F.transform(entries, lambda e: F.struct(e["value"].alias("value"), e["key"].alias("key"))))

    def text(a: Column, key: str = "key") -> Column:
        return F.array_join(F.transform(a, lambda e: e[key]), "|")

    return maps.select("part_id", text(F.array_sort(entries)).alias("by_key"), text(F.reverse(F.array_sort(entries))).alias("by_key_desc"), text(by_value).alias("by_value"), text(F.reverse(by_value)).alias("by_value_desc"))


register(
    "w21_sort_map_entries", "readings", _sorted_entries,
    """, v AS (SELECT part_id, raw, count(*) AS n FROM readings GROUP BY ALL)
    SELECT part_id, string_agg(raw, '|' ORDER BY raw) AS by_key, string_agg(raw, '|' ORDER BY raw DESC) AS by_key_desc,
    string_agg(raw, '|' ORDER BY n, raw) AS by_value, string_agg(raw, '|' ORDER BY n DESC, raw DESC) AS by_value_desc FROM v GROUP BY part_id""",
)
register(
    "u01_append_candidates", "readings",
    lambda df: R.rank_candidates(R.candidates(df).unionByName(R.candidates(df.withColumn("raw", F.reverse("raw")))).withColumn("n", F.lit(1)), ["part_id"], "text", "reading_id").select("part_id", "reading_id", "text", "score", "rank"),
    CANDIDATES
    + ", readings2 AS (SELECT part_id, reading_id, template, reverse(raw) AS raw FROM readings)"
    + CANDIDATES.replace("FROM readings)", "FROM readings2)").replace("clean", "clean2").replace("hits", "hits2").replace("cand AS", "cand2 AS")
    + """, u AS (SELECT * FROM cand UNION ALL SELECT * FROM cand2)
    SELECT part_id, reading_id, text, score, row_number() OVER (PARTITION BY part_id ORDER BY score DESC, text, reading_id)::INT AS rank FROM u""",
)
_LABELS = (
    CANDIDATES
    + f""", v AS (SELECT part_id, template, text, count(*) AS votes FROM cand GROUP BY ALL),
    s AS (SELECT *, votes / sum(votes) OVER (PARTITION BY part_id, template) AS share FROM v),
    w AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY part_id, template ORDER BY (share <= 0.5)::INT, votes DESC, text) = 1),
    o AS (SELECT p.part_id, p.template, coalesce(w.text, '') AS t, coalesce(w.votes, 0) AS votes, round(coalesce(w.share, 0), 9) AS share
      FROM (SELECT DISTINCT part_id, template FROM readings) p LEFT JOIN w USING (part_id, template)),
    l AS (SELECT *, {_corrected('t')} AS label FROM o)
    SELECT part_id, template, label, votes, share, ({_verified('label')}) <> '' AS matches FROM l"""
)
register("e05_reading_pipeline", "readings", R.reading_pipeline, _LABELS)
register("e05_reading_pipeline_with_nulls", "gappy_readings", R.reading_pipeline, _LABELS.replace("FROM readings)", "FROM gappy_readings)"))


def _noisy_lines(df: DataFrame) -> DataFrame:
    """Each text beside itself as a reader would confuse it: e read as c."""
    return df.select("conv_id", "turn", "text", F.translate("text", "eo", "co").alias("read"))


_SIMILAR = "(count(*) FILTER (CAST(floor((length(x) - levenshtein(x, y)) * 100 / length(x)) AS INT) > 89))"
for _strict in (False, True):
    register(
        "j07_fuzzy_line_match" + "_strict" * _strict, "conversations",
        lambda df, s=_strict: R.fuzzy_line_match(_noisy_lines(df), "read", "text", s).select("conv_id", "turn", "n_lines", "n_similar", "matched"),
        f"""WITH l AS (SELECT conv_id, turn, x, translate(x, 'eo', 'co') AS y FROM (SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM conversations) q WHERE trim(x) <> '')
        SELECT d.conv_id, d.turn, count(l.x)::INT AS n_lines, {_SIMILAR}::INT AS n_similar,
        coalesce({_SIMILAR} / nullif(count(l.x), 0), 0) >= {0.5 if _strict else 0.8} AS matched
        FROM conversations d LEFT JOIN l USING (conv_id, turn) GROUP BY d.conv_id, d.turn""",
    )
