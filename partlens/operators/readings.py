"""Operators on tables of readings: votes, candidates, comparison of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partlens.functions import strings as S


def consensus(df: DataFrame, keys: list[str], text: str, min_share: float = 0.5, fallback: str = "most") -> DataFrame:
    """The string that more than ``min_share`` of a group's readings agree on, else the most (or
    ``least``) frequent one; ties go to the smaller string. Empty strings and nulls count as readings but win only where a
    group has no other, and nulls only where it has nothing else. Adds votes and share. One shuffle of partial counts, one window over the distinct strings of a
    group."""
    votes = df.groupBy(*keys, text).agg(F.count("*").alias("votes"))
    group = Window.partitionBy(*keys)
    count = F.col("votes") if fallback == "least" else -F.col("votes")
    share = F.col("votes") / F.sum("votes").over(group)
    votes = votes.withColumn("share", share)
    blank = F.when(F.col(text).isNull(), 2).when(F.col(text) == "", 1).otherwise(0)
    order = group.orderBy(blank, (F.col("share") <= min_share).cast("int"), count, F.col(text))
    return votes.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def consensus_mashed(df: DataFrame, keys: list[str], text: str, min_share: float = 0.6) -> DataFrame:
    """A16, array form: the string that more than ``min_share`` of a group's readings agree on; else its strings, from
    the least frequent on (ties: the smaller first), until they make up more than that share, mashed into one. Empty
    strings count as readings but are passed over."""
    votes = df.groupBy(*keys, text).agg(F.count("*").alias("votes"))
    group = Window.partitionBy(*keys)
    votes = votes.withColumn("n", F.sum("votes").over(group)).where(F.col(text) != "")
    upto = F.sum("votes").over(group.orderBy("votes", text).rowsBetween(Window.unboundedPreceding, 0))
    votes = votes.withColumn("upto", upto).withColumn("won", F.col("votes") > min_share * F.col("n"))
    short = votes.where(F.col("won") | (F.col("upto") - F.col("votes") <= min_share * F.col("n")))
    listed = short.groupBy(*keys).agg(F.max(F.when(F.col("won"), F.col(text))).alias("winner"), F.sort_array(F.collect_list(F.struct("votes", text))).alias("all"))
    mashed = F.aggregate(F.col(f"all.{text}"), F.lit(""), lambda so_far, x: S.mash(so_far, x))
    return df.select(*keys).distinct().join(listed, keys, "left").select(*keys, F.coalesce("winner", mashed, F.lit("")).alias("text"))


def consensus_for_pattern(df: DataFrame, keys: list[str], text: str, template: str) -> DataFrame:
    """Consensus of the strings that meet the template; a group without one gets an empty string."""
    fixed = df.withColumn("fixed", S.verify_template(F.col(text), F.col(template)))
    won = consensus(fixed.where("fixed <> ''"), keys, "fixed").select(*keys, "fixed")
    return df.select(*keys).distinct().join(won, keys, "left").select(*keys, F.coalesce("fixed", F.lit("")).alias("text"))


def candidates(df: DataFrame) -> DataFrame:
    """part_id, reading_id, text, score: T01, T02 and T09 of every reading."""
    clean = S.remove_spaces(S.clean_text(F.col("raw")))
    out = df.withColumn("clean", clean)
    return out.select("part_id", "reading_id", "template", F.explode(S.match_template(F.col("clean"), F.col("template"))).alias("c")).select(
        "part_id", "reading_id", "template", F.col("c.text").alias("text"), F.col("c.score").alias("score")
    )


def rank_candidates(df: DataFrame, keys: list[str], *ties: str) -> DataFrame:
    """Candidates by score, best first."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), *ties)))


def reading_pipeline(readings: DataFrame) -> DataFrame:
    """What each part's label reads: cleaned readings, matched to the template, voted, corrected and
    checked. A part without a candidate reads empty and does not match."""
    won = consensus(candidates(readings), ["part_id", "template"], "text")
    parts = readings.select("part_id", "template").distinct()
    out = parts.join(won, ["part_id", "template"], "left")
    text = S.correct_to_template(F.coalesce("text", F.lit("")), F.col("template"))
    out = out.withColumn("label", text)
    return out.select(
        "part_id", "template", "label", F.coalesce("votes", F.lit(0)).cast("long").alias("votes"), F.round(F.coalesce("share", F.lit(0.0)), 9).alias("share"),
        (S.verify_template(F.col("label"), F.col("template")) != "").alias("matches"),
    )


def line_ratio(a: Column, b: Column) -> Column:
    """Similarity of two strings from 0 to 100: normalised edit distance."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(100)).otherwise(F.floor((longest - F.levenshtein(a, b)) * 100 / longest)).cast("int")


def fuzzy_line_match(pairs: DataFrame, left: str, right: str, strict: bool = False, min_ratio: int = 89) -> DataFrame:
    """Texts of a row compared line by line, blank lines dropped: similar lines, the smaller line count and
    whether the texts match. The lines of a row stay in the row; nothing is joined."""

    def lines(c: str) -> Column:
        return F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(x) != "")

    out = pairs.withColumn("_l", lines(left)).withColumn("_r", lines(right))
    n = F.least(F.size("_l"), F.size("_r"))
    same = F.size(F.filter(F.zip_with(F.slice("_l", F.lit(1), n), F.slice("_r", F.lit(1), n), line_ratio), lambda x: x > min_ratio))
    out = out.withColumn("n_lines", n).withColumn("n_similar", same)
    share = F.coalesce(F.try_divide("n_similar", "n_lines"), F.lit(0.0))
    ok = (share >= 0.5) & (F.size("_l") == F.size("_r")) if strict else share >= 0.8
    return out.withColumn("matched", ok).drop("_l", "_r")
