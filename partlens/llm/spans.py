"""Spans in texts, by built-in functions: where a pattern matches, in code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH = "array<struct<start:int,end:int,text:string>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def matches(text: Column, pattern: str, guard: Column | None = None) -> Column:
    """The leftmost non-overlapping matches of a pattern: array of start, end (exclusive), text.

    The parts between the matches give the places. ``guard``: a cheap condition without which there is
    no match.
    """
    none = F.array().cast(MATCH)

    def places(found: Column) -> Column:
        zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"))
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))

        def step(s: Column, z: Column) -> Column:
            begin = s["at"] + F.length(z["gap"])
            end = begin + F.coalesce(F.length(z["hit"]), F.lit(0))
            span = F.struct(begin.alias("start"), end.alias("end"), z["hit"].alias("text"))
            return F.struct(end.alias("at"), F.concat(s["out"], F.array(span).cast(MATCH)).alias("out"))

        return F.filter(F.aggregate(zipped, start, step, lambda s: s["out"]), lambda m: m["text"].isNotNull())

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda f: F.when(F.size(f) == 0, none).otherwise(places(f)))
    return found if guard is None else F.when(guard, found).otherwise(none)


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined, in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
