"""String functions for readings, as Column expressions without UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that are deleted, and what one class of character is often read for.
DELETED = "()[]-_.,{'\"}/|\\;:!<>*©’%@#$^&~`?"
LETTERS_READ_AS_DIGITS = ("BCDGIJLOQSTZ", "860617400512")
DIGITS_READ_AS_LETTERS = ("8174052", "BITLOSZ")
DIGIT_FOR_LOWER = ("abcefgijloqstz", "86081917109512")
DIGIT_FOR_UPPER = ("BCDEGHIJLOQSTXZ", "860664171005782")
LETTER_FOR_DIGIT = ("1256780", "IZSBTBO")


def clean_text(s: Column) -> Column:
    """Without the deleted characters, trimmed, upper case. ``+`` and ``=`` stay."""
    return F.upper(F.trim(F.translate(s, DELETED, "")))


def remove_spaces(s: Column) -> Column:
    """T02."""
    return F.upper(F.trim(F.replace(s, F.lit(" "), F.lit(""))))


def letters_to_digits(s: Column) -> Column:
    """Trimmed."""
    return F.trim(F.translate(s, *LETTERS_READ_AS_DIGITS))


def digits_to_letters(s: Column) -> Column:
    """Trimmed, upper case."""
    return F.upper(F.trim(F.translate(s, *DIGITS_READ_AS_LETTERS)))


def numeral_for_char(s: Column) -> Column:
    """Each character as the digit it is likely meant for, ``?`` where there is none."""
    lower, upper = DIGIT_FOR_LOWER, DIGIT_FOR_UPPER
    known = F.translate(s, lower[0] + upper[0], lower[1] + upper[1])
    return F.regexp_replace(known, "[^0-9]", "?")


def char_for_numeral(s: Column) -> Column:
    """Each character as the capital letter it is likely meant for, ``?`` where there is none."""
    return F.regexp_replace(F.translate(s, *LETTER_FOR_DIGIT), "[^A-Z]", "?")


def template_to_regex(p: Column) -> Column:
    """A stands for a letter, D for a digit; other characters are ignored."""
    marks = F.regexp_replace(p, "[^AD]", "")
    return F.replace(F.replace(marks, F.lit("D"), F.lit("[0-9]")), F.lit("A"), F.lit("[A-Za-z]"))


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def verify_template(s: Column, p: Column) -> Column:
    """The string with each character as its template place wants it, or empty where one cannot be."""
    fixed = F.zip_with(_chars(s), _chars(p), lambda c, t: F.when(t == "A", digits_to_letters(c)).when(t == "D", letters_to_digits(c)).otherwise(c))
    right = F.zip_with(fixed, _chars(p), lambda c, t: F.when(t == "A", c.rlike("^[A-Za-z]$")).when(t == "D", c.rlike("^[0-9]$")).otherwise(F.lit(True)))
    ok = (F.length(s) == F.length(p)) & F.forall(right, lambda x: x)
    return F.when(ok, F.array_join(fixed, "")).otherwise(F.lit(""))


def match_template(s: Column, p: Column) -> Column:
    """Array of (text, score): all matches of the template, with the share of the string that each is;
    without a match a string at least as long as the template stands for itself at a lower score."""
    found = F.regexp_extract_all(s, template_to_regex(p), F.lit(0))
    scored = F.transform(found, lambda m: F.struct(m.alias("text"), F.floor(F.length(m) * 100 / F.length(s)).cast("int").alias("score")))
    gap = (F.length(s) - F.length(p)) / F.greatest(F.length(s), F.length(p))
    whole = F.array(F.struct(s.alias("text"), F.floor(F.lit(60) * (1 - gap)).cast("int").alias("score")))
    none = F.array().cast("array<struct<text:string,score:int>>")
    return F.when(F.size(found) > 0, scored).when((F.length(s) >= F.length(p)) & (F.length(s) > 0), whole).otherwise(none)


def correct_to_template(s: Column, p: Column) -> Column:
    """Characters corrected to their places where the lengths agree; other strings as they are."""
    fixed = F.zip_with(_chars(s), _chars(p), lambda c, t: F.when(t == "A", char_for_numeral(c)).when(t == "D", numeral_for_char(c)).otherwise(c))
    return F.when(F.length(s) == F.length(p), F.array_join(fixed, "")).otherwise(s)


def mash(a: Column, b: Column) -> Column:
    """A, and what b has beyond a's length."""
    return F.concat(a, F.substring(b, F.length(a) + 1, F.greatest(F.length(b) - F.length(a), F.lit(0))))


def reshape_rows(a: Column, n: int) -> Column:
    """A list in rows of n."""
    rows = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / n).cast("int"))
    return F.when(F.size(a) > 0, F.transform(rows, lambda i: F.slice(a, i * n + 1, n))).otherwise(F.array().cast("array<array<string>>"))


def drop_spurious(s: Column, words: tuple[str, ...] = ("DataMatrix", "null")) -> Column:
    """Null and listed words become empty."""
    return F.when(s.isNull() | s.isin(*words), F.lit("")).otherwise(s)


def run_timestamp(ts: Column) -> Column:
    """T14."""
    return F.date_format(ts, "yyyyMMddHHmmss")


def base_name(path: Column) -> Column:
    """The last element of a path up to its first dot."""
    return F.regexp_extract(path, r"([^/.]*)[^/]*$", 1)
