"""Scalar text functions as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardweave.functions import constants as C


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value planned and worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def safe_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def normalize_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_trailing_punct(c: Column) -> Column:
    return F.rtrim(F.trim(c), F.lit(".,;:"))


def canonical(c: Column) -> Column:
    """Compare key: lower case, easily confused characters made one, only a-z and 0-9."""
    return F.regexp_replace(F.translate(F.lower(safe_text(c)), "l|oqsbz", "110g582"), "[^a-z0-9]", "")


_ALIKE = str.maketrans("l|oqsbz", "110g582")


def canonical_of(text: str) -> str:
    """``canonical`` of one text, in Python."""
    low = text.lower().translate(_ALIKE)
    return low if low.isascii() and low.isalnum() else re.sub("[^a-z0-9]", "", low)


def letters(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\p{L}"))


def alpha_ratio(c: Column) -> Column:
    return letters(c) / F.greatest(F.lit(1), F.length(c))


def digit_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\p{Nd}"))


def upper_dominant(c: Column) -> Column:
    return (letters(c) > 0) & (F.regexp_count(c, F.lit(r"\p{Lu}")) / F.greatest(F.lit(1), letters(c)) >= 0.6)


def is_upper(c: Column) -> Column:
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"\p{Ll}")


def is_title(c: Column) -> Column:
    """Equal to itself with each run of letters capitalised."""
    return ~c.rlike(r"(^|\P{L})\p{Ll}") & ~c.rlike(r"\p{L}\p{Lu}")


def repair_digits(c: Column) -> Column:
    return F.when(upper_dominant(c), F.translate(c, "0134578", "OIEASTB")).otherwise(c)


def confusions(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[lI|oqQSBsZz]"))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def has_hint(c: Column, hints: list[str]) -> Column:
    """Whether the text holds one of the hints as a substring: one scan with an alternation."""
    return F.lower(c).rlike("|".join(re.sub(r"([.()+*?\[\]{}|^$\\])", r"\\\1", h) for h in hints))


def fidelity(c: Column) -> Column:
    t = F.trim(safe_text(c))
    score = (
        F.least(F.length(t), F.lit(40)) + alpha_ratio(t) * 18.0 - confusions(t) * 2.5 - digit_count(t) * 0.25
        + F.when(is_title(t) | is_upper(t), 3.0).otherwise(0.0) + F.when(has_hint(t, C.COMPANY_HINTS), 1.5).otherwise(0.0)
    )
    return F.when(t == "", F.lit(-100.0)).otherwise(score)


def collapse_spaced_letters(c: Column) -> Column:
    """A text of single characters set apart, ``S E N I O R``, without the spaces; other texts as they are."""
    return F.when(c.rlike(r"(?U)^\S(?:\s+\S)+$"), F.regexp_replace(c, r"(?U)\s+", "")).otherwise(c)


def spaced_letters(c: Column) -> Column:
    """Whether a text is two or more Latin letters set apart, each with a stop or none."""
    return F.trim(c).rlike(r"(?U)^[A-Za-z]\.?(?:\s+[A-Za-z]\.?)+$")


def word_of_line(c: Column) -> Column:
    """A token as lines take it: trimmed, digits in capitals repaired, stops at its end gone."""
    return strip_trailing_punct(repair_digits(F.regexp_replace(safe_text(c), r"(?U)^\s+|\s+$", "")))


def phone_normal(c: Column) -> Column:
    clean = normalize_spaces(F.regexp_replace(F.translate(safe_text(c), "–—", "--"), r"(?U)[^\d+()\-\s./]", " "))
    digits = F.regexp_replace(clean, r"\D", "")
    return F.when(F.length(digits) < 7, "").when(clean.startswith("+"), F.concat(F.lit("+"), digits)).otherwise(clean)


def file_stem(c: Column) -> Column:
    stem = F.regexp_replace(F.regexp_replace(safe_text(c), r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(stem, F.lit("")), F.lit("card"))


def postal_region(c: Column) -> Column:
    return F.coalesce(*(F.when(c.rlike(p), r) for r, p in C.POSTAL))


def postal_text(c: Column) -> Column:
    return F.coalesce(*(F.when(c.rlike(p), F.regexp_extract(c, p, 0)) for _, p in C.POSTAL))


def signature(*fields: Column) -> Column:
    return F.concat_ws("|", *(canonical(f) for f in fields))


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy_MM")


def text_profile(lines: DataFrame, col: str, by: str) -> DataFrame:
    """For each group: lines, mean alpha ratio, digit, upper, confusion and word totals, distinct keys, mean fidelity."""
    c = normalize_spaces(F.col(col))
    return lines.groupBy(by).agg(
        F.count("*").alias("n_lines"),
        F.round(F.avg(alpha_ratio(c)), 6).alias("alpha"),
        F.sum(digit_count(c)).cast("long").alias("digits"),
        F.sum(upper_dominant(c).cast("int")).cast("long").alias("upper_lines"),
        F.sum(confusions(c)).cast("long").alias("confusions"),
        F.sum(word_count(c)).cast("long").alias("words"),
        F.sum(F.length(repair_digits(c))).cast("long").alias("chars"),
        F.countDistinct(canonical(c)).alias("keys"),
        F.round(F.avg(fidelity(c)), 6).alias("fidelity"),
    )
