"""Cleaning, coercion and labelling of single columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTINELS = ("", ":", "..", "-", "—", "NA", "N/A")
TRUE_WORDS = ("1", "true", "t", "yes", "y", "flagged")
FALSE_WORDS = ("0", "false", "f", "no", "n", "not flagged")


def finite(c: Column) -> Column:
    """c as a double, null where it isn't a finite number."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def to_number(c: Column) -> Column:
    """A number out of text: thousands commas go, sentinels and anything else become null."""
    t = F.trim(c.cast("string"))
    return F.when(~t.isin(*SENTINELS), F.regexp_replace(t, ",", "").try_cast("double"))


def pct(num: Column, den: Column) -> Column:
    """100 * num / den, null where den is null or 0."""
    return F.when(den != 0, 100.0 * num / den)


def clean_text(c: Column) -> Column:
    """Trimmed, white space runs as one space; blanks and NULL words as null."""
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(~F.upper(t).isin("", "NULL", "NA", "N/A"), t)


def bucket_by_pattern(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The label of the first pattern that matches; UNKNOWN for other text, null for none."""
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for pattern, label in rules:
        out = out.when(c.rlike(pattern), F.lit(label))
    return out.otherwise(F.lit("UNKNOWN"))


def to_binary(c: Column) -> Column:
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin(*TRUE_WORDS), 1).when(t.isin(*FALSE_WORDS), 0)


def fill_category(c: Column, level: str = "UNRESOLVED") -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(level))


def level(c: Column, low: float = -0.5, high: float = 0.5, very_low: float = -1.0, very_high: float = 1.0) -> Column:
    """very_low, low, near, high or very_high; the outer levels win."""
    return F.when(c.isNull(), None).when(c >= very_high, "very_high").when(c <= very_low, "very_low").when(c >= high, "high").when(c <= low, "low").otherwise("near")


def strength_flag(c: Column, strong: float, moderate: float) -> Column:
    return F.when(c.isNull(), "NOT_AVAILABLE").when(c >= strong, "STRONG").when(c >= moderate, "MODERATE").otherwise("CAUTIOUS")


def format_number_strict(c: Column, digits: int = 2, tolerance: float = 1e-9, missing: str = "NA") -> Column:
    """Whole numbers without decimals, others with `digits`; thousands separated, never a negative zero."""
    whole = F.abs(c - F.round(c)) <= tolerance
    value = F.when(whole, F.round(c)).otherwise(F.round(c, digits))
    value = F.when(value == 0, F.lit(0.0)).otherwise(value)
    return F.when(finite(c).isNull(), missing).when(whole, F.format_number(value, 0)).otherwise(F.format_number(value, digits))


def first_nonmissing(*cs: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in cs])


def mentions_id(text: Column, item: Column) -> Column:
    """Whether text names the id as a word of its own: 1 is not in 10, 1.0 or B1."""
    return F.regexp_like(text, F.concat(F.lit(r"(?<![A-Za-z0-9.+-])"), item.cast("string"), F.lit(r"(?![A-Za-z0-9+-]|\.[0-9])")))


def euclid(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return F.sqrt(squared(a, b))


def squared(a: Sequence[Column], b: Sequence[Column]) -> Column:
    out = F.lit(0.0)
    for x, y in zip(a, b, strict=True):
        out = out + (x - y) * (x - y)
    return out


def zero_overlap_chance(m: Column, k: Column) -> Column:
    """C(m - k, k) / C(m, k): that two independent sets of k out of m don't meet."""
    return F.aggregate(F.sequence(F.lit(0), k - 1), F.lit(1.0), lambda p, j: p * (m - k - j) / (m - j))


#: Latin letters with marks that Unicode takes apart into a plain letter and marks.
MARKED = {chr(i): unicodedata.normalize("NFD", chr(i))[0] for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if unicodedata.normalize("NFD", chr(i)) != chr(i) and unicodedata.normalize("NFD", chr(i))[0].isascii()}


def strip_accents(c: Column) -> Column:
    """Text with the marks of Latin letters taken off; letters without a plain form (ø, ß) stay, null stays null."""
    return F.translate(F.regexp_replace(c, r"\p{Mn}+", ""), "".join(MARKED), "".join(MARKED.values()))


def valid_utf8(c: Column) -> Column:
    """Whether bytes are well-formed UTF-8; null for null."""
    return F.is_valid_utf8(c.cast("string"))
