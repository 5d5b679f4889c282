"""Column expressions shared by batch and streaming operators. No Python per row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def missing(x: str | Column) -> Column:
    """NULL and '' both count as a missing text."""
    x = c(x).cast("string")
    return x.isNull() | (x == "")


def number(x: str | Column) -> Column:
    """float() that yields NULL where Python would raise."""
    return c(x).try_cast("double")


def day(x: str | Column) -> Column:
    """ISO day, NULL where it does not parse."""
    return F.try_to_date(c(x).cast("string"))


def days(later: str | Column, earlier: str | Column) -> Column:
    return F.datediff(c(later), c(earlier))


def terms_days(terms: str | Column) -> Column:
    """'NET30' -> 30; NULL when there are no digits."""
    return F.regexp_extract(c(terms), r"(\d+)", 1).try_cast("int")


def money(x: str | Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c(x), 2))


def has_any(text: str | Column, words: list[str]) -> Column:
    """True when the text contains one of the words, case-blind; one pass over the lowered text."""
    return F.lower(c(text)).rlike("|".join(re.escape(w) for w in words))


def first_match(text: str | Column, choices: list[tuple[str, list[str]]], default: str | None) -> Column:
    """Label of the first choice one of whose words is in the text."""
    out = None
    for label, words in choices:
        cond = has_any(text, words)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default))


def banded(score: str | Column, steps: list[tuple[float, str]], last: str) -> Column:
    """First label whose lower bound the score reaches; missing scores fall to the last one."""
    out = None
    for bound, label in steps:
        cond = c(score) >= F.lit(bound)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(last))


def risk_band_3(score: str | Column) -> Column:
    return banded(score, [(0.8, "high"), (0.5, "medium")], "low")


def risk_band_4(score: str | Column) -> Column:
    return banded(score, [(0.8, "critical"), (0.6, "high"), (0.4, "medium")], "low")


def severity_band_shipment(score: str | Column) -> Column:
    return banded(score, [(0.9, "Critical"), (0.7, "High"), (0.4, "Medium")], "Low")


def hours_between(later: Column, earlier: Column) -> Column:
    """Hours between two dates or timestamps."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(3.6e9)


def words(text: str | Column) -> Column:
    """Whitespace split without empty pieces."""
    return F.filter(F.split(c(text), r"\s+"), lambda w: w != "")


def text_id(*parts: str | Column) -> Column:
    """Deterministic id from the parts that make a row what it is."""
    return F.sha2(F.concat_ws("|", *[c(p) for p in parts]), 256)


def get(m: str | Column, key: str, default: str | None = None) -> Column:
    """dict.get on a map column. Of a map made in the same plan only the entry asked for is worked out."""
    value = c(m).getItem(key)
    return value if default is None else F.coalesce(value, F.lit(default))
