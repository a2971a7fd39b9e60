"""Column functions for time written in many ways."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The layouts that the analytics accept, then those that only month derivation does.
EVENT_LAYOUTS = [
    "yyyy-M-d'T'H:m:s.SSSSSS",
    "yyyy-M-d'T'H:m:s",
    "M/d/yyyy h:m:s a",
    "M/d/yyyy H:m:s",
    "yyyy-M-d H:m:s.SSSSSS",
    "yyyy-M-d H:m:s",
    "yyyy/M/d H:m:s",
]
MONTH_LAYOUTS = [
    *EVENT_LAYOUTS,
    "yyyy/M/d H:m:s.SSSSSS",
    "yyyy-M-d",
    "yyyy/M/d",
    "M/d/yyyy",
    "MMM d yyyy h:mma",
    "MMM d yyyy h:mm:ssa",
    "MMM d yyyy",
]
# How a date may look within a longer text.
DATE_IN_TEXT = [
    (r"(\d{4}-\d{2}-\d{2})", "yyyy-MM-dd"),
    (r"(\d{4}/\d{2}/\d{2})", "yyyy/MM/dd"),
    (r"(\d{1,2}/\d{1,2}/\d{4})", "M/d/yyyy"),
]


def without_offset(c: Column) -> Column:
    """Without a trailing zone offset; the clock time stays as written. A trailing Z isn't an offset here."""
    return F.regexp_replace(c, r"[+-]\d{2}:?\d{2}$", "")


def _shape(layout: str) -> str:
    """A pattern that every text of a layout matches; a text of another shape needn't be parsed to know that it fails."""
    symbols = {"MMM": r"\S+", "a": r"\S+", "SSSSSS": r"\d+"}
    parts = [m.group() for m in re.finditer(r"'[^']*'|([A-Za-z])\1*|.", layout)]
    return "^" + "".join(p.strip("'") if p[0] == "'" else symbols.get(p, r"[+-]?\d+") if p[0].isalpha() else re.escape(p) for p in parts) + "$"


def _parsed(text: Column, layouts: list[str]) -> Column:
    # fractions of any length up to six digits read as six
    padded = F.regexp_replace(text, r"^(.*:\d{1,2}\.\d{1,6})$", "$1000000")
    six = F.regexp_replace(padded, r"(\.\d{6})0*$", "$1")
    return F.coalesce(*[F.when(text.rlike(_shape(f)), F.try_to_timestamp(six if "SSSSSS" in f else text, F.lit(f))) for f in layouts])


def event_time(c: Column) -> Column:
    """Time of an event, by the first layout that fits; else null."""
    return _parsed(without_offset(F.trim(c)), EVENT_LAYOUTS)


def month_of(c: Column) -> Column:
    """``yyyy-MM`` of a written time, by the first layout that fits; else null."""
    text = F.regexp_replace(without_offset(F.trim(c)), r"\s+", " ")
    return F.date_format(_parsed(text, MONTH_LAYOUTS), "yyyy-MM")


def month_in(parts: Column) -> Column:
    """Month of the first date found in an array of texts, text by text; else null."""
    found = F.transform(
        parts,
        lambda p: F.coalesce(
            *[F.date_format(F.try_to_timestamp(F.nullif(F.regexp_extract(F.coalesce(p, F.lit("")), pattern, 1), F.lit("")), F.lit(layout)), "yyyy-MM") for pattern, layout in DATE_IN_TEXT]
        ),
    )
    return F.try_element_at(F.filter(found, lambda m: m.isNotNull()), F.lit(1))


def weekday(c: Column) -> Column:
    """0 for Monday to 6 for Sunday."""
    return F.weekday(c).cast("int")


def month_weeks(month: Column) -> Column:
    """Calendar weeks of a ``yyyy-MM`` month, Monday to Sunday, cut at its ends: array of (week_start, week_end)."""
    first = F.to_date(F.concat(month, F.lit("-01")))
    last = F.last_day(first)
    monday = F.trunc(first, "week")
    steps = F.sequence(F.lit(0), F.datediff(last, monday).cast("int"), F.lit(7))
    return F.transform(steps, lambda d: F.struct(F.greatest(F.date_add(monday, d), first).alias("week_start"), F.least(F.date_add(monday, d + 6), last).alias("week_end")))
