"""Predicates of the analytics, the lists and the export. Their ideas of a match differ on purpose."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import like_text, search_text
from ..functions.times import event_time

EQUAL = ("source", "environment", "host", "db_name", "month_year", "type")


def every(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def on_system(df: DataFrame, system: str | None, systems: DataFrame | dict[str, list[str]] | None) -> DataFrame:
    """Rows of a system's hosts, whatever the case; an unknown system has none.

    ``systems`` is a table (system, host) of any size, or a small mapping from configuration.
    """
    if not system:
        return df
    if isinstance(systems, DataFrame):
        hosts = systems.where(F.upper("system") == system.upper()).select(F.upper("host").alias("__host")).distinct()
        return df.join(hosts, F.upper(df["host"]) == F.col("__host"), "left_semi")
    known = {k.upper(): v for k, v in (systems or {}).items()}
    hosts = [h.upper() for h in known.get(system.upper(), [])]
    return df.where(F.upper("host").isin(hosts)) if hosts else df.where(F.lit(False))


def analytics(df: DataFrame, *, system: str | None = None, systems=None, **equal: str | None) -> DataFrame:
    """Equality on each given column; an empty string is a value like others, only None is no filter."""
    unknown = set(equal) - set(EQUAL)
    if unknown:
        raise ValueError(f"no such filter: {sorted(unknown)}")
    return on_system(df.where(every(F.col(k) == v for k, v in equal.items() if v is not None)), system, systems)


def given(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which all these columns are neither null nor empty."""
    return df.where(every(F.col(c).isNotNull() & (F.col(c) != "") for c in columns))


def in_week(df: DataFrame, when: Column, start: str | dt.date | None, end: str | dt.date | None) -> DataFrame:
    """Rows dated between both days; no filter unless both are given."""
    if not start or not end:
        return df
    days = [F.lit(d if isinstance(d, dt.date) else dt.date.fromisoformat(d)) for d in (start, end)]
    return df.where(F.to_date(when).between(*days))


def in_cell(df: DataFrame, hour: int, weekday: int, time_col: str = "time") -> DataFrame:
    """Rows of an hour of the day and a weekday, 0 for Monday."""
    if not 0 <= hour <= 23 or not 0 <= weekday <= 6:
        raise ValueError("hour is 0 to 23, weekday 0 to 6")
    at = event_time(F.col(time_col))
    return df.where((F.hour(at) == hour) & (F.weekday(at) == weekday))


def curated_only(df: DataFrame, curated: DataFrame, is_curated: bool | None, id_col: str = "id") -> DataFrame:
    """Rows with a curated record, rows without, or all."""
    if is_curated is None:
        return df
    ids = curated.select(F.col("raw_query_id").alias("__raw")).where("__raw is not null")
    return df.join(ids, F.col(id_col) == F.col("__raw"), "left_semi" if is_curated else "left_anti")


def listing(df: DataFrame, curated: DataFrame | None = None, *, months: list[str] | None = None, is_curated: bool | None = None, search: str | None = None, system: str | None = None, systems=None, **equal: str | None) -> DataFrame:
    """The list's filters: an empty value is no filter, search text is normalised, matching ignores ASCII case."""
    out = df.where(every(F.col(k) == v for k, v in equal.items() if v))
    if months:
        out = out.where(F.col("month_year").isin(months))
    if search:
        out = out.where(like_text(F.col("query_details"), search_text(search)))
    out = on_system(out, system, systems)
    return out if curated is None else curated_only(out, curated, is_curated)


def exported(df: DataFrame, curated: DataFrame | None = None, *, months: list[str] | None = None, is_curated: bool | None = None, search: str | None = None, host: str | None = None, db_name: str | None = None, **equal: str | None) -> DataFrame:
    """The export's filters: host and database by substring, search as typed."""
    out = df.where(every(F.col(k) == v for k, v in equal.items() if v is not None))
    for column, text in (("host", host), ("db_name", db_name), ("query_details", search)):
        if text:
            out = out.where(like_text(F.col(column), text))
    if months:
        out = out.where(F.col("month_year").isin(months))
    return out if curated is None else curated_only(out, curated, is_curated)


def curated_listing(joined: DataFrame, *, label_id: int | None = None, months: list[str] | None = None, search: str | None = None, **equal: str | None) -> DataFrame:
    """The curated list's filters over curated rows joined with theirs; search as typed."""
    out = joined.where(every(F.col(k) == v for k, v in equal.items() if v))
    if label_id is not None:
        out = out.where(F.col("label_id") == label_id)
    if months:
        out = out.where(F.col("month_year").isin(months))
    return out.where(like_text(F.col("query_details"), search)) if search else out
