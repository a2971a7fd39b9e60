"""Lists, counts, distinct values and joined listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import filters

SORTS = ("id", "last_seen", "occurrence_count")
EXPORT_COLUMNS = [
    "id", "query_hash", "time", "source", "host", "db_name", "environment", "type", "month_year", "occurrence_count",
    "first_seen", "last_seen", "query_details", "curated_id", "label_id", "label_name", "label_severity", "notes",
]


def ordering(sort_by: str = "id", descending: bool = True) -> list[Column]:
    """Order of a list by a permitted column, ties by id; nulls first when ascending."""
    if sort_by not in SORTS:
        raise ValueError(f"sort by one of {SORTS}")
    way = F.desc if descending else F.asc
    return [way(sort_by)] if sort_by == "id" else [way(sort_by), way("id")]


def page(df: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 200:
        raise ValueError("limit is 1 to 200")
    return df.orderBy(*order).offset(offset).limit(limit)


def after(df: DataFrame, sort_by: str = "id", descending: bool = True, last_id: int | None = None, last_value=None, limit: int = 50) -> DataFrame:
    """The page that follows a row, known by its id and the value it was sorted by; the first page without an id.

    The row's place is a range predicate that reaches the scan, so a page costs the same wherever it is: an offset reads
    and orders all that it leaves out. Rows with a null value come where ``ordering`` puts them.
    """
    if not 1 <= limit <= 200:
        raise ValueError("limit is 1 to 200")
    order, rows = ordering(sort_by, descending), df
    if last_id is not None:
        value, beyond = F.col(sort_by), (lambda c, v: c < v) if descending else (lambda c, v: c > v)
        tied = beyond(F.col("id"), last_id)
        if sort_by == "id":
            rows = df.where(tied)
        elif last_value is None:
            rows = df.where(value.isNull() & tied) if descending else df.where(value.isNotNull() | tied)
        else:
            place = (value <= last_value) if descending else (value >= last_value)  # what the scan can use
            later = place & (beyond(value, last_value) | tied)
            rows = df.where(later | value.isNull()) if descending else df.where(later)
    return rows.orderBy(*order).limit(limit)


def list_queries(raw: DataFrame, curated: DataFrame, *, sort_by: str = "id", descending: bool = True, limit: int = 50, offset: int = 0, **where) -> DataFrame:
    """A page of rows with the id of their curated record, if any."""
    rows = page(filters.listing(raw, curated, **where), ordering(sort_by, descending), limit, offset)
    marks = curated.select(F.col("raw_query_id").alias("__raw"), F.col("id").alias("curated_id"))
    return rows.join(marks, rows["id"] == F.col("__raw"), "left").drop("__raw").orderBy(*ordering(sort_by, descending))


def get_query(raw: DataFrame, curated: DataFrame, query_id: int) -> DataFrame:
    """The row with this id, if there is one, with the id of its curated record; the id is looked up in both tables."""
    marks = curated.where(F.col("raw_query_id") == query_id).agg(F.min("id").alias("curated_id"))  # one row
    return raw.where(F.col("id") == query_id).crossJoin(F.broadcast(marks))


def count_queries(raw: DataFrame, curated: DataFrame, **where) -> DataFrame:
    return filters.listing(raw, curated, **where).agg(F.count("id").alias("count"))


def distinct_values(raw: DataFrame, column: str) -> DataFrame:
    """Sorted values of host or db_name, without nulls."""
    if column not in ("host", "db_name"):
        raise ValueError("host or db_name")
    return raw.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def curated_rows(curated: DataFrame, raw: DataFrame, labels: DataFrame) -> DataFrame:
    """Curated records with their row and, where they have one, their label."""
    mine = curated.select(F.col("id").alias("curated_id"), "raw_query_id", "label_id", "notes")
    named = labels.select(F.col("id").alias("__label"), F.col("name").alias("label_name"), F.col("severity").alias("label_severity"))
    return mine.join(raw, mine["raw_query_id"] == raw["id"]).join(named, F.col("label_id") == F.col("__label"), "left").drop("__label")


def list_curated(curated: DataFrame, raw: DataFrame, labels: DataFrame, *, sort_by: str = "id", descending: bool = True, limit: int = 50, offset: int = 0, **where) -> DataFrame:
    return page(filters.curated_listing(curated_rows(curated, raw, labels), **where), ordering(sort_by, descending), limit, offset)


def count_curated(curated: DataFrame, raw: DataFrame, labels: DataFrame, **where) -> DataFrame:
    return filters.curated_listing(curated_rows(curated, raw, labels), **where).agg(F.count("curated_id").alias("count"))


def export_rows(raw: DataFrame, curated: DataFrame, labels: DataFrame, **where) -> DataFrame:
    """The export's columns, by id."""
    rows = filters.exported(raw, curated, **where)
    marks = curated.select(F.col("raw_query_id").alias("__raw"), F.col("id").alias("curated_id"), "label_id", "notes")
    named = labels.select(F.col("id").alias("__label"), F.col("name").alias("label_name"), F.col("severity").alias("label_severity"))
    both = rows.join(marks, rows["id"] == F.col("__raw"), "left").join(named, F.col("label_id") == F.col("__label"), "left")
    return both.select(*[rows[c] if c in raw.columns and c not in ("notes", "label_id") else F.col(c) for c in EXPORT_COLUMNS]).orderBy("id")
