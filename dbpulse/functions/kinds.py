"""Column functions that classify files and values, cast leniently, and make deduplication keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# The domains of the string enumerations.
SOURCES = ["sql", "mongodb"]
ENVIRONMENTS = ["prod", "sat", "unknown"]
TYPES = ["slow_query", "slow_query_mongo", "blocker", "deadlock", "unknown"]


def environment_of(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.contains("prod"), "prod").when(low.contains("sat"), "sat").otherwise("unknown")


def file_category(name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(low.contains("maxelapsed"), "slow_query_sql")
        .when(low.contains("blocker"), "blocker")
        .when(low.contains("deadlock"), "deadlock")
        .when(low.contains("mongodb") & low.contains("slow"), "slow_query_mongo")
        .otherwise("unknown")
    )


def table_kind(name: Column) -> Column:
    """The detail table of a file."""
    low, category = F.lower(name), file_category(name)
    return (
        F.when(category == "slow_query_sql", "slow_sql")
        .when(category == "slow_query_mongo", "slow_mongo")
        .when(category != "unknown", category)
        .when(low.contains("datafile") & low.contains("mongo"), "datafile_mongo")
        .when(low.contains("datafile"), "datafile_sql")
        .otherwise("unknown")
    )


def clamp(c: Column, domain: list[str], default: str) -> Column:
    return F.when(F.lower(c).isin(domain), F.lower(c)).otherwise(default)


def to_double(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), ",", "").try_cast("double")


def to_long(c: Column) -> Column:
    """A whole number from text with thousands separators or a fraction; the fraction goes."""
    return to_double(c).try_cast("long")


def namespace_db(ns: Column) -> Column:
    return F.coalesce(F.split(ns, "[.]", 2)[0], F.lit(""))


def namespace_collection(ns: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(ns, "[.]", 2), F.lit(2)), F.lit(""))


def mongo_query_key(shape: Column, ns: Column, category: Column, op: Column) -> Column:
    return F.when(F.length(shape) > 0, shape).otherwise(F.concat(ns, F.lit(":"), F.when(F.length(category) > 0, category).otherwise(op)))


def mongo_command(raw: Column) -> Column:
    """Compact JSON of a log line's command; its type without one; an error object where it doesn't parse; else empty."""
    command, kind = F.get_json_object(raw, "$.attr.command"), F.get_json_object(raw, "$.attr.type")
    bad = F.to_json(F.struct(F.lit("parse_failed").alias("error"), F.substring(raw, 1, 100).alias("raw_prefix")))
    return (
        F.when(F.coalesce(raw, F.lit("")) == "", "")
        .when(F.try_parse_json(raw).isNull(), bad)
        .otherwise(F.coalesce(command, F.to_json(F.struct(F.coalesce(kind, F.lit("")).alias("type")))))
    )


def joined_hash(*parts: Column) -> Column:
    """md5 of the stripped parts with bars between; null counts as empty."""
    return F.md5(F.concat_ws("|", *[F.coalesce(strip(p), F.lit("")) for p in parts]).cast("binary"))


def common_hash(source: Column, host: Column, db: Column, environment: Column, kind: Column, time: Column, text: Column, meta: Column) -> Column:
    """Deduplication key of a common row; a blank metadata text isn't part of it."""
    plain = lambda c: F.coalesce(F.trim(c), F.lit(""))
    parts = [plain(source), F.lower(plain(host)), F.lower(plain(db)), plain(environment), plain(kind), plain(time), plain(text)]
    return F.md5(F.concat_ws("|", *parts, F.nullif(F.trim(meta), F.lit(""))).cast("binary"))
