"""Incident files to rows: one projection per file layout, for the common table and for the detail tables.

Every function takes a frame whose columns are all strings, as ``csv.read_file``
gives it, with the file's name in ``file_name`` and a row order in ``seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kinds
from ..functions.text import clean, json_text
from ..functions.times import month_of
from ..operators import deadlocks

COMMON = ["time", "source", "host", "db_name", "environment", "type", "query_details", "extra_metadata", "occurrence_count", "seq"]
# Where a legacy deadlock row may hold its statement, in order.
QUERY_TEXTS = ["clean_query", "all_query", "query_text", "statement", "sql_text", "deadlock_graph"]


def names(df: DataFrame) -> set[str]:
    return {c.strip().lower() for c in df.columns}


def col_or(df: DataFrame, name: str, default: str = "") -> Column:
    """The column with nulls as the default, or the default where there is no such column."""
    return F.coalesce(F.col(f"`{name}`"), F.lit(default)) if name in df.columns else F.lit(default)


def first_of(df: DataFrame, *columns: str) -> Column:
    """The first of these that isn't null, cleaned; empty if none is."""
    there = [F.col(f"`{c}`") for c in columns if c in df.columns]
    return clean(F.coalesce(*there, F.lit("")))


def environment(df: DataFrame) -> Column:
    return kinds.environment_of(F.col("file_name"))


def is_per_session(df: DataFrame) -> bool:
    return {"query_text", "session_id"} <= names(df)


def is_raw_graph(df: DataFrame) -> bool:
    return "_raw" in names(df) and not names(df) & {"clean_query", "all_query"}


def _common(df: DataFrame, **columns: Column) -> DataFrame:
    columns = {"environment": environment(df), "extra_metadata": F.lit(None).cast("string"), "occurrence_count": F.lit(None).cast("long"), "seq": F.col("seq")} | columns
    return df.select(*[columns[c].alias(c) for c in COMMON])


def slow_sql(df: DataFrame) -> DataFrame:
    last = col_or(df, "last_execution_time")
    return _common(df, time=F.when(F.length(last) > 0, last).otherwise(col_or(df, "creation_time")), source=F.lit("sql"), host=col_or(df, "host"), db_name=col_or(df, "db_name"), type=F.lit("slow_query"), query_details=clean(col_or(df, "query_final")))


def blocker(df: DataFrame) -> DataFrame:
    if is_per_session(df):
        text, db, extra = "query_text", "database_name", ["session_id", "wait_type", "command", "head_blocker", "blocked_sessions_count"]
    else:
        text, extra = "all_query", ["victims", "resources", "count", "lock_modes"]
        db = "database_name" if "database_name" in names(df) else "currentdbname"
    meta = json_text({c: col_or(df, c) for c in extra})
    return _common(df, time=col_or(df, "_time"), source=F.lit("sql"), host=col_or(df, "host"), db_name=col_or(df, db), type=F.lit("blocker"), query_details=clean(col_or(df, text)), extra_metadata=meta)


def _graphs(df: DataFrame, *times: str) -> DataFrame:
    raw = col_or(df, "_raw")
    return deadlocks.parse(df.withColumns({"__raw": raw, "__time": first_of(df, *times), "__host": first_of(df, "host")}), "__raw", "__time", "__host")


def deadlock(df: DataFrame) -> DataFrame:
    return _deadlock_raw(df) if is_raw_graph(df) else _deadlock_legacy(df)


def _deadlock_raw(df: DataFrame) -> DataFrame:
    """A row per process; an event that can't be parsed keeps its ids as text; blank fragments go."""
    given = (F.trim(col_or(df, "id")) != "") | (F.trim(col_or(df, "_raw")) != "")
    rows = _graphs(df.where(given), "_time").withColumn("p", F.explode_outer("processes"))
    p = F.col("p")
    other = lambda value, fallback: F.when(p.isNull(), fallback).otherwise(value)
    return _common(rows, time=F.col("__time"), source=F.lit("sql"), host=F.col("__host"), db_name=other(p["currentdbname"], F.lit("")), type=F.lit("deadlock"), query_details=other(p["sql_text"], first_of(df, "id")), extra_metadata=p["metadata"])


def _matched(text: Column) -> Column:
    """Of an event's processes the first whose statement holds the text's beginning, else the first."""
    fits = F.filter("processes", lambda p: (text != "") & p["sql_text"].contains(F.substring(text, 1, 60)))
    return F.coalesce(F.try_element_at(fits, F.lit(1)), F.try_element_at("processes", F.lit(1)))


def _deadlock_legacy(df: DataFrame) -> DataFrame:
    rows = _graphs(df, "earliest", "_time").withColumn("__text", first_of(df, *QUERY_TEXTS))
    rows = rows.withColumn("m", _matched(F.col("__text")))
    m = F.col("m")
    text = F.when(m["sql_text"].rlike(deadlocks.STATEMENT), m["sql_text"]).otherwise(F.col("__text"))
    host = first_of(df, "hostname")
    host_json = F.to_json(F.struct(host.alias("apphost")))
    host_part = F.concat(F.lit(', "apphost": '), F.substr(host_json, F.lit(12), F.length(host_json) - 12))
    parsed = F.concat(F.expr("substr(m.metadata, 1, length(m.metadata) - 1)"), F.lit(', "source": "legacy_csv"'), F.when(m["apphost"] == "", host_part).otherwise(""), F.lit("}"))
    plain = json_text({"source": F.lit("legacy_csv"), "deadlock_victim": first_of(df, "victim"), **{c: first_of(df, c) for c in ("lockMode", "lockTimeout", "waittime", "transactionname")}, "apphost": host})
    count = kinds.to_long(col_or(df, "count"))
    return _common(rows, time=F.col("__time"), source=F.lit("sql"), host=F.col("__host"), db_name=first_of(df, "currentdbname", "database_name", "db_name"), type=F.lit("deadlock"), query_details=text, extra_metadata=F.when(m.isNull(), plain).otherwise(parsed), occurrence_count=F.coalesce(count, F.lit(1)))


def slow_mongo(df: DataFrame) -> DataFrame:
    return _common(df, time=col_or(df, "t.$date"), source=F.lit("mongodb"), host=col_or(df, "host"), db_name=kinds.namespace_db(col_or(df, "attr.ns")), type=F.lit("slow_query_mongo"), query_details=kinds.mongo_command(col_or(df, "_raw")))


def detail_slow_sql(df: DataFrame) -> DataFrame:
    numbers = ["max_elapsed_time_s", "avg_elapsed_time_s", "total_elapsed_time_s", "total_worker_time_s", "avg_io", "avg_logical_reads", "avg_logical_writes"]
    last = col_or(df, "last_execution_time")
    text = clean(col_or(df, "query_final"))
    parts = [col_or(df, "host"), col_or(df, "db_name"), environment(df), text]
    return df.select(
        "seq", parts[0].alias("host"), parts[1].alias("db_name"), parts[2].alias("environment"), col_or(df, "creation_time").alias("creation_time"), last.alias("last_execution_time"),
        *[col_or(df, c).try_cast("double").alias(c) for c in numbers], col_or(df, "execution_count").try_cast("long").alias("execution_count"), text.alias("query_final"),
        month_of(F.when(F.length(last) > 0, last).otherwise(col_or(df, "creation_time"))).alias("month_year"), F.array(*parts).alias("hash_parts"),
    )


def detail_blocker(df: DataFrame) -> DataFrame:
    env = environment(df)
    if is_per_session(df):
        text, time = clean(col_or(df, "query_text")), col_or(df, "_time")
        db, session = col_or(df, "database_name"), col_or(df, "session_id")
        columns = {"currentdbname": db, "victims": session, "resources": col_or(df, "wait_type"), "lock_modes": col_or(df, "command"), "count": col_or(df, "blocked_sessions_count").try_cast("long"), "latest": time, "earliest": time, "all_query": text, "month_year": month_of(time), "hash_parts": F.array(env, db, text, time, session)}
    else:
        text, db, modes = clean(col_or(df, "all_query")), col_or(df, "currentdbname"), col_or(df, "lock_modes")
        first, last = col_or(df, "earliest"), col_or(df, "latest")
        columns = {"currentdbname": db, "victims": col_or(df, "victims"), "resources": col_or(df, "resources"), "lock_modes": modes, "count": col_or(df, "count").try_cast("long"), "latest": last, "earliest": first, "all_query": text, "month_year": F.coalesce(month_of(first), month_of(last)), "hash_parts": F.array(env, db, modes, text)}
    return df.select("seq", env.alias("environment"), *[c.alias(k) for k, c in columns.items()])


def detail_deadlock(df: DataFrame) -> DataFrame:
    env, raw = environment(df), F.nullif(F.substring(col_or(df, "_raw"), 1, 4000), F.lit(""))
    given = lambda c: F.nullif(c, F.lit(""))
    if is_raw_graph(df):
        rows = _graphs(df, "_time").withColumn("p", F.explode_outer("processes"))
        p = F.col("p")
        text, db, mode = F.coalesce(p["sql_text"], first_of(df, "id")), F.coalesce(p["currentdbname"], F.lit("")), F.coalesce(p["lockMode"], F.lit(""))
        parts, victim, lock = F.array(F.col("__host"), db, env, text, mode), p["is_victim"].cast("int"), p["lockMode"]
        wait, transaction, host = p["waittime"], given(p["transactionname"]), given(p["apphost"])
    else:
        rows = _graphs(df, "earliest", "_time").withColumn("__text", first_of(df, *QUERY_TEXTS))
        rows = rows.withColumn("p", _matched(F.col("__text")))
        p = F.col("p")
        text = F.when(F.col("__text") != "", F.col("__text")).otherwise(F.coalesce(p["sql_text"], F.lit("")))
        db, lock = first_of(df, "currentdbname", "database_name", "db_name"), first_of(df, "lockMode", "lock_modes", "lock_mode")
        parts = F.array(F.col("__host"), db, env, text, lock, F.col("__time"))
        victim = F.when(F.coalesce(p["is_victim"], F.lit(False)) | (first_of(df, "victim") != ""), 1).otherwise(0)
        wait = F.coalesce(given(p["waittime"]), col_or(df, "waittime"))
        transaction, host = F.coalesce(given(p["transactionname"]), first_of(df, "transactionname")), F.coalesce(given(p["apphost"]), first_of(df, "hostname"))
    return rows.select(
        "seq", F.col("__host").alias("host"), db.alias("db_name"), env.alias("environment"), F.col("__time").alias("event_time"), month_of(F.col("__time")).alias("month_year"), p["deadlock_id"].alias("deadlock_id"),
        victim.alias("is_victim"), lock.alias("lock_mode"), given(p["waitresource"]).alias("wait_resource"), kinds.to_long(wait).alias("wait_time_ms"), transaction.alias("transaction_name"), host.alias("app_host"),
        text.alias("sql_text"), raw.alias("raw_xml"), parts.alias("hash_parts"),
    )


def detail_slow_mongo(df: DataFrame) -> DataFrame:
    ns, kind = col_or(df, "attr.ns"), col_or(df, "attr.type")
    db, env, host, time = kinds.namespace_db(ns), environment(df), col_or(df, "host"), col_or(df, "t.$date")
    key = kinds.mongo_query_key(col_or(df, "attr.queryShapeHash"), ns, col_or(df, "c"), kind)
    return df.select(
        "seq", host.alias("host"), db.alias("db_name"), kinds.namespace_collection(ns).alias("collection"), env.alias("environment"), time.alias("event_time"), col_or(df, "attr.durationMillis").try_cast("long").alias("duration_ms"),
        col_or(df, "attr.planSummary").alias("plan_summary"), kind.alias("op_type"), col_or(df, "attr.remote").alias("remote_client"), kinds.mongo_command(col_or(df, "_raw")).alias("command_json"), month_of(time).alias("month_year"),
        F.array(host, db, env, key).alias("hash_parts"),
    )


#: Per file category: the common projection, the detail projection, and the detail table.
BY_CATEGORY = {
    "slow_query_sql": (slow_sql, detail_slow_sql, "raw_query_slow_sql"),
    "blocker": (blocker, detail_blocker, "raw_query_blocker"),
    "deadlock": (deadlock, detail_deadlock, "raw_query_deadlock"),
    "slow_query_mongo": (slow_mongo, detail_slow_mongo, "raw_query_slow_mongo"),
}
