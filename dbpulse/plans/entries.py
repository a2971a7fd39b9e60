"""Registered queries, second part: intake, links, validation, changes of the small tables, files written and read."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kinds
from ..functions.text import json_text
from ..operators import analytics, browse, curation, deadlocks, linking, merge, validation
from ..sources import csv, layouts
from . import ingest
from .frames import cte, frame, load
from .registry import query

SUMS = "count(*) AS row_count, CAST(sum(occurrence_count) AS BIGINT) AS total_occurrences"


def _scratch(spark, what: str) -> str:
    """A fresh folder below the one that executors share; a temporary one only where all run on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="dbpulse-")
        atexit.register(shutil.rmtree, own, True)
        root = "file://" + own
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


# --- filters and lists at every size ----------------------------------------------------------------------------


@query(cte("raw_query") + f"SELECT environment, type, source, {SUMS} FROM raw_query WHERE environment = 'prod' AND db_name = 'db3' AND source = 'sql' GROUP BY ALL")
def summary_of_database(spark, d):
    return analytics.summary(frame(spark, d, "raw_query"), environment="prod", db_name="db3", source="sql")


@query("WITH u AS (SELECT o_orderkey AS id, 'file' || CAST(o_custkey AS VARCHAR) || '.csv' AS filename, o_custkey % 100 AS n FROM orders) SELECT filename, count(*) AS uploads, CAST(sum(n) AS BIGINT) AS rows, max(id) AS keep_id FROM u GROUP BY filename HAVING count(*) > 1")
def reuploaded_order_files(spark, d):
    log = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("file"), F.col("o_custkey").cast("string"), F.lit(".csv")).alias("filename"), (F.col("o_custkey") % 100).alias("csv_row_count"))
    return merge.reuploaded(log)


@query(cte("raw_query", "curated_query") + "SELECT r.id, r.host, r.type, r.query_details, c.id AS curated_id FROM raw_query r LEFT JOIN curated_query c ON c.raw_query_id = r.id WHERE r.id = 7")
def single_query(spark, d):
    return browse.get_query(frame(spark, d, "raw_query"), frame(spark, d, "curated_query"), 7).select("id", "host", "type", "query_details", "curated_id")


@query(
    cte("raw_query", "curated_query", "pattern_label")
    + """SELECT r.id, c.id AS curated_id, c.label_id, l.name AS label_name FROM curated_query c JOIN raw_query r ON r.id = c.raw_query_id LEFT JOIN pattern_label l ON l.id = c.label_id
WHERE r.query_details ILIKE '%FROM t4%' ORDER BY r.id DESC LIMIT 200"""
)
def curated_search(spark, d):
    out = browse.list_curated(frame(spark, d, "curated_query"), frame(spark, d, "raw_query"), frame(spark, d, "pattern_label"), search="from T4", limit=200)
    return out.select("id", "curated_id", "label_id", "label_name")


# --- two batches that together are the whole table --------------------------------------------------------------


def _batches(spark, d):
    """A table without a third of the rows, and a batch of that third and half of the others."""
    stamp = lambda v: F.to_timestamp(F.lit(v))
    rows = frame(spark, d, "raw_query").select("id", "query_hash", "type", F.col("occurrence_count").cast("long").alias("occurrence_count"))
    old = rows.where("id % 3 <> 0").withColumns({"last_seen": stamp("2026-01-01 00:00:00"), "updated_at": stamp("2026-01-01 00:00:00")})
    new = rows.where("id % 3 = 0 or id % 2 = 0").withColumns({"type": F.lit("blocker"), "last_seen": stamp("2026-02-01 00:00:00"), "updated_at": stamp("2026-02-01 00:00:00"), "seq": F.col("id")}).drop("id")
    return old, new


@query(
    cte("raw_query")
    + """, o AS (SELECT * FROM raw_query WHERE id % 3 <> 0), n AS (SELECT * FROM raw_query WHERE id % 3 = 0 OR id % 2 = 0)
SELECT CASE WHEN o.id IS NOT NULL THEN o.id ELSE (SELECT max(id) FROM o) + row_number() OVER (PARTITION BY o.id IS NULL ORDER BY n.id) END AS id, coalesce(o.query_hash, n.query_hash) AS query_hash, coalesce(o.type, 'blocker') AS type,
CAST(coalesce(o.occurrence_count, 0) + coalesce(n.occurrence_count, 0) AS BIGINT) AS occurrence_count, CASE WHEN n.id IS NULL THEN '2026-01-01' ELSE '2026-02-01' END AS last_seen FROM o FULL OUTER JOIN n ON o.query_hash = n.query_hash"""
)
def merge_upsert_whole(spark, d):
    out = merge.upsert(*_batches(spark, d))
    return out.select("id", "query_hash", "type", "occurrence_count", F.date_format("last_seen", "yyyy-MM-dd").alias("last_seen"))


@query(cte("raw_query") + "SELECT count(*) FILTER (WHERE id % 3 = 0) AS inserted, count(*) FILTER (WHERE id % 3 <> 0) AS updated FROM raw_query WHERE id % 3 = 0 OR id % 2 = 0")
def merge_accounting_whole(spark, d):
    return merge.accounting(*_batches(spark, d))


@query(
    """WITH n AS (SELECT md5(o_orderpriority || CAST(o_custkey AS VARCHAR)) AS h, CAST(o_orderkey % 4 AS INT) AS file FROM orders), old AS (SELECT DISTINCT md5(o_orderpriority || CAST(o_custkey AS VARCHAR)) AS h FROM orders WHERE o_orderstatus = 'F'),
p AS (SELECT DISTINCT h, file FROM n), f AS (SELECT h, min(file) AS file FROM n GROUP BY h)
SELECT p.file, count(*) FILTER (WHERE f.file = p.file AND old.h IS NULL) AS inserted, count(*) FILTER (WHERE f.file <> p.file OR old.h IS NOT NULL) AS updated FROM p JOIN f ON p.h = f.h LEFT JOIN old ON old.h = p.h GROUP BY p.file"""
)
def accounting_of_files(spark, d):
    rows = load(spark, d, "orders").select(F.md5(F.concat("o_orderpriority", F.col("o_custkey").cast("string")).cast("binary")).alias("query_hash"), (F.col("o_orderkey") % 4).cast("int").alias("file"), "o_orderstatus")
    return merge.accounting_by(rows.where("o_orderstatus = 'F'").select("query_hash").distinct(), rows.drop("o_orderstatus"), "file")


# --- links --------------------------------------------------------------------------------------------------------


def _link_sql(kind: str, source: str, keys: list[str]) -> str:
    same = " AND ".join(f"d.{k} IS NOT DISTINCT FROM r.{k}" for k in [*keys, "query_details"])
    grouped = ", ".join([*keys, "query_details"])
    return cte("raw_query") + f"SELECT d.id, r.first AS raw_query_id FROM raw_query d LEFT JOIN (SELECT {grouped}, min(id) AS first FROM raw_query WHERE type = '{kind}' AND source = '{source}' GROUP BY {grouped}) r ON {same}"


def _linked(spark, d, kind: str, text: str) -> DataFrame:
    raw = frame(spark, d, "raw_query")
    details = raw.select("id", "environment", "month_year", "host", "db_name", F.col("query_details").alias(text), F.lit(None).cast("long").alias("raw_query_id"))
    return linking.link(details, raw, kind).select("id", "raw_query_id")


@query(_link_sql("slow_query", "sql", ["environment", "month_year", "host", "db_name"]))
def link_slow_query(spark, d):
    return _linked(spark, d, "slow_query", "query_final")


@query(_link_sql("blocker", "sql", ["environment", "month_year"]))
def link_blocker(spark, d):
    return _linked(spark, d, "blocker", "all_query")


@query(_link_sql("deadlock", "sql", ["environment", "month_year", "host", "db_name"]))
def link_deadlock(spark, d):
    return _linked(spark, d, "deadlock", "sql_text")


@query(_link_sql("slow_query_mongo", "mongodb", ["environment", "host", "db_name"]))
def link_slow_mongo(spark, d):
    return _linked(spark, d, "slow_query_mongo", "command_json")


_ENV = "CASE user_id % 3 WHEN 0 THEN 'prod' WHEN 1 THEN 'sat' ELSE 'unknown' END"
_HOST = "CASE WHEN user_id % 5 = 0 THEN '' WHEN user_id % 7 = 0 THEN NULL ELSE 'm' || CAST(user_id % 4 AS {text}) END"
_DB = "CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'db' || CAST(user_id % 2 AS {text}) END"


@query(
    f"""WITH e AS (SELECT event_id AS id, event_type, {_ENV} AS environment, {_HOST.format(text="VARCHAR")} AS host, {_DB.format(text="VARCHAR")} AS db, event_id % 9 AS n FROM events),
k AS (SELECT DISTINCT event_type, environment, coalesce(host, '') AS host, coalesce(db, '') AS db FROM e),
b AS (SELECT k.event_type, k.environment, k.host, k.db, first(e.id ORDER BY e.n DESC, e.id) AS found FROM k JOIN e ON e.event_type = k.event_type AND e.environment = k.environment AND (k.host = '' OR e.host = k.host) AND (k.db = '' OR e.db = k.db) GROUP BY ALL)
SELECT e.id, 4 AS step, b.found AS detail_id FROM e JOIN b ON b.event_type = e.event_type AND b.environment = e.environment AND b.host = coalesce(e.host, '') AND b.db = coalesce(e.db, '')"""
)
def detail_cascade_by_collection(spark, d):
    e = load(spark, d, "events").selectExpr("event_id as id", "event_type", f"{_ENV} as environment", f"{_HOST.format(text='STRING')} as host", f"{_DB.format(text='STRING')} as db_name", "event_id % 9 as occurrence_count")
    raw = e.select("id", "host", "db_name", "environment", F.lit("slow_query_mongo").alias("type"), F.to_json(F.struct(F.col("event_type").alias("find"))).alias("query_details"))
    details = e.select("id", F.lit(None).cast("long").alias("raw_query_id"), F.lit("another command").alias("command_json"), F.lit("another key").alias("query_hash"), F.col("event_type").alias("collection"), "host", "db_name", "environment", "occurrence_count")
    return linking.detail_cascade(raw, details, "slow_query_mongo").select("id", "step", F.col("data.id").alias("detail_id"))


# --- deadlock graphs that differ by row ---------------------------------------------------------------------------

#: A graph per customer, in SQL that both engines read: lines end in {nl}, and each has the log's prefix {at}.
_PRE = "'2025-11-03 08:41:19.52 spid27s     "
_C, _N = "CAST(c_custkey AS {text})", "CAST(c_nationkey AS {text})"
_GRAPH = " || {nl} || ".join(
    [
        _PRE + "deadlock-list'",
        _PRE + " deadlock victim=proc' || " + _C + " || 'B'",
        _PRE + " deadlock victim=proc' || " + _C + " || 'A'",
        _PRE + "  process-list'",
        _PRE + "   process id=proc' || " + _C + " || 'A taskpriority=0 logused=' || " + _N + " || ' waitresource=KEY: 5:' || " + _C + " || ' (ab) waittime=' || " + _N + " || '0 ownerId=7 transactionname='"
        + " || CASE WHEN c_custkey % 5 = 0 THEN 'UpdateQPStats' ELSE 'user_transaction' END || ' lasttranstarted=2025-11-03T08:41:12 lockMode=U kpid=' || " + _C + " || ' status=suspended spid=' || " + _N
        + " || ' trancount=2 clientapp=Order App hostname=APP' || " + _N + " || ' loginname=svc isolationlevel=read committed (2) currentdbname=' || CASE WHEN c_custkey % 7 = 0 THEN 'tempdb' ELSE 'shop' END || ' lockTimeout=4294967295'",
        _PRE + "    executionStack'",
        _PRE + "     frame procname=unknown line=1'",
        "'unknown'",
        _PRE + "    inputbuf'",
        "CASE WHEN c_custkey % 5 = 0 THEN 'unknown' ELSE 'UPDATE t' || " + _N + " END",
        "CASE WHEN c_custkey % 5 = 0 THEN 'unknown' ELSE '   UPDATE t' || " + _N + " END",
        "CASE WHEN c_custkey % 5 = 0 THEN 'unknown' ELSE 'SET  a = 1' END",
        # the same process once more, interleaved: the first block counts
        _PRE + "   process id=proc' || " + _C + " || 'A lockMode=X currentdbname=shop'",
        _PRE + "    inputbuf'",
        "'DELETE FROM other'",
        _PRE + "   process id=proc' || " + _C + " || 'B waittime=5 lockMode=S hostname=APPB currentdbname=shop'",
        _PRE + "    executionStack'",
        _PRE + "     frame procname=shop.dbo.p' || " + _N + " || ' line=3'",
        "'SELECT b' || " + _N + " || ' FROM c'",
        _PRE + "    inputbuf'",
        "'Proc [Database Id = 5 Object Id = 9]'",
        _PRE + "   process id=proc' || " + _C + " || 'C lockMode=S currentdbname=shop transactionname=none'",
        _PRE + "    inputbuf'",
        _PRE + "   resource-list'",
    ]
)
_ID = "substr(md5('2025-11-03|' || c_name || '|proc' || c || 'A|proc' || c || 'B'), 1, 16)"
_META_A = (
    """'{"deadlock_id": "' || deadlock_id || '", "deadlock_victim": "proc' || c || 'A proc' || c || 'B", "pid": "proc' || c || 'A", "is_victim": true, "spid": "' || n || '", "kpid": "' || c || '", "logused": "' || n || '", "waitresource": "KEY: 5:' || c || ' (ab)", """
    """"waittime": "' || n || '0", "lockMode": "U", "trancount": "2", "transactionname": "' || tx || '", "lasttranstarted": "2025-11-03T08:41:12", "currentdbname": "shop", "isolationlevel": "read committed (2)", "loginname": "svc", "clientapp": "Order App", """
    """"apphost": "APP' || n || '", "lockTimeout": "4294967295", "status": "suspended"' || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE ', "inputbuf_sql": "' || sql_text || '"' END || '}'"""
)
_META_B = """'{"deadlock_id": "' || deadlock_id || '", "deadlock_victim": "proc' || c || 'A proc' || c || 'B", "pid": "proc' || c || 'B", "is_victim": true, "waittime": "5", "lockMode": "S", "currentdbname": "shop", "apphost": "APPB", "proc_name": "shop.dbo.p' || n || '", "exec_sql": "SELECT b' || n || ' FROM c"}'"""


@query(
    f"""WITH g AS (SELECT c_custkey, c_name, CAST(c_custkey AS VARCHAR) AS c, CAST(c_nationkey AS VARCHAR) AS n, CASE WHEN c_custkey % 5 = 0 THEN 'UpdateQPStats' ELSE 'user_transaction' END AS tx FROM customer),
k AS (SELECT *, {_ID} AS deadlock_id FROM g),
a AS (SELECT *, CASE WHEN c_custkey % 5 = 0 THEN '{deadlocks.AUTO_STATS}' ELSE 'UPDATE t' || n || ' SET a = 1' END AS sql_text FROM k WHERE c_custkey % 7 <> 0)
SELECT c_custkey AS id, 'proc' || c || 'A' AS pid, deadlock_id, 'proc' || c || 'A proc' || c || 'B' AS deadlock_victim, sql_text, tx AS transactionname, 'KEY: 5:' || c || ' (ab)' AS waitresource, 'read committed (2)' AS isolationlevel, 'Order App' AS clientapp, {_META_A} AS metadata FROM a
UNION ALL SELECT c_custkey, 'proc' || c || 'B', deadlock_id, 'proc' || c || 'A proc' || c || 'B', 'SELECT b' || n || ' FROM c', '', '', '', '', {_META_B} FROM k"""
)
def deadlock_varied(spark, d):
    logs = load(spark, d, "customer").selectExpr("c_custkey as id", _GRAPH.format(text="STRING", nl="'\\n'") + " as _raw", "'2025-11-03' as time", "c_name as host")
    rows = deadlocks.processes(logs)
    return rows.select("id", *[f"p.{c}" for c in ("pid", "deadlock_id", "deadlock_victim", "sql_text", "transactionname", "waitresource", "isolationlevel", "clientapp", "metadata")])


@query("""SELECT c_custkey AS seq, CASE WHEN c_custkey % 2 = 0 THEN 'SELECT b' || CAST(c_nationkey AS VARCHAR) || ' FROM c' ELSE 'SELECT z' END AS sql_text, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE CAST(c_custkey % 3 = 0 AS INT) END AS is_victim, CAST(CASE WHEN c_custkey % 2 = 0 THEN 5 ELSE c_nationkey END AS BIGINT) AS wait_time_ms,
CASE WHEN c_custkey % 2 = 0 THEN 'APPB' ELSE c_name END AS app_host, 'X' AS lock_mode, '2026-01' AS month_year, concat_ws('|', 'DB1', 'shop', 'sat', CASE WHEN c_custkey % 2 = 0 THEN 'SELECT b' || CAST(c_nationkey AS VARCHAR) || ' FROM c' ELSE 'SELECT z' END, 'X', '2026-01-26T08:58:53') AS parts FROM customer""")
def detail_deadlock_legacy(spark, d):
    cells = load(spark, d, "customer").selectExpr(
        "c_custkey", "'2026-01-26T08:58:53' as _time", "'DB1' as host", "c_name as hostname", "'shop' as currentdbname", "case when c_custkey % 3 = 0 then 'v' end as victim", "'X' as lockMode", "cast(c_nationkey as string) as waittime",
        "case when c_custkey % 2 = 0 then 'SELECT b' || cast(c_nationkey as string) || ' FROM c' else 'SELECT z' end as clean_query", "case when c_custkey % 2 = 0 then " + _GRAPH.format(text="STRING", nl="'\\n'") + " end as _raw",
    )
    rows = layouts.detail_deadlock(cells.select(*[F.col(c).cast("string").alias(c) for c in cells.columns if c != "c_custkey"], F.lit("deadlocksSat.csv").alias("file_name"), F.col("c_custkey").alias("seq")))
    return rows.select("seq", "sql_text", "is_victim", "wait_time_ms", "app_host", "lock_mode", "month_year", F.array_join("hash_parts", "|").alias("parts"))


# --- intake --------------------------------------------------------------------------------------------------------


_NAME = "CASE p_partkey % 7 WHEN 0 THEN 'blockersProd' WHEN 1 THEN 'DEADLOCKSsat' WHEN 2 THEN 'maxElapsedQueriesProd' WHEN 3 THEN 'mongodbSlowQueriesSat' WHEN 4 THEN 'dataFileSizeMongoProd' WHEN 5 THEN 'DataFileSizeSat' ELSE p_name END"


@query(f"WITH n AS (SELECT p_partkey, lower({_NAME}) AS f FROM part) SELECT p_partkey, CASE WHEN contains(f, 'maxelapsed') THEN 'slow_sql' WHEN contains(f, 'blocker') THEN 'blocker' WHEN contains(f, 'deadlock') THEN 'deadlock' WHEN contains(f, 'mongodb') AND contains(f, 'slow') THEN 'slow_mongo' WHEN contains(f, 'datafile') AND contains(f, 'mongo') THEN 'datafile_mongo' WHEN contains(f, 'datafile') THEN 'datafile_sql' ELSE 'unknown' END AS kind FROM n")
def table_kind(spark, d):
    return load(spark, d, "part").select("p_partkey", kinds.table_kind(F.expr(_NAME)).alias("kind"))


@query("""WITH h AS (SELECT o_orderkey, o_orderpriority, CASE o_custkey % 4 WHEN 0 THEN 'on ' || strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 2 THEN strftime(o_orderdate, '%-m/%-d/%Y') ELSE 'none' END AS t, CASE WHEN o_custkey % 4 < 3 THEN strftime(o_orderdate, '%Y-%m') END AS month FROM orders)
SELECT md5(concat_ws('|', o_orderpriority, t)) AS query_hash, count(*) AS occurrence_count, min(o_orderkey) AS seq, month AS month_year FROM h GROUP BY o_orderpriority, t, month""")
def details_normalised(spark, d):
    k = F.col("o_custkey") % 4
    at = F.when(k == 0, F.concat(F.lit("on "), F.date_format("o_orderdate", "yyyy-MM-dd"))).when(k == 1, F.date_format("o_orderdate", "yyyy/MM/dd")).when(k == 2, F.date_format("o_orderdate", "M/d/yyyy")).otherwise("none")
    rows = load(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.lit(None).cast("string").alias("month_year"), F.array(F.concat(F.lit(" "), F.col("o_orderpriority")), at).alias("hash_parts"))
    return merge.normalised_details(rows, F.current_timestamp()).select("query_hash", "occurrence_count", "seq", "month_year")


@query(cte("raw_query", "upload_log") + "SELECT (SELECT max(id) FROM upload_log) + 3 AS id, 'maxElapsedProd.csv' AS filename, 'slow_query_sql' AS file_type, 'prod' AS environment, (SELECT substr(time, 1, 7) FROM raw_query ORDER BY id LIMIT 1) AS month_year, count(*) AS csv_row_count, CAST(5 AS BIGINT) AS inserted, CAST(6 AS BIGINT) AS updated FROM raw_query")
def upload_log_row(spark, d):
    rows = frame(spark, d, "raw_query").select("time", F.col("id").alias("seq"))
    outcome = ingest.Outcome("maxElapsedProd.csv", "slow_query_sql", "prod", rows.count(), 5, 6, 0, 0)
    return ingest.upload_row(frame(spark, d, "upload_log"), outcome, rows, 3).drop("uploaded_at")


@query(
    """WITH f AS (SELECT avg(CASE WHEN o_custkey % 5 > 1 THEN 1.0 ELSE 0.0 END) AS empty FROM orders)
SELECT file, level, code, subject, round(share, 4) AS share FROM (VALUES ('a', 'error', 'kind', '', 0.0), ('b', 'error', 'rows', '', 0.0), ('c', 'error', 'columns', 'db_name, query_final', 0.0), ('c', 'warning', 'environment', '', 0.0),
('d', 'error', 'text', '', 0.0), ('d', 'warning', 'host', '', 0.0), ('d', 'warning', 'layout', 'summarised', 0.0), ('e', 'warning', 'layout', 'raw', 0.0), ('f', 'warning', 'layout', 'legacy', 0.0)) v(file, level, code, subject, share)
UNION ALL SELECT 'g', 'warning', 'nulls', 'host', round(empty, 4) FROM f WHERE empty > 0.5"""
)
def validation_findings(spark, d):
    o = load(spark, d, "orders").select(F.when(F.col("o_custkey") % 5 <= 1, F.col("o_orderstatus")).alias("host"), F.col("o_orderpriority").alias("db_name"), F.col("o_orderpriority").alias("text"), F.lit("x").alias("file_name"), F.col("o_orderkey").alias("seq"))
    text = lambda *names: o.select("host", *[F.col("text").alias(n) for n in names], "file_name", "seq")
    files = {
        "a": (o, "unknown", "prod"),
        "b": (text("db_name", "query_final").limit(0), "slow_query_sql", "prod"),
        "c": (o.select(F.col("db_name").alias("host"), "file_name", "seq"), "slow_query_sql", "unknown"),
        "d": (o.select("text"), "deadlock", "sat"),
        "e": (text("_raw"), "deadlock", "sat"),
        "f": (text("_raw", "clean_query"), "deadlock", "sat"),
        "g": (text("database_name", "query_text"), "blocker", "prod"),
    }
    found = [(name, *f) for name, (df, kind, env) in files.items() for f in validation.validate(df, kind, env).findings]
    return spark.createDataFrame(found, "file string, level string, code string, subject string, share double").withColumn("share", F.round("share", 4))


# --- files written and read ----------------------------------------------------------------------------------------


@query("SELECT doc_id, text, lang FROM documents")
def csv_round_trip(spark, d):
    path = _scratch(spark, "export")
    csv.write_export(load(spark, d, "documents").select("doc_id", "text", "lang"), path)
    back = csv.read_declared(spark, path, ["doc_id", "text", "lang"])
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")


@query("SELECT 'slow_query' AS type, 'prod' AS environment, count(*) AS rows, count(DISTINCT o_orderpriority) AS hosts, min(strftime(o_orderdate, '%Y-%m')) AS first_month FROM orders UNION ALL SELECT 'blocker', 'sat', count(*), count(DISTINCT user_id % 9), min(strftime(ts, '%Y-%m')) FROM events")
def united_extracts(spark, d):
    """Files of two layouts, written, read back as one folder's files are, and united."""
    folder = _scratch(spark, "incoming")
    o = load(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("last_execution_time"), F.col("o_orderpriority").alias("host"), F.col("o_orderstatus").alias("db_name"), F.lit("SELECT 1,\n2").alias("query_final"))
    e = load(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("_time"), (F.col("user_id") % 9).cast("string").alias("host"), F.lit("shop").alias("database_name"), F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("query_text"))
    parts = []
    for name, kind, df in (("maxElapsedProd.csv", "slow_query_sql", o), ("blockersSat.csv", "blocker", e)):
        csv.write_export(df, f"{folder}/{name}")
        read = csv.read_declared(spark, f"{folder}/{name}", df.columns).withColumn("file_name", F.lit(name))
        parts.append(ingest.extract(read, kind)[0])
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("type", "environment").agg(F.count("*").alias("rows"), F.countDistinct("host").alias("hosts"), F.min(F.substring("time", 1, 7)).alias("first_month"))


# --- changes of the small tables -------------------------------------------------------------------------------------


def _stamped(df: DataFrame) -> DataFrame:
    now = F.current_timestamp()
    return df.withColumns({"created_at": now, "updated_at": now})


@query("SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, CASE r_regionkey WHEN 1 THEN 'renamed' ELSE r_name END AS name, CASE r_regionkey WHEN 1 THEN 'critical' ELSE 'info' END AS severity FROM region WHERE r_regionkey <> 2 UNION ALL SELECT CAST(6 AS BIGINT), 'added', 'warning'")
def labels_changed(spark, d):
    labels = _stamped(load(spark, d, "region").select((F.col("r_regionkey") + 1).cast("long").alias("id"), F.col("r_name").alias("name"), F.lit("info").alias("severity"), F.lit(None).cast("string").alias("description"), F.lit("both").alias("source")))
    labels = curation.update_label(curation.create_label(labels, "added"), 2, name="renamed", severity="critical")
    return curation.delete_label(labels, _curated(spark, d), 3).select("id", "name", "severity")


def _curated(spark, d) -> DataFrame:
    """Records of every row of customers but the first; none has label 3."""
    return _stamped(load(spark, d, "customer").where("c_custkey > 1").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("raw_query_id"), F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")).cast("long").alias("label_id"), F.col("c_name").alias("notes")))


@query("SELECT c_custkey AS id, c_custkey AS raw_query_id, CAST(CASE WHEN c_custkey = 4 THEN 9 WHEN c_nationkey <> 3 THEN c_nationkey END AS BIGINT) AS label_id, CASE WHEN c_custkey = 4 THEN 'changed' ELSE c_name END AS notes FROM customer WHERE c_custkey > 1 AND c_custkey <> 5 UNION ALL SELECT max(c_custkey) + 1, 1, 2, 'new' FROM customer")
def curated_changed(spark, d):
    raw = load(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    rows = curation.create_curated(_curated(spark, d), raw, 1, label_id=2, notes="new")
    return curation.delete_curated(curation.update_curated(rows, 4, label_id=9, notes="changed"), 5).select("id", "raw_query_id", "label_id", "notes")


@query("SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, n_name AS name, CASE WHEN n_nationkey = 7 THEN 'blocker' ELSE 'custom' END AS query_type, CASE WHEN n_nationkey = 7 THEN 'index=z' ELSE 'index=x' END AS spl FROM nation WHERE n_nationkey <> 8 UNION ALL SELECT CAST(26 AS BIGINT), 'new', 'deadlock', 'index=y'")
def searches_changed(spark, d):
    spl = _stamped(load(spark, d, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("id"), F.col("n_name").alias("name"), F.lit("custom").alias("query_type"), F.lit("both").alias("environment"), F.lit(None).cast("string").alias("description"), F.lit("index=x").alias("spl")))
    spl = curation.update_spl(curation.create_spl(spl, "new", "deadlock", "index=y"), 8, query_type="blocker", spl="index=z")
    return curation.list_spl(curation.delete_spl(spl, 9)).select("id", "name", "query_type", "spl")


@query("SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, r_name AS name, CASE WHEN r_name LIKE 'A%' THEN 'critical' ELSE 'info' END AS severity FROM region UNION ALL SELECT 5 + row_number() OVER (ORDER BY c_mktsegment), c_mktsegment, 'warning' FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def labels_seeded(spark, d):
    labels = _stamped(load(spark, d, "region").select((F.col("r_regionkey") + 1).cast("long").alias("id"), F.col("r_name").alias("name"), F.lit("info").alias("severity"), F.lit(None).cast("string").alias("description"), F.lit("both").alias("source")))
    known = load(spark, d, "region").where("r_name like 'A%'").select(F.col("r_name").alias("name"), F.lit("critical").alias("severity"))
    other = load(spark, d, "customer").select(F.col("c_mktsegment").alias("name"), F.lit("odd").alias("severity")).distinct()
    seeds = known.unionByName(other).withColumns({"description": F.lit("d"), "source": F.lit("sql")})
    return curation.seed_labels(labels, seeds).select("id", "name", "severity")


@query("""SELECT doc_id, '{"lang": "' || lang || '", "n": "' || CAST(n_chars AS VARCHAR) || '"' || CASE WHEN n_chars % 2 = 0 THEN ', "even": true' ELSE '' END || '}' AS meta FROM documents""")
def json_text_fields(spark, d):
    fields = {"lang": F.col("lang"), "blank": F.lit(""), "none": F.lit(None).cast("string"), "n": F.col("n_chars").cast("string"), "even": F.lit("x")}
    return load(spark, d, "documents").select("doc_id", json_text(fields, {"even": F.col("n_chars") % 2 == 0}).alias("meta"))
