"""The driver's tables as incident tables, by SQL that both engines read.

``{when}`` and ``{month}`` stand for the engine's own formatting of a timestamp.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KIND = "CASE {n} WHEN 1 THEN 'slow_query' WHEN 2 THEN 'slow_query_mongo' WHEN 3 THEN 'blocker' WHEN 4 THEN 'deadlock' ELSE 'unknown' END"

RAW = """
SELECT o_orderkey AS id, md5(CAST(o_orderkey AS {text})) AS query_hash, {when} AS time,
  CASE WHEN o_custkey % 4 = 0 THEN 'mongodb' ELSE 'sql' END AS source,
  CASE WHEN o_custkey % 50 = 0 THEN NULL ELSE 'HOST' || CAST(o_custkey % 23 AS {text}) END AS host,
  CASE WHEN o_custkey % 35 = 0 THEN '' ELSE 'db' || CAST(o_custkey % 7 AS {text}) END AS db_name,
  CASE o_orderstatus WHEN 'P' THEN 'prod' WHEN 'F' THEN 'sat' ELSE 'unknown' END AS environment,
  """ + KIND.format(n="CAST(substr(o_orderpriority, 1, 1) AS INT)") + """ AS type,
  CASE WHEN o_orderkey % 13 = 0 THEN '(@P? nvarchar(4000),@P?'
       WHEN o_orderkey % 11 = 0 THEN '(@P? int,@P? nvarchar(20))SELECT * FROM t' || CAST(o_custkey % 9 AS {text}) || ' WHERE id = @P? AND n = 12'
       ELSE 'SELECT  a FROM t' || CAST(o_custkey % 9 AS {text}) || ' WHERE k = ''x' || CAST(o_orderkey % 5 AS {text}) || ''' AND id = ' || CAST(o_custkey % 3 AS {text}) END AS query_details,
  {month} AS month_year, 1 + o_orderkey % 7 AS occurrence_count
FROM orders"""

LIVE = """
SELECT event_id AS id, {when} AS time, CASE WHEN user_id % 4 = 0 THEN 'mongodb' ELSE 'sql' END AS source, 'HOST' || CAST(user_id % 20 AS {text}) AS host,
  CASE WHEN user_id % 11 = 0 THEN NULL ELSE 'db' || CAST(user_id % 7 AS {text}) END AS db_name,
  CASE user_id % 3 WHEN 0 THEN 'prod' WHEN 1 THEN 'sat' ELSE 'unknown' END AS environment,
  CASE event_type WHEN 'click' THEN 'slow_query' WHEN 'view' THEN 'slow_query_mongo' WHEN 'purchase' THEN 'blocker' WHEN 'error' THEN 'deadlock' ELSE NULL END AS type,
  props AS query_details, {month} AS month_year, 1 + event_id % 5 AS occurrence_count
FROM events"""

UPLOADS = """
SELECT c_custkey AS id, 'file' || CAST(c_custkey % 211 AS {text}) || '.csv' AS filename,
  CASE c_custkey % 4 WHEN 0 THEN 'blocker' WHEN 1 THEN 'deadlock' WHEN 2 THEN 'slow_query_sql' ELSE 'slow_query_mongo' END AS file_type,
  CASE c_nationkey % 3 WHEN 0 THEN 'prod' WHEN 1 THEN 'sat' ELSE 'unknown' END AS environment,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE '199' || CAST(5 + c_custkey % 3 AS {text}) || '-0' || CAST(1 + c_custkey % 9 AS {text}) END AS month_year,
  c_custkey % 100 AS csv_row_count,
  '2026-01-0' || CAST(1 + c_nationkey % 9 AS {text}) || ' 10:00:00' AS uploaded_at
FROM customer"""

CURATED = """
SELECT doc_id AS id, doc_id AS raw_query_id, CASE WHEN quality IS NULL THEN NULL ELSE 1 + quality END AS label_id, 'note ' || CAST(toxic AS {text}) AS notes FROM labels"""

LABELS = "SELECT 1 AS id, 'junk' AS name, 'critical' AS severity UNION ALL SELECT 3 AS id, 'other' AS name, 'info' AS severity"

_STAMPS = {"raw_query": "o_orderdate", "live": "ts"}
_FRAMES = {"raw_query": RAW, "live": LIVE, "upload_log": UPLOADS, "curated_query": CURATED, "pattern_label": LABELS}
_SOURCE = {"raw_query": "orders", "live": "events", "upload_log": "customer", "curated_query": "labels", "pattern_label": None}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An incident table made of a driver table."""
    stamp = _STAMPS.get(name, "")
    sql = _FRAMES[name].format(text="STRING", when=f"date_format({stamp}, 'yyyy-MM-dd HH:mm:ss')", month=f"date_format({stamp}, 'yyyy-MM')")
    source = _SOURCE[name]
    if source is None:
        return spark.sql(sql)
    return spark.sql(sql.replace(f"FROM {source}", "FROM {src}"), src=load(spark, sf_dir, source))


def cte(*names: str) -> str:
    """The same tables as common table expressions for the oracle."""
    parts = []
    for name in names:
        stamp = _STAMPS.get(name, "")
        sql = _FRAMES[name].format(text="VARCHAR", when=f"strftime({stamp}, '%Y-%m-%d %H:%M:%S')", month=f"strftime({stamp}, '%Y-%m')")
        parts.append(f"{name} AS ({sql})")
    return "WITH " + ", ".join(parts) + "\n"
