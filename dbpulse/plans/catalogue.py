"""The registered analytics queries and their oracle SQL.

Each query runs an operator of this library over a driver table that stands for
an incident table (``frames``); the SQL states the operator's meaning anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kinds, text, times
from ..operators import analytics, browse, curation, deadlocks, filters, linking, merge, validation
from ..sources import layouts
from .frames import cte, frame, load
from .registry import ORACLE_SQL, QUERIES, query  # noqa: F401

SUMS = "count(*) AS row_count, CAST(sum(occurrence_count) AS BIGINT) AS total_occurrences"
FIRST = r"regexp_replace({0}, '{1}', '{2}')"
#: The fingerprint's body in the oracle: header stripped, then the first literal, number and run of blanks.
BODY = r"regexp_replace(lower(query_details), '^\(@p[\d?](?:[^)(]|\([^)]*\))*\)\s*', '')"


def _fingerprint(body: str) -> str:
    return rf"substring(regexp_replace(regexp_replace(regexp_replace({body}, '''[^'']*''', '?'), '\b\d+\.?\d*\b', '?'), '\s+', ' '), 1, 300)"


# --- analytics -------------------------------------------------------------------------------------------------


@query(cte("raw_query") + f"SELECT environment, type, source, {SUMS} FROM raw_query GROUP BY ALL")
def summary(spark, d):
    return analytics.summary(frame(spark, d, "raw_query"))


@query(cte("raw_query") + f"SELECT environment, type, source, {SUMS} FROM raw_query WHERE environment = 'prod' AND host = 'HOST3' AND month_year = '1997-05' GROUP BY ALL")
def summary_filtered(spark, d):
    return analytics.summary(frame(spark, d, "raw_query"), environment="prod", host="HOST3", month_year="1997-05")


@query(cte("raw_query") + f"SELECT host, environment, {SUMS} FROM raw_query WHERE host IS NOT NULL GROUP BY ALL ORDER BY total_occurrences DESC, host, environment LIMIT 20")
def by_host_topn(spark, d):
    return analytics.by_host(frame(spark, d, "raw_query"))


@query(cte("raw_query") + f"SELECT db_name, source, {SUMS} FROM raw_query WHERE db_name IS NOT NULL AND db_name <> '' GROUP BY ALL ORDER BY total_occurrences DESC, db_name, source LIMIT 5")
def by_db_topn(spark, d):
    return analytics.by_db(frame(spark, d, "raw_query"), top_n=5)


@query(
    cte("raw_query")
    + """, m AS (SELECT month_year, count(*) AS row_count, CAST(sum(occurrence_count) AS BIGINT) AS total_occurrences,
    count(*) FILTER (WHERE environment = 'prod') AS prod_count, count(*) FILTER (WHERE environment = 'sat') AS sat_count FROM raw_query WHERE month_year IS NOT NULL GROUP BY month_year)
SELECT month_year, row_count, total_occurrences, row_count - lag(row_count) OVER w AS row_delta, total_occurrences - lag(total_occurrences) OVER w AS occ_delta, prod_count, sat_count
FROM m WINDOW w AS (ORDER BY month_year)"""
)
def by_month(spark, d):
    return analytics.by_month(frame(spark, d, "raw_query"))


_KINDS = [(k, v, e) for e in ("", "prod", "sat") for k, v in analytics.FILE_TYPES.items()]
_PIVOT = ", ".join(f"sum(csv_row_count) FILTER (WHERE file_type = '{v}'" + (f" AND environment = '{e}'" if e else "") + f") AS {k}{'_' + e if e else ''}" for k, v, e in _KINDS)
_ZEROED = ", ".join(f"CAST(coalesce({n}, 0) AS BIGINT) AS {n}" for n in (f"{k}{'_' + e if e else ''}" for k, _, e in _KINDS))
_MONTH_TYPE = (
    cte("raw_query", "upload_log")
    + f""", p AS (SELECT month_year, count(*) AS total_patterns FROM raw_query WHERE month_year IS NOT NULL GROUP BY month_year),
l AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY CAST(uploaded_at AS TIMESTAMP) DESC, id DESC) AS rn FROM upload_log WHERE month_year IS NOT NULL),
u AS (SELECT month_year, {_PIVOT}, sum(csv_row_count) AS total_file_rows FROM l WHERE rn = 1 GROUP BY month_year),
mt AS (SELECT coalesce(p.month_year, u.month_year) AS month_year, {_ZEROED}, CAST(total_file_rows AS BIGINT) AS total_file_rows, coalesce(total_patterns, 0) AS total_patterns
  FROM p FULL OUTER JOIN u ON p.month_year = u.month_year)
"""
)


@query(_MONTH_TYPE + "SELECT * FROM mt")
def by_month_type(spark, d):
    return analytics.by_month_type(frame(spark, d, "raw_query"), frame(spark, d, "upload_log"))


@query(_MONTH_TYPE + "SELECT month_year, " + ", ".join(f"{k} - lag({k}) OVER (ORDER BY month_year) AS {k}_delta" for k in analytics.FILE_TYPES) + " FROM mt")
def month_type_deltas(spark, d):
    return analytics.month_type_deltas(by_month_type(spark, d))


@query(
    cte("raw_query", "curated_query")
    + """SELECT count(*) AS total_rows, count(c.id) AS curated_rows, count(*) - count(c.id) AS uncurated_rows, round(count(c.id) / count(*) * 100, 4) AS coverage_pct
FROM raw_query r LEFT JOIN curated_query c ON c.raw_query_id = r.id"""
)
def curation_coverage(spark, d):
    return analytics.curation_coverage(frame(spark, d, "raw_query"), frame(spark, d, "curated_query"))


_HOUR = "datepart('hour', CAST(time AS TIMESTAMP))"
_DAY = "datepart('isodow', CAST(time AS TIMESTAMP)) - 1"
_FLAT = f"flat AS (SELECT CAST({_HOUR} AS INT) AS hour, CAST({_DAY} AS INT) AS weekday, coalesce(type, 'unknown') AS type, coalesce(host, '') AS host, coalesce(db_name, '') AS db_name, CAST(sum(occurrence_count) AS BIGINT) AS count FROM live GROUP BY ALL)"


@query(cte("live") + f", {_FLAT} SELECT * FROM flat")
def by_hour(spark, d):
    return analytics.by_hour_flat(frame(spark, d, "live"))


def _tops(column: str, name: str) -> str:
    return f"""{name} AS (SELECT hour, weekday, string_agg({column} || ':' || n, ',' ORDER BY r) AS {name} FROM (
  SELECT hour, weekday, {column}, sum(count) AS n, row_number() OVER (PARTITION BY hour, weekday ORDER BY sum(count) DESC, {column}) AS r FROM flat WHERE {column} <> '' GROUP BY hour, weekday, {column}) WHERE r <= 5 GROUP BY hour, weekday)"""


@query(
    cte("live")
    + f""", {_FLAT}, {_tops('host', 'top_hosts')}, {_tops('db_name', 'top_dbs')},
kinds AS (SELECT hour, weekday, CAST(sum(n) AS BIGINT) AS count, string_agg(type || ':' || n, ',' ORDER BY type) AS by_type FROM (SELECT hour, weekday, type, sum(count) AS n FROM flat GROUP BY ALL) GROUP BY hour, weekday)
SELECT k.hour, k.weekday, k.count, k.by_type, coalesce(h.top_hosts, '') AS top_hosts, coalesce(b.top_dbs, '') AS top_dbs
FROM kinds k LEFT JOIN top_hosts h ON k.hour = h.hour AND k.weekday = h.weekday LEFT JOIN top_dbs b ON k.hour = b.hour AND k.weekday = b.weekday"""
)
def by_hour_cells_top5(spark, d):
    cells = analytics.by_hour(frame(spark, d, "live"))
    pairs = lambda c, name: F.array_join(F.transform(c, lambda x: F.concat(x[name], F.lit(":"), x["count"].cast("string"))), ",").alias(c)
    kinds_text = F.array_join(F.transform(F.map_entries("by_type"), lambda x: F.concat(x["key"], F.lit(":"), x["value"].cast("string"))), ",")
    return cells.select("hour", "weekday", "count", kinds_text.alias("by_type"), pairs("top_hosts", "host"), pairs("top_dbs", "db_name"))


@query(
    cte("live")
    + f"""SELECT id, type, host, db_name, environment, source, time, month_year, occurrence_count, query_details, count(*) OVER () AS total
FROM live WHERE {_HOUR} = 10 AND {_DAY} = 2 ORDER BY occurrence_count DESC, id DESC LIMIT 20 OFFSET 5"""
)
def by_hour_queries(spark, d):
    return analytics.by_hour_queries(frame(spark, d, "live"), hour=10, weekday=2, limit=20, offset=5)


@query(cte("live") + f", {_FLAT.replace('FROM live', "FROM live WHERE CAST(CAST(time AS TIMESTAMP) AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'")} SELECT * FROM flat")
def week_filter(spark, d):
    return analytics.by_hour_flat(frame(spark, d, "live"), "2024-01-08", "2024-01-14")


@query(
    cte("raw_query")
    + """, m AS (SELECT DISTINCT month_year, CAST(month_year || '-01' AS DATE) AS f FROM raw_query), w AS (
  SELECT month_year, f, last_day(f) AS l, unnest(generate_series(CAST(date_trunc('week', f) AS TIMESTAMP), CAST(last_day(f) AS TIMESTAMP), INTERVAL 7 DAY)) AS s FROM m)
SELECT month_year, strftime(greatest(CAST(s AS DATE), f), '%Y-%m-%d') AS week_start, strftime(least(CAST(s AS DATE) + 6, l), '%Y-%m-%d') AS week_end FROM w"""
)
def month_weeks(spark, d):
    months = frame(spark, d, "raw_query").select("month_year").distinct()
    weeks = months.select("month_year", F.explode(times.month_weeks(F.col("month_year"))).alias("w"))
    day = lambda c: F.date_format(f"w.{c}", "yyyy-MM-dd").alias(c)
    return weeks.select("month_year", day("week_start"), day("week_end"))


_PRINTS = (
    cte("raw_query")
    + f""", s AS (SELECT id, query_details, {BODY} AS body, coalesce(type, 'unknown') AS type, coalesce(host, '') AS host, coalesce(db_name, '') AS db_name, coalesce(month_year, '') AS month_year,
  coalesce(environment, '') AS environment, coalesce(source, '') AS source, occurrence_count AS occ FROM raw_query WHERE query_details IS NOT NULL AND query_details <> ''),
b AS (SELECT db_name, host, arg_min({_fingerprint('body')}, id) AS recovered, arg_min(query_details, id) AS recovered_sample FROM s WHERE query_details LIKE '(@P?%' AND body NOT LIKE '(@p%' GROUP BY db_name, host),
f AS (SELECT s.id, CASE WHEN length(trim(body)) < 5 OR body LIKE '(@p%' THEN coalesce(recovered, '{text.NO_BODY}') ELSE {_fingerprint('body')} END AS fingerprint,
  coalesce(CASE WHEN body LIKE '(@p%' THEN recovered_sample END, query_details) AS sample, s.type, s.host, s.db_name, s.month_year, s.environment, s.source, occ
  FROM s LEFT JOIN b ON s.db_name = b.db_name AND s.host = b.host)
"""
)


@query(_PRINTS + "SELECT id, fingerprint, sample FROM f")
def fingerprint_bridge(spark, d):
    return analytics.fingerprints(frame(spark, d, "raw_query")).select("id", "fingerprint", "sample")


@query(
    _PRINTS
    + """, t AS (SELECT fingerprint, CAST(sum(occ) AS BIGINT) AS count, count(*) AS row_count FROM f GROUP BY fingerprint ORDER BY count DESC, fingerprint LIMIT 20),
k AS (SELECT fingerprint, string_agg(type || ':' || n, ',' ORDER BY type) AS by_type FROM (SELECT fingerprint, type, sum(occ) AS n FROM f GROUP BY ALL) GROUP BY fingerprint),
h AS (SELECT fingerprint, host, row_number() OVER (PARTITION BY fingerprint ORDER BY sum(occ) DESC, host) AS r FROM f WHERE host <> '' GROUP BY fingerprint, host),
g AS (SELECT fingerprint, db_name, row_number() OVER (PARTITION BY fingerprint ORDER BY sum(occ) DESC, db_name) AS r FROM f WHERE db_name <> '' GROUP BY fingerprint, db_name),
o AS (SELECT fingerprint, min(source) FILTER (WHERE source <> '') AS example_source, count(DISTINCT month_year) FILTER (WHERE month_year <> '') AS months, string_agg(DISTINCT environment, ',' ORDER BY environment) AS environments FROM f GROUP BY fingerprint),
x AS (SELECT fingerprint, sample, row_number() OVER (PARTITION BY fingerprint ORDER BY occ DESC, id) AS r FROM f)
SELECT t.fingerprint, x.sample AS sample_query, t.count, t.row_count, k.by_type, o.months, o.environments, coalesce(h.host, '') AS example_host, coalesce(g.db_name, '') AS example_db, coalesce(o.example_source, '') AS example_source
FROM t JOIN k USING (fingerprint) JOIN o USING (fingerprint) JOIN x ON x.fingerprint = t.fingerprint AND x.r = 1 LEFT JOIN h ON h.fingerprint = t.fingerprint AND h.r = 1 LEFT JOIN g ON g.fingerprint = t.fingerprint AND g.r = 1"""
)
def top_fingerprints(spark, d):
    top = analytics.top_fingerprints(frame(spark, d, "raw_query"))
    by_type = F.array_join(F.transform(F.map_entries("by_type"), lambda x: F.concat(x["key"], F.lit(":"), x["value"].cast("string"))), ",")
    return top.select("fingerprint", "sample_query", "count", "row_count", by_type.alias("by_type"), F.size("months").cast("long").alias("months"), F.array_join("environments", ",").alias("environments"), "example_host", "example_db", "example_source")


@query(f"SELECT doc_id, {_fingerprint('lower(text)')} AS fingerprint FROM documents")
def fingerprint_documents(spark, d):
    return load(spark, d, "documents").select("doc_id", text.fingerprint_body(F.col("text")).alias("fingerprint"))


@query(r"SELECT doc_id, regexp_replace(lower('(@P0 nvarchar(4000),@P1 int)' || text), '^\(@p[\d?](?:[^)(]|\([^)]*\))*\)\s*', '') AS body FROM documents")
def fingerprint_strip_header_whole(spark, d):
    headed = F.concat(F.lit("(@P0 nvarchar(4000),@P1 int)"), F.col("text"))
    return load(spark, d, "documents").select("doc_id", text.without_header(headed).alias("body"))


@query(
    cte("raw_query")
    + """SELECT host, round(quantile_cont(occurrence_count, 0.5), 1) AS p50, round(quantile_cont(occurrence_count, 0.95), 1) AS p95, round(quantile_cont(occurrence_count, 0.99), 1) AS p99,
CAST(max(occurrence_count) AS BIGINT) AS max_occ, CAST(sum(occurrence_count) AS BIGINT) AS total_occurrences, count(*) AS row_count
FROM raw_query WHERE host IS NOT NULL GROUP BY host HAVING count(*) >= 3 ORDER BY p95 DESC, total_occurrences DESC, host LIMIT 30"""
)
def host_stats(spark, d):
    return analytics.host_stats(frame(spark, d, "raw_query"))


@query(
    """SELECT CAST(l_suppkey AS VARCHAR) AS host, round(quantile_cont(l_quantity, 0.5), 1) AS p50, round(quantile_cont(l_quantity, 0.95), 1) AS p95, round(quantile_cont(l_quantity, 0.99), 1) AS p99, CAST(max(l_quantity) AS BIGINT) AS max_occ,
CAST(sum(l_quantity) AS BIGINT) AS total_occurrences, count(*) AS row_count FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 3 ORDER BY p95 DESC, total_occurrences DESC, host LIMIT 200"""
)
def host_stats_lineitem(spark, d):
    rows = load(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("host"), F.col("l_quantity").alias("occurrence_count"))
    return analytics.host_stats(rows, top_n=200)


@query(
    cte("raw_query")
    + """, b AS (SELECT host, month_year, sum(occurrence_count) AS n FROM raw_query WHERE type = 'blocker' AND host IS NOT NULL AND month_year IS NOT NULL GROUP BY ALL),
dl AS (SELECT host, month_year, sum(occurrence_count) AS n FROM raw_query WHERE type = 'deadlock' AND host IS NOT NULL AND month_year IS NOT NULL GROUP BY ALL)
SELECT coalesce(b.host, dl.host) AS host, coalesce(b.month_year, dl.month_year) AS month_year, CAST(coalesce(b.n, 0) AS BIGINT) AS blocker_count, CAST(coalesce(dl.n, 0) AS BIGINT) AS deadlock_count, CAST(coalesce(b.n, 0) + coalesce(dl.n, 0) AS BIGINT) AS combined_score
FROM b FULL OUTER JOIN dl ON b.host = dl.host AND b.month_year = dl.month_year ORDER BY combined_score DESC, host, month_year LIMIT 200"""
)
def co_occurrence(spark, d):
    return analytics.co_occurrence(frame(spark, d, "raw_query"))


@query(cte("raw_query", "upload_log") + "SELECT count(DISTINCT host) AS hosts, count(DISTINCT month_year) AS months, (SELECT CAST(sum(csv_row_count) AS BIGINT) FROM upload_log) AS file_rows FROM raw_query")
def kpis(spark, d):
    return analytics.kpis(frame(spark, d, "raw_query"), frame(spark, d, "upload_log"))


@query(cte("raw_query") + f"SELECT environment, type, source, {SUMS} FROM raw_query WHERE upper(host) IN ('HOST1', 'HOST2', 'HOST5') GROUP BY ALL")
def system_filter(spark, d):
    systems = spark.createDataFrame([("Billing", "host1"), ("Billing", "Host2"), ("Billing", "HOST5"), ("Other", "HOST7")], "system string, host string")
    return analytics.summary(frame(spark, d, "raw_query"), system="BILLING", systems=systems)


@query("SELECT c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE upper(r_name) = 'ASIA'")
def system_filter_lookup(spark, d):
    nations = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("system"), F.col("n_name").alias("host"))
    customers = load(spark, d, "customer").join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumnRenamed("n_name", "host")
    return filters.on_system(customers, "asia", nations).select("c_custkey", "c_name")


# --- lists, curation, export -----------------------------------------------------------------------------------


@query(
    cte("raw_query", "curated_query")
    + """, p AS (SELECT * FROM raw_query WHERE environment = 'sat' AND type = 'blocker' AND month_year IN ('1996-01', '1996-02', '1997-03', '1998-03', '1999-04', '2000-05', '2001-01') ORDER BY occurrence_count DESC, id DESC LIMIT 50 OFFSET 2)
SELECT p.id, p.host, p.type, p.occurrence_count, c.id AS curated_id FROM p LEFT JOIN curated_query c ON c.raw_query_id = p.id"""
)
def list_filtered_page(spark, d):
    out = browse.list_queries(frame(spark, d, "raw_query"), frame(spark, d, "curated_query"), environment="sat", type="blocker", months=["1996-01", "1996-02", "1997-03", "1998-03", "1999-04", "2000-05", "2001-01"], sort_by="occurrence_count", limit=50, offset=2)
    return out.select("id", "host", "type", "occurrence_count", "curated_id")


@query(cte("raw_query", "curated_query") + "SELECT count(id) AS count FROM raw_query WHERE type = 'blocker' AND id IN (SELECT raw_query_id FROM curated_query)")
def count_curated_blockers(spark, d):
    return browse.count_queries(frame(spark, d, "raw_query"), frame(spark, d, "curated_query"), type="blocker", is_curated=True)


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def is_curated_true(spark, d):
    marks = load(spark, d, "labels").withColumnRenamed("doc_id", "raw_query_id")
    return filters.curated_only(load(spark, d, "documents"), marks, True, "doc_id").select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def is_curated_false(spark, d):
    marks = load(spark, d, "labels").withColumnRenamed("doc_id", "raw_query_id")
    return filters.curated_only(load(spark, d, "documents"), marks, False, "doc_id").select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents WHERE text ILIKE '%The and%'")
def search_ilike(spark, d):
    docs = load(spark, d, "documents").withColumnRenamed("text", "query_details")
    return filters.listing(docs, search="  The   and ").select("doc_id", "lang")


@query(cte("raw_query") + "SELECT DISTINCT host FROM raw_query WHERE host IS NOT NULL ORDER BY host")
def distinct_values(spark, d):
    return browse.distinct_values(frame(spark, d, "raw_query"), "host")


@query(
    cte("raw_query", "curated_query", "pattern_label")
    + """SELECT r.id, r.time, r.source, r.host, r.db_name, r.environment, r.type, r.month_year, r.occurrence_count, r.query_details, c.id AS curated_id, c.label_id, l.name AS label_name, l.severity AS label_severity, c.notes
FROM raw_query r LEFT JOIN curated_query c ON c.raw_query_id = r.id LEFT JOIN pattern_label l ON l.id = c.label_id WHERE r.host ILIKE '%ost1%' AND r.query_details ILIKE '%from t3%'"""
)
def export_join(spark, d):
    raw = frame(spark, d, "raw_query").withColumns({"first_seen": F.lit(None).cast("timestamp"), "last_seen": F.lit(None).cast("timestamp")})
    out = browse.export_rows(raw, frame(spark, d, "curated_query"), frame(spark, d, "pattern_label"), host="ost1", search="from T3")
    return out.drop("query_hash", "first_seen", "last_seen")


@query(
    cte("raw_query", "curated_query", "pattern_label")
    + """SELECT r.id, c.id AS curated_id, c.label_id, l.name AS label_name, r.type, c.notes FROM curated_query c JOIN raw_query r ON r.id = c.raw_query_id LEFT JOIN pattern_label l ON l.id = c.label_id
WHERE r.source = 'sql' ORDER BY r.id DESC LIMIT 100 OFFSET 10"""
)
def curated_list(spark, d):
    out = browse.list_curated(frame(spark, d, "curated_query"), frame(spark, d, "raw_query"), frame(spark, d, "pattern_label"), source="sql", limit=100, offset=10)
    return out.select("id", "curated_id", "label_id", "label_name", "type", "notes")


@query(cte("raw_query", "curated_query") + "SELECT count(*) AS count FROM curated_query c JOIN raw_query r ON r.id = c.raw_query_id WHERE c.label_id = 1")
def curated_count(spark, d):
    return browse.count_curated(frame(spark, d, "curated_query"), frame(spark, d, "raw_query"), frame(spark, d, "pattern_label"), label_id=1)


# --- intake ----------------------------------------------------------------------------------------------------


def _doc_rows(spark, d):
    docs = load(spark, d, "documents")
    meta = text.json_text({"lang": F.col("lang")})
    return docs.select(F.lit("2024-03-01T10:00:00.000+0800").alias("time"), F.lit("SQL").alias("source"), F.col("source").alias("host"), F.col("lang").alias("db_name"), F.lit("sat").alias("environment"), F.lit("deadlock").alias("type"), F.col("text").alias("query_details"), meta.alias("extra_metadata"), (F.col("n_chars") % 3).alias("occurrence_count"), F.col("doc_id").alias("seq"))


_HASHED = r"""WITH h AS (SELECT doc_id, md5(concat_ws('|', 'sql', lower(trim(source)), lower(trim(lang)), 'sat', 'deadlock', '2024-03-01T10:00:00.000+0800', regexp_replace(text, '^\s+|\s+$', '', 'g'), '{"lang": "' || lang || '"}')) AS query_hash,
  CASE WHEN n_chars % 3 = 0 THEN 1 ELSE n_chars % 3 END AS n FROM documents)
"""


@query(_HASHED + "SELECT query_hash, CAST(sum(n) AS BIGINT) AS occurrence_count, min(doc_id) AS seq, '2024-03' AS month_year FROM h GROUP BY query_hash")
def dedup_hash(spark, d):
    return merge.normalised(_doc_rows(spark, d), F.current_timestamp()).select("query_hash", "occurrence_count", "seq", "month_year")


@query("SELECT o_orderkey, md5(concat_ws('|', trim(o_orderpriority), CAST(o_custkey AS VARCHAR), '', o_orderstatus)) AS query_hash FROM orders")
def typed_hash(spark, d):
    return load(spark, d, "orders").select("o_orderkey", kinds.joined_hash(F.col("o_orderpriority"), F.col("o_custkey").cast("string"), F.lit(None).cast("string"), F.col("o_orderstatus")).alias("query_hash"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace('  @P12' || text || ' @P7 ', '\s+', ' ', 'g'), '^ | $', '', 'g'), '@P\d+', '@P?', 'g') AS cleaned FROM documents")
def clean_text(spark, d):
    return load(spark, d, "documents").select("doc_id", text.clean(F.concat(F.lit("  @P12"), F.col("text"), F.lit(" @P7 "))).alias("cleaned"))


_LAYOUTS = [("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "%Y-%m-%dT%H:%M:%S.%f"), ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"), ("M/d/yyyy h:mm:ss a", "%-m/%-d/%Y %-I:%M:%S %p"), ("M/d/yyyy HH:mm:ss", "%-m/%-d/%Y %H:%M:%S"), ("yyyy-MM-dd HH:mm:ss.SSSSSS", "%Y-%m-%d %H:%M:%S.%f"), ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"), ("yyyy/MM/dd HH:mm:ss", "%Y/%m/%d %H:%M:%S")]


@query("WITH w AS (SELECT event_id, CASE event_id % 7 " + " ".join(f"WHEN {i} THEN strftime(ts, '{b}')" for i, (_, b) in enumerate(_LAYOUTS)) + " END || '+0800' AS written, ts FROM events) SELECT event_id, written, strftime(ts, '%Y-%m-%d %H:%M:%S') AS parsed, strftime(ts, '%Y-%m') AS month FROM w")
def parse_time_formats(spark, d):
    written = F.lit(None).cast("string")
    for i, (a, _) in enumerate(_LAYOUTS):
        written = F.when(F.col("event_id") % 7 == i, F.date_format("ts", a)).otherwise(written)
    rows = load(spark, d, "events").select("event_id", F.concat(written, F.lit("+0800")).alias("written"))
    return rows.select("event_id", "written", F.date_format(times.event_time(F.col("written")), "yyyy-MM-dd HH:mm:ss").alias("parsed"), times.month_of(F.col("written")).alias("month"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE strftime(o_orderdate, '%Y-%m') END AS month FROM orders")
def month_year_from_text(spark, d):
    k = F.col("o_orderkey") % 4
    part = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).when(k == 1, F.date_format("o_orderdate", "yyyy/MM/dd")).when(k == 2, F.date_format("o_orderdate", "M/d/yyyy")).otherwise("no date")
    return load(spark, d, "orders").select("o_orderkey", times.month_in(F.array(F.col("o_orderpriority"), F.concat(F.lit("at "), part), F.lit(""))).alias("month"))


@query("SELECT p_partkey, TRY_CAST(replace(CASE WHEN p_partkey % 5 = 0 THEN 'n/a' ELSE '1,' || CAST(p_size AS VARCHAR) || '00.75' END, ',', '') AS DOUBLE) AS d, CAST(trunc(TRY_CAST(replace(CASE WHEN p_partkey % 5 = 0 THEN 'n/a' ELSE '1,' || CAST(p_size AS VARCHAR) || '00.75' END, ',', '') AS DOUBLE)) AS BIGINT) AS n FROM part")
def lenient_cast(spark, d):
    written = F.when(F.col("p_partkey") % 5 == 0, "n/a").otherwise(F.concat(F.lit("1,"), F.col("p_size").cast("string"), F.lit("00.75")))
    return load(spark, d, "part").select("p_partkey", kinds.to_double(written).alias("d"), kinds.to_long(written).alias("n"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"find":"c","n":' || (props->>'$.k') || '}' WHEN 1 THEN '{"type":"' || event_type || '"}' WHEN 2 THEN '{"error":"parse_failed","raw_prefix":"broken"}' ELSE '' END AS command FROM events""")
def json_extract(spark, d):
    k = F.col("event_id") % 4
    n = F.get_json_object("props", "$.k")
    raw = F.when(k == 0, F.concat(F.lit('{"attr": {"command": {"find": "c", "n": '), n, F.lit("}}}"))).when(k == 1, F.concat(F.lit('{"attr": {"type": "'), F.col("event_type"), F.lit('"}}'))).when(k == 2, "broken")
    return load(spark, d, "events").select("event_id", kinds.mongo_command(raw).alias("command"))


@query(r"WITH n AS (SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS ns FROM pages) SELECT page_id, split_part(ns, '.', 1) AS db_name, CASE WHEN contains(ns, '.') THEN substr(ns, length(split_part(ns, '.', 1)) + 2) ELSE '' END AS collection FROM n")
def namespace_split(spark, d):
    ns = F.regexp_extract("url", r"://([^/?#]+)", 1)
    return load(spark, d, "pages").select("page_id", kinds.namespace_db(ns).alias("db_name"), kinds.namespace_collection(ns).alias("collection"))


_NAME = "CASE p_partkey % 6 WHEN 0 THEN 'blockersProd' WHEN 1 THEN 'DEADLOCKSsat' WHEN 2 THEN 'maxElapsedQueriesProd' WHEN 3 THEN 'mongodbSlowQueriesSat' WHEN 4 THEN 'dataFileSizeMongoProd' ELSE p_name END"


@query(
    f"""WITH n AS (SELECT p_partkey, lower({_NAME}) AS f FROM part) SELECT p_partkey, CASE WHEN contains(f, 'prod') THEN 'prod' WHEN contains(f, 'sat') THEN 'sat' ELSE 'unknown' END AS environment,
CASE WHEN contains(f, 'maxelapsed') THEN 'slow_query_sql' WHEN contains(f, 'blocker') THEN 'blocker' WHEN contains(f, 'deadlock') THEN 'deadlock' WHEN contains(f, 'mongodb') AND contains(f, 'slow') THEN 'slow_query_mongo' ELSE 'unknown' END AS category FROM n"""
)
def file_category(spark, d):
    name = F.expr(_NAME)
    return load(spark, d, "part").select("p_partkey", kinds.environment_of(name).alias("environment"), kinds.file_category(name).alias("category"))


@query("SELECT o_orderkey, CASE WHEN lower(o_orderstatus) IN ('p', 'f') THEN lower(o_orderstatus) ELSE 'unknown' END AS status FROM orders")
def enum_clamp(spark, d):
    return load(spark, d, "orders").select("o_orderkey", kinds.clamp(F.col("o_orderstatus"), ["p", "f"], "unknown").alias("status"))


@query("SELECT round(avg(CASE WHEN quality IS NULL THEN 1 ELSE 0 END), 4) AS quality, round(avg(CASE WHEN lang IS NULL THEN 1 ELSE 0 END), 4) AS lang FROM documents LEFT JOIN labels USING (doc_id)")
def null_rates(spark, d):
    return validation.null_rates(load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id", "left"), ["quality", "lang"])


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || '…[truncated]' ELSE text END AS text FROM documents ORDER BY doc_id LIMIT 50")
def sample_truncate(spark, d):
    return validation.sample(load(spark, d, "documents").select("doc_id", "text").orderBy("doc_id"))


@query("SELECT event_id, user_id, CASE WHEN user_id % 10 = 0 THEN 'new' ELSE event_type END AS event_type FROM events WHERE user_id % 10 <> 0 OR event_id % 2 = 0")
def replace_by_key(spark, d):
    old = load(spark, d, "events").select("event_id", "user_id", "event_type")
    new = old.where("user_id % 10 = 0 and event_id % 2 = 0").withColumn("event_type", F.lit("new"))
    whole = old.where("user_id % 10 = 0").select("user_id").distinct()
    marked = merge.replace_by_key(old, whole.withColumn("event_id", F.lit(None).cast("long")), "user_id").where("event_id is not null")
    return merge.replace_by_key(marked, new, "user_id")


@query(cte("upload_log") + "SELECT filename, count(*) AS uploads, CAST(sum(csv_row_count) AS BIGINT) AS rows, max(id) AS keep_id FROM upload_log GROUP BY filename HAVING count(*) > 1")
def reuploaded_files(spark, d):
    return merge.reuploaded(frame(spark, d, "upload_log"))


@query(cte("raw_query") + "SELECT id, coalesce(CASE WHEN id % 2 = 0 THEN month_year END, substr(time, 1, 7)) AS month_year FROM raw_query")
def month_backfill(spark, d):
    gaps = frame(spark, d, "raw_query").withColumn("month_year", F.when(F.col("id") % 2 == 0, F.col("month_year")))
    return merge.month_backfilled(gaps).select("id", "month_year")


@query(
    """WITH o AS (SELECT o_orderkey AS id, nullif(o_orderstatus, 'P') AS environment, nullif(o_orderpriority, '1-URGENT') AS host, o_custkey % 40 AS t FROM orders),
k AS (SELECT environment, host, t, min(id) AS first FROM o GROUP BY ALL) SELECT o.id, k.first AS raw_query_id FROM o LEFT JOIN k ON o.environment IS NOT DISTINCT FROM k.environment AND o.host IS NOT DISTINCT FROM k.host AND o.t = k.t"""
)
def fk_link_nullsafe(spark, d):
    rows = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.nullif("o_orderstatus", F.lit("P")).alias("environment"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("host"), (F.col("o_custkey") % 40).alias("t"))
    return linking.null_safe_first(rows, rows, [("environment", "environment"), ("host", "host"), ("t", "t")]).select("id", "raw_query_id")


def _documents_as_raw(spark, d):
    return load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("host"), F.col("lang").alias("db_name"), F.lit("sat").alias("environment"), F.lit("slow_query_mongo").alias("type"), F.col("text").alias("query_details"))


_DOC_HASH = r"md5(concat_ws('|', trim(source), trim(lang), 'sat', regexp_replace(text, '^\s+|\s+$', '', 'g')))"


@query(f"WITH h AS (SELECT doc_id, {_DOC_HASH} AS h FROM documents) SELECT x.doc_id AS id, y.first AS raw_query_id FROM h x JOIN (SELECT h, min(doc_id) AS first FROM h GROUP BY h) y ON x.h = y.h")
def hash_link(spark, d):
    raw = _documents_as_raw(spark, d)
    details = raw.select("id", kinds.joined_hash(*[F.col(c) for c in ("host", "db_name", "environment", "query_details")]).alias("query_hash"), F.lit(None).cast("long").alias("raw_query_id"))
    return linking.link_by_hash(details, raw).select("id", "raw_query_id")


@query(
    f"""WITH t AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN doc_id + 1 END AS fk, CASE WHEN doc_id % 3 = 1 THEN text END AS body, CASE WHEN doc_id % 3 = 2 THEN {_DOC_HASH} END AS h FROM documents),
c AS (SELECT r.doc_id AS id, 1 AS step, min(t.id) AS found FROM documents r JOIN t ON t.fk = r.doc_id GROUP BY r.doc_id
UNION ALL SELECT r.doc_id, 2, min(t.id) FROM documents r JOIN t ON t.body = r.text AND r.text <> '' GROUP BY r.doc_id
UNION ALL SELECT r.doc_id, 3, min(t.id) FROM documents r JOIN t ON t.h = {_DOC_HASH} AND r.text <> '' GROUP BY r.doc_id)
SELECT d.doc_id AS id, arg_min(c.step, c.step) AS step, arg_min(c.found, c.step) AS detail_id FROM documents d LEFT JOIN c ON c.id = d.doc_id GROUP BY d.doc_id"""
)
def typed_detail_cascade(spark, d):
    raw = _documents_as_raw(spark, d)
    k, key = F.col("id") % 3, kinds.joined_hash(*[F.col(c) for c in ("host", "db_name", "environment", "query_details")])
    details = raw.select("id", F.when(k == 0, F.col("id") + 1).alias("raw_query_id"), F.when(k == 1, F.col("query_details")).alias("command_json"), F.when(k == 2, key).alias("query_hash"), F.lit("none").alias("collection"), "host", "db_name", "environment", F.lit(1).alias("occurrence_count"))
    return linking.detail_cascade(raw, details, "slow_query_mongo").select("id", "step", F.col("data.id").alias("detail_id"))


@query("SELECT count(*) FILTER (WHERE a AND b) AS shared, count(*) FILTER (WHERE a AND NOT b) AS left_only, count(*) FILTER (WHERE b AND NOT a) AS right_only FROM (SELECT t, bool_or(s = 0) AS a, bool_or(s = 1) AS b FROM (SELECT text AS t, 0 AS s FROM documents UNION ALL SELECT text, 1 FROM benchmark) GROUP BY t)")
def text_set_ops_whole(spark, d):
    return linking.text_coverage(load(spark, d, "documents"), load(spark, d, "benchmark"), "text", "text")


@query("SELECT 'labels' AS \"table\", count(quality) AS linked, count(*) AS total, round(count(quality) / count(*), 4) AS share FROM documents LEFT JOIN labels USING (doc_id)")
def link_coverage(spark, d):
    joined = load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id", "left").withColumnRenamed("quality", "raw_query_id")
    return linking.coverage({"labels": joined})


#: A graph of two processes with stored procedure and ad-hoc statement, as logs write it.
GRAPH = """2025-11-03 08:41:19.52 spid27s    deadlock-list
2025-11-03 08:41:19.52 spid27s     deadlock victim=processAAA
2025-11-03 08:41:19.52 spid27s      process-list
2025-11-03 08:41:19.52 spid27s       process id=processAAA waitresource=KEY: 5:72 (ab) waittime=1200 ownerId=1 transactionname=user_transaction lockMode=U spid=61 hostname=APP1 currentdbname=shop lockTimeout=4294967295
2025-11-03 08:41:19.52 spid27s        executionStack
2025-11-03 08:41:19.52 spid27s         frame procname=shop.dbo.pay line=3
2025-11-03 08:41:19.52 spid27s    UPDATE accounts SET n = 1
2025-11-03 08:41:19.52 spid27s        inputbuf
2025-11-03 08:41:19.52 spid27s    Proc [Database Id = 5 Object Id = 9]
2025-11-03 08:41:19.52 spid27s       process id=processBBB waittime=7 lockMode=X spid=62 hostname=APP2 currentdbname=shop
2025-11-03 08:41:19.52 spid27s        executionStack
2025-11-03 08:41:19.52 spid27s         frame procname=adhoc line=1
2025-11-03 08:41:19.52 spid27s    unknown
2025-11-03 08:41:19.52 spid27s        inputbuf
2025-11-03 08:41:19.52 spid27s    SELECT  a FROM b
2025-11-03 08:41:19.52 spid27s       resource-list"""


@query(
    """SELECT u.id, p.pid, p.is_victim, p.lock_mode, p.proc_name, p.sql_text FROM (SELECT DISTINCT user_id AS id FROM events) u CROSS JOIN (VALUES
('processAAA', true, 'U', 'shop.dbo.pay', 'UPDATE accounts SET n = 1'), ('processBBB', false, 'X', '', 'SELECT a FROM b')) p(pid, is_victim, lock_mode, proc_name, sql_text)"""
)
def deadlock_parse(spark, d):
    users = load(spark, d, "events").select(F.col("user_id").alias("id")).distinct()
    logs = users.select("id", F.lit(GRAPH).alias("_raw"), F.lit("2025-11-03").alias("time"), F.col("id").cast("string").alias("host"))
    return deadlocks.processes(logs).select("id", "p.pid", "p.is_victim", F.col("p.lockMode").alias("lock_mode"), "p.proc_name", "p.sql_text")


# --- file layouts: driver tables in the shape of incident files ------------------------------------------------


def _file(df: DataFrame, name: str, order: str) -> DataFrame:
    """A frame as ``csv.read_file`` would give it."""
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns if c != order], F.lit(name).alias("file_name"), F.col(order).cast("long").alias("seq"))


def _slow_file(spark, d):
    o = load(spark, d, "orders")
    at = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    cells = o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, at).alias("last_execution_time"), at.alias("creation_time"), F.col("o_orderpriority").alias("host"), F.when(F.col("o_custkey") % 5 > 0, F.col("o_orderstatus")).alias("db_name"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey").cast("string")).otherwise("n/a").alias("execution_count"), F.concat(F.lit("  SELECT @P"), F.col("o_custkey").cast("string"), F.lit("  FROM t ")).alias("query_final"))
    return _file(cells, "maxElapsedQueriesProdFeb26.csv", "o_orderkey")


@query("SELECT o_orderkey AS seq, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS time, 'sql' AS source, o_orderpriority AS host, CASE WHEN o_custkey % 5 > 0 THEN o_orderstatus ELSE '' END AS db_name, 'prod' AS environment, 'slow_query' AS type, 'SELECT @P? FROM t' AS query_details FROM orders")
def layout_slow_sql(spark, d):
    return layouts.slow_sql(_slow_file(spark, d)).drop("extra_metadata", "occurrence_count")


@query("""SELECT o_orderkey AS seq, o_orderpriority AS host, 'prod' AS environment, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey END AS execution_count, CAST(NULL AS DOUBLE) AS avg_io, 'SELECT @P? FROM t' AS query_final, strftime(o_orderdate, '%Y-%m') AS month_year,
concat_ws('|', o_orderpriority, CASE WHEN o_custkey % 5 > 0 THEN o_orderstatus ELSE '' END, 'prod', 'SELECT @P? FROM t') AS parts FROM orders""")
def detail_slow_sql(spark, d):
    rows = layouts.detail_slow_sql(_slow_file(spark, d))
    return rows.select("seq", "host", "environment", "execution_count", "avg_io", "query_final", "month_year", F.array_join("hash_parts", "|").alias("parts"))


def _session_file(spark, d):
    e = load(spark, d, "events")
    cells = e.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("_time"), F.concat(F.lit("h"), (F.col("user_id") % 9).cast("string")).alias("host"), F.lit("shop").alias("database_name"), F.col("user_id").cast("string").alias("session_id"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("wait_type"), F.lit("").alias("command"), F.col("props").alias("head_blocker"), F.col("event_type").alias("query_text"), F.lit("2").alias("blocked_sessions_count"))
    return _file(cells, "blockersSatFeb26.csv", "event_id")


@query("""SELECT event_id AS seq, 'h' || CAST(user_id % 9 AS VARCHAR) AS host, event_type AS query_details, 'sat' AS environment,
'{"session_id": "' || CAST(user_id AS VARCHAR) || '"' || CASE WHEN event_id % 2 = 0 THEN ', "wait_type": "' || event_type || '"' ELSE '' END || ', "head_blocker": "' || replace(props, '"', '\\"') || '", "blocked_sessions_count": "2"}' AS extra_metadata FROM events""")
def layout_blocker_sessions(spark, d):
    return layouts.blocker(_session_file(spark, d)).select("seq", "host", "query_details", "environment", "extra_metadata")


@query("""SELECT event_id AS seq, 'shop' AS currentdbname, CAST(user_id AS VARCHAR) AS victims, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS resources, CAST(2 AS BIGINT) AS count, strftime(ts, '%Y-%m') AS month_year,
concat_ws('|', 'sat', 'shop', event_type, strftime(ts, '%Y-%m-%d %H:%M:%S'), CAST(user_id AS VARCHAR)) AS parts FROM events""")
def detail_blocker_sessions(spark, d):
    rows = layouts.detail_blocker(_session_file(spark, d))
    return rows.select("seq", "currentdbname", "victims", "resources", "count", "month_year", F.array_join("hash_parts", "|").alias("parts"))


def _summed_file(spark, d):
    c = load(spark, d, "customer")
    cells = c.select("c_custkey", F.col("c_mktsegment").alias("currentdbname"), F.col("c_name").alias("victims"), F.lit(None).cast("string").alias("resources"), F.lit("X").alias("lock_modes"), F.col("c_nationkey").cast("string").alias("count"), F.lit("2026-02-03 00:00:00").alias("latest"), F.when(F.col("c_custkey") % 2 == 0, "2026-01-03 00:00:00").alias("earliest"), F.lit("UPDATE t").alias("all_query"))
    return _file(cells, "blockersOld.csv", "c_custkey")


@query("""SELECT c_custkey AS seq, c_mktsegment AS db_name, 'UPDATE t' AS query_details, 'unknown' AS environment, '{"victims": "' || c_name || '", "count": "' || CAST(c_nationkey AS VARCHAR) || '", "lock_modes": "X"}' AS extra_metadata FROM customer""")
def layout_blocker_summed(spark, d):
    return layouts.blocker(_summed_file(spark, d)).select("seq", "db_name", "query_details", "environment", "extra_metadata")


@query("""SELECT c_custkey AS seq, c_name AS victims, CAST(c_nationkey AS BIGINT) AS count, CASE WHEN c_custkey % 2 = 0 THEN '2026-01' ELSE '2026-02' END AS month_year, concat_ws('|', 'unknown', c_mktsegment, 'X', 'UPDATE t') AS parts FROM customer""")
def detail_blocker_summed(spark, d):
    rows = layouts.detail_blocker(_summed_file(spark, d))
    return rows.select("seq", "victims", "count", "month_year", F.array_join("hash_parts", "|").alias("parts"))


def _mongo_file(spark, d):
    e = load(spark, d, "events")
    raw = F.concat(F.lit('{"attr":{"command":{"find":"'), F.col("event_type"), F.lit('"}}}'))
    cells = e.select("event_id", F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("host"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("t.$date"), F.concat(F.lit("db."), F.col("event_type"), F.lit(".x")).alias("attr.ns"), F.col("event_id").cast("string").alias("attr.durationMillis"), F.lit("remove").alias("attr.type"), F.when(F.col("event_id") % 3 == 0, F.lit("ABC")).alias("attr.queryShapeHash"), F.when(F.col("event_id") % 3 == 1, F.lit("WRITE")).alias("c"), raw.alias("_raw"))
    return _file(cells, "mongodbSlowQueriesProd.csv", "event_id")


@query("""SELECT event_id AS seq, 'mongodb' AS source, 'm' || CAST(user_id % 4 AS VARCHAR) AS host, 'db' AS db_name, 'slow_query_mongo' AS type, '{"find":"' || event_type || '"}' AS query_details FROM events""")
def layout_slow_mongo(spark, d):
    return layouts.slow_mongo(_mongo_file(spark, d)).select("seq", "source", "host", "db_name", "type", "query_details")


@query("""SELECT event_id AS seq, event_type || '.x' AS collection, event_id AS duration_ms, strftime(ts, '%Y-%m') AS month_year,
concat_ws('|', 'm' || CAST(user_id % 4 AS VARCHAR), 'db', 'prod', CASE event_id % 3 WHEN 0 THEN 'ABC' WHEN 1 THEN 'db.' || event_type || '.x:WRITE' ELSE 'db.' || event_type || '.x:remove' END) AS parts FROM events""")
def detail_slow_mongo(spark, d):
    rows = layouts.detail_slow_mongo(_mongo_file(spark, d))
    return rows.select("seq", "collection", "duration_ms", "month_year", F.array_join("hash_parts", "|").alias("parts"))


def _graph_file(spark, d):
    n = load(spark, d, "nation")
    raw = F.when(F.col("n_nationkey") % 3 == 0, F.lit(GRAPH)).when(F.col("n_nationkey") % 3 == 1, F.lit("no graph"))
    cells = n.select("n_nationkey", F.lit("2025-11-03T08:41:19").alias("_time"), F.col("n_name").alias("host"), F.when(F.col("n_nationkey") % 3 < 2, F.col("n_name")).alias("id"), raw.alias("_raw"))
    return _file(cells, "deadlocksProd.csv", "n_nationkey")


@query("""SELECT CAST(n_nationkey AS BIGINT) AS seq, n_name AS host, CASE WHEN n_nationkey % 3 = 0 THEN 'shop' ELSE '' END AS db_name, CASE WHEN n_nationkey % 3 = 0 THEN t.q ELSE n_name END AS query_details
FROM nation JOIN (VALUES (1, 'UPDATE accounts SET n = 1'), (2, 'SELECT a FROM b')) t(k, q) ON n_nationkey % 3 = 0 OR (n_nationkey % 3 = 1 AND t.k = 1)""")
def layout_deadlock_raw(spark, d):
    return layouts.deadlock(_graph_file(spark, d)).select("seq", "host", "db_name", "query_details")


@query("""SELECT CAST(n_nationkey AS BIGINT) AS seq, CASE WHEN n_nationkey % 3 = 0 THEN t.v END AS is_victim, CASE WHEN n_nationkey % 3 = 0 THEN t.w END AS wait_time_ms, CASE WHEN n_nationkey % 3 = 0 THEN t.q WHEN n_nationkey % 3 = 1 THEN n_name ELSE '' END AS sql_text, '2025-11' AS month_year
FROM nation JOIN (VALUES (1, 'UPDATE accounts SET n = 1', CAST(1 AS INT), CAST(1200 AS BIGINT)), (2, 'SELECT a FROM b', 0, 7)) t(k, q, v, w) ON n_nationkey % 3 = 0 OR t.k = 1""")
def detail_deadlock_raw(spark, d):
    return layouts.detail_deadlock(_graph_file(spark, d)).select("seq", "is_victim", "wait_time_ms", "sql_text", "month_year")


@query("""SELECT CAST(n_nationkey AS BIGINT) AS seq, CASE WHEN n_nationkey % 2 = 0 THEN 'UPDATE accounts SET n = 1' ELSE 'SELECT z' END AS query_details, CASE WHEN n_nationkey % 4 = 0 THEN 1 ELSE CAST(n_regionkey + 1 AS BIGINT) END AS occurrence_count,
CASE WHEN n_nationkey % 2 = 0 THEN 'APP1' ELSE n_name END AS apphost FROM nation""")
def layout_deadlock_legacy(spark, d):
    n = load(spark, d, "nation")
    even = F.col("n_nationkey") % 2 == 0
    cells = n.select("n_nationkey", F.lit("2026-01-26T08:58:53").alias("_time"), F.lit("DB1").alias("host"), F.col("n_name").alias("hostname"), F.when(F.col("n_nationkey") % 4 > 0, (F.col("n_regionkey") + 1).cast("string")).alias("count"), F.when(even, "frame procname=x").otherwise("SELECT z").alias("clean_query"), F.when(even, F.lit(GRAPH)).alias("_raw"))
    rows = layouts.deadlock(_file(cells, "deadlocksSat.csv", "n_nationkey"))
    return rows.select("seq", "query_details", "occurrence_count", F.get_json_object("extra_metadata", "$.apphost").alias("apphost"))


@query("SELECT o_orderkey AS id, k.first AS raw_query_id FROM orders JOIN (SELECT o_custkey, min(o_orderkey) AS first FROM orders GROUP BY o_custkey) k USING (o_custkey)")
def text_backfill_link(spark, d):
    o = load(spark, d, "orders")
    raw = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("query_details"))
    details = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("sql_text"), F.lit(None).cast("long").alias("raw_query_id"))
    return linking.link_by_text(details, raw, "sql_text").select("id", "raw_query_id")


@query(cte("upload_log") + "SELECT max(id) AS id, filename FROM upload_log GROUP BY filename")
def latest_uploads(spark, d):
    return merge.latest_uploads(frame(spark, d, "upload_log")).select("id", "filename")


@query(cte("curated_query") + "SELECT label_id, count(*) AS uses FROM curated_query WHERE label_id IS NOT NULL GROUP BY label_id")
def label_uses(spark, d):
    return curation.uses_of_labels(frame(spark, d, "curated_query"))


@query("SELECT DISTINCT event_type AS query_type FROM events UNION SELECT unnest(['slow_query', 'blocker', 'deadlock', 'slow_query_mongo'])")
def spl_types(spark, d):
    return curation.spl_types(load(spark, d, "events").select(F.col("event_type").alias("query_type")))


@query(r"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE CAST(1 + o_orderkey % 2 AS INT) END AS parameters, CASE WHEN o_orderkey % 3 = 0 THEN 'select 1' ELSE 'select * from t' END AS sql FROM orders""")
def readable_fingerprint(spark, d):
    k = F.col("o_orderkey")
    shape = F.when(k % 3 == 0, "select 1").when(k % 2 == 0, "(@p? nvarchar(?))select * from t").otherwise("(@p? nvarchar(?),@p? int) select * from t")
    return load(spark, d, "orders").select(k.alias("id"), text.parameter_count(shape).alias("parameters"), text.readable(shape).alias("sql"))


from . import entries, stored  # noqa: E402,F401  the others register themselves
