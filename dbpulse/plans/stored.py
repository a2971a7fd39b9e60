"""Queries of the store and of what is kept beside its tables; they register themselves.

Each makes a store in a scratch folder, puts whole driver tables into it, and returns what is read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import analytics, browse, changes, linking, merge
from ..sources import csv
from ..sources.store import Store
from ..sources.textindex import TextIndex
from . import ingest
from .entries import SUMS, _scratch
from .frames import cte, frame, load
from .registry import query
from .rollups import Rollup

WAYS = "o AS (SELECT * FROM raw_query WHERE id % 3 <> 0), n AS (SELECT * FROM raw_query WHERE id % 3 = 0 OR id % 2 = 0)"
KEPT = ["id", "query_hash", "time", "source", "host", "db_name", "environment", "type", "query_details", "month_year", "occurrence_count"]


def _store(spark, **how) -> Store:
    return Store(spark, _scratch(spark, "store"), **{"buckets": 4, "one_writer": True} | how)


def _rows(spark, d) -> DataFrame:
    """The incident table with all columns of raw_query."""
    rows = frame(spark, d, "raw_query").withColumn("occurrence_count", F.col("occurrence_count").cast("long"))
    none = {c: F.lit(None).cast("timestamp") for c in ("first_seen", "last_seen", "created_at", "updated_at")}
    return rows.withColumns({"extra_metadata": F.lit(None).cast("string"), **none})


def _loaded(spark, d, **how) -> Store:
    """A store with the rows that ``o`` names."""
    store = _store(spark, **how)
    store.write("raw_query", _rows(spark, d).where("id % 3 <> 0"))
    return store


def _upsert(store: Store, rows: DataFrame, token: str = "") -> None:
    store.rewrite("raw_query", rows.withColumn("seq", F.col("id")).drop("id"), lambda old, new: ingest._upserted(store, "raw_query", old, new, token), token)


def _second(spark, d) -> DataFrame:
    return _rows(spark, d).where("id % 3 = 0 or id % 2 = 0").withColumn("type", F.lit("blocker"))


@query(
    cte("raw_query")
    + f""", {WAYS}
SELECT CASE WHEN o.id IS NOT NULL THEN o.id ELSE (SELECT max(id) FROM o) + row_number() OVER (PARTITION BY o.id IS NULL ORDER BY n.id) END AS id, coalesce(o.query_hash, n.query_hash) AS query_hash, coalesce(o.host, n.host) AS host, coalesce(o.type, 'blocker') AS type,
CAST(coalesce(o.occurrence_count, 0) + coalesce(n.occurrence_count, 0) AS BIGINT) AS occurrence_count FROM o FULL OUTER JOIN n ON o.query_hash = n.query_hash"""
)
def store_upsert(spark, d):
    """Rows taken into a bucketed table by key."""
    store = _loaded(spark, d)
    _upsert(store, _second(spark, d))
    return store.read("raw_query").select("id", "query_hash", "host", "type", "occurrence_count")


@query(
    cte("raw_query")
    + f""", {WAYS}, b AS (SELECT o.*, n.occurrence_count AS more FROM o JOIN n ON o.query_hash = n.query_hash)
SELECT 'insert' AS change, query_hash, 'blocker' AS type, CAST(occurrence_count AS BIGINT) AS occurrence_count FROM n WHERE query_hash NOT IN (SELECT query_hash FROM o)
UNION ALL SELECT 'update_before', query_hash, type, CAST(occurrence_count AS BIGINT) FROM b UNION ALL SELECT 'update_after', query_hash, type, CAST(occurrence_count + more AS BIGINT) FROM b"""
)
def store_changes(spark, d):
    """What an upsert changed, by the files in which two versions differ."""
    store = _loaded(spark, d)
    _upsert(store, _second(spark, d))
    return store.changes("raw_query", 1).select("change", "query_hash", "type", "occurrence_count")


@query(cte("raw_query") + f", {WAYS} SELECT id, query_hash, occurrence_count FROM o")
def store_changes_undone(spark, d):
    """A version made from the next one by the changes between them, taken back."""
    store = _loaded(spark, d)
    _upsert(store, _second(spark, d))
    back = changes.replayed(store.read("raw_query"), changes.inverted(store.changes("raw_query", 1, 2)), "query_hash")
    return back.select("id", "query_hash", "occurrence_count")


@query(cte("raw_query") + "SELECT id, host, db_name, month_year FROM raw_query WHERE host = 'HOST7' AND db_name = 'db2'")
def store_skipping_scan(spark, d):
    """Rows of a host and database, from the files that can hold them."""
    store = _store(spark, file_rows=200)
    store.write("raw_query", _rows(spark, d))
    return store.scan("raw_query", host="HOST7", db_name="db2").select("id", "host", "db_name", "month_year")


@query(
    cte("raw_query")
    + f""", {WAYS}, u AS (SELECT coalesce(o.environment, n.environment) AS environment, coalesce(o.type, 'blocker') AS type, coalesce(o.source, n.source) AS source, coalesce(o.host, n.host) AS host,
  coalesce(o.occurrence_count, 0) + coalesce(n.occurrence_count, 0) AS occurrence_count, coalesce(o.query_hash, n.query_hash) AS query_hash FROM o FULL OUTER JOIN n ON o.query_hash = n.query_hash),
r AS (SELECT environment, CASE WHEN query_hash IN (SELECT query_hash FROM raw_query WHERE id % 7 = 0) THEN 'deadlock' ELSE type END AS type, source, occurrence_count FROM u)
SELECT environment, type, source, {SUMS} FROM r GROUP BY ALL"""
)
def rollup_advanced(spark, d):
    """The summary from a kept roll-up that was advanced over an upsert and a replacement."""
    store = _loaded(spark, d)
    kept = Rollup(store)
    kept.advance()
    _upsert(store, _second(spark, d))
    kept.advance()
    other = store.read("raw_query").join(_rows(spark, d).where("id % 7 = 0").select("query_hash"), "query_hash", "left_semi").withColumn("type", F.lit("deadlock"))
    store.rewrite("raw_query", other, lambda old, new: merge.replace_by_key(old, new, "query_hash"))
    kept.advance()
    return kept.read(["environment", "type", "source"])


@query(
    cte("raw_query")
    + f""", h AS (SELECT host, environment, {SUMS} FROM raw_query WHERE host IS NOT NULL GROUP BY ALL)
SELECT host, environment, row_count, total_occurrences FROM h ORDER BY total_occurrences DESC, host, environment LIMIT 20"""
)
def by_host_from_rollup(spark, d):
    """Top hosts of a table from its kept roll-up, which two writes have advanced."""
    store = _loaded(spark, d)
    kept = Rollup(store)
    kept.advance()
    store.rewrite("raw_query", _rows(spark, d).where("id % 3 = 0"), lambda old, new: old.unionByName(new))
    kept.advance()
    return analytics.by_host(kept.read())


@query(cte("raw_query") + f"SELECT environment, {SUMS} FROM raw_query GROUP BY environment")
def registered_tables(spark, d):
    """A table asked by its name in SQL, after somebody else has written to it."""
    store = _loaded(spark, d, cache_seconds=0)
    store.cached("raw_query")
    other = Store(spark, store.root, buckets=4, one_writer=True)
    other.rewrite("raw_query", _rows(spark, d).where("id % 3 = 0"), lambda old, new: old.unionByName(new))
    store.register("raw_query")
    out = spark.sql(f"SELECT environment, {SUMS.replace('AS BIGINT', 'AS LONG')} FROM raw_query GROUP BY environment")
    store.invalidate()
    return out


@query("SELECT doc_id AS id, text, CAST(n_chars AS BIGINT) AS n_chars, CAST(NULL AS VARCHAR) AS language FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, text, n_chars, lang FROM documents WHERE doc_id % 2 = 1")
def schema_versions(spark, d):
    """A table of which half was written before a column was added, one dropped, one renamed and one widened."""
    docs, store = load(spark, d, "documents"), _store(spark)
    half = lambda n: F.pmod("doc_id", F.lit(2)) == n
    store.define("texts", "id long, body string, n_chars int, gone string", "id")
    store.write("texts", docs.where(half(0)).select(F.col("doc_id").alias("id"), F.col("text").alias("body"), "n_chars", F.col("source").alias("gone")))
    store.define("texts", "id long, text string, n_chars long, language string", "id")
    store.migrate("texts", {"text": "body"})
    store.rewrite("texts", docs.where(half(1)).select(F.col("doc_id").alias("id"), "text", "n_chars", F.col("lang").alias("language")), lambda old, new: old.unionByName(new))
    return store.read("texts")


@query("SELECT doc_id, lang FROM documents WHERE text ILIKE '%the and%'")
def search_indexed(spark, d):
    """Documents that hold a text, from the files whose three-byte pieces allow it."""
    store = _store(spark, file_rows=20)
    store.define("texts", "doc_id long, lang string, text string", "doc_id", ["lang"])
    store.write("texts", load(spark, d, "documents").select("doc_id", "lang", "text"))
    index = TextIndex(store, "texts", "text")
    index.refresh()
    return index.search("The and").select("doc_id", "lang")


@query("SELECT doc_id, text, lang FROM documents")
def csv_split_round_trip(spark, d):
    """Quoted texts with line breaks, read back by as many tasks as the file has blocks."""
    path = _scratch(spark, "export")
    csv.write_export(load(spark, d, "documents").select("doc_id", "text", "lang"), path)
    back = csv.read_split(spark, path, ["doc_id", "text", "lang"])
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")


@query(
    """WITH r AS (SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'hot' ELSE CAST(l_suppkey AS VARCHAR) END AS host, CAST(round(l_extendedprice * 100) AS BIGINT) AS occurrence_count FROM lineitem)
SELECT host, round(quantile_cont(occurrence_count, 0.5), 4) AS p50, round(quantile_cont(occurrence_count, 0.95), 4) AS p95, round(quantile_cont(occurrence_count, 0.99), 4) AS p99, max(occurrence_count) AS max_occ,
CAST(sum(occurrence_count) AS BIGINT) AS total_occurrences, count(*) AS row_count FROM r GROUP BY host HAVING count(*) >= 3 ORDER BY p95 DESC, total_occurrences DESC, host LIMIT 200"""
)
def host_stats_ranked(spark, d):
    """Percentiles by narrowing histograms; one host has a third of the rows, with nearly as many different values."""
    host = F.when(F.col("l_orderkey") % 3 == 0, "hot").otherwise(F.col("l_suppkey").cast("string"))
    rows = load(spark, d, "lineitem").select(host.alias("host"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("occurrence_count"))
    return analytics.host_stats_ranked(rows, top_n=200, digits=4)  # one place would be a matter of the last bit where the next is a 5


@query("SELECT doc_id AS id, (SELECT min(doc_id) FROM documents x WHERE x.text IS NOT DISTINCT FROM d.text) AS raw_query_id FROM documents d")
def link_long_texts(spark, d):
    """Every document with the first of its text, by digests."""
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return linking.null_safe_first(docs, docs, [("text", "text")]).select("id", "raw_query_id")


@query(
    cte("raw_query")
    + """, p AS (SELECT id, occurrence_count FROM raw_query ORDER BY occurrence_count DESC, id DESC LIMIT 1 OFFSET 199)
SELECT r.id, r.occurrence_count, r.host FROM raw_query r, p WHERE r.occurrence_count < p.occurrence_count OR (r.occurrence_count = p.occurrence_count AND r.id < p.id) ORDER BY r.occurrence_count DESC, r.id DESC LIMIT 200"""
)
def list_page_after(spark, d):
    """The page that follows the last row of the page before it."""
    raw = frame(spark, d, "raw_query")
    last = browse.after(raw, "occurrence_count", limit=200).collect()[-1]
    return browse.after(raw, "occurrence_count", last_id=last.id, last_value=last.occurrence_count, limit=200).select("id", "occurrence_count", "host")


@query(
    """WITH r AS (SELECT strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS time, o_orderpriority AS host, 'db' || o_orderstatus AS db_name, o_custkey % 5 AS n FROM orders),
k AS (SELECT host, db_name, time, n, count(*) AS occurrences FROM r GROUP BY ALL)
SELECT 'slow_query' AS type, 'prod' AS environment, host, db_name, count(*) AS rows, CAST(sum(occurrences) AS BIGINT) AS occurrences, 0 AS unlinked, (SELECT count(*) FROM orders) AS logged_rows FROM k GROUP BY ALL"""
)
def folder_taken_in(spark, d):
    """A folder of files of one layout, taken in together through the store: keyed, counted, logged and linked."""
    store, folder = _store(spark), _scratch(spark, "incoming")
    rows = load(spark, d, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("last_execution_time"), F.col("o_orderpriority").alias("host"), F.concat(F.lit("db"), "o_orderstatus").alias("db_name"),
        F.concat(F.lit('SELECT "a",\n'), (F.col("o_custkey") % 5).cast("string")).alias("query_final"),
    )
    csv.write_export(rows.repartition(3, "query_final"), folder)
    csv.rename_files(spark, folder, "maxElapsedProd")
    ingest.ingest_path(store, folder)
    unlinked = store.read("raw_query_slow_sql").agg(F.count_if(F.col("raw_query_id").isNull()).alias("unlinked"))
    logged = store.read("upload_log").agg(F.sum("csv_row_count").cast("long").alias("logged_rows"))
    taken = store.read("raw_query").groupBy("type", "environment", "host", "db_name").agg(F.count("*").alias("rows"), F.sum("occurrence_count").cast("long").alias("occurrences"))
    return taken.crossJoin(F.broadcast(unlinked)).crossJoin(F.broadcast(logged))
