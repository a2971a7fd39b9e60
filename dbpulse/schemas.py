"""Schemas of the persistent tables. Every one is explicit; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import StructType

_KEPT = "occurrence_count long, first_seen timestamp, last_seen timestamp, created_at timestamp, updated_at timestamp"

RAW_QUERY = f"id long, query_hash string, time string, source string, host string, db_name string, environment string, type string, query_details string, month_year string, extra_metadata string, {_KEPT}"
CURATED_QUERY = "id long, raw_query_id long, label_id long, notes string, created_at timestamp, updated_at timestamp"
PATTERN_LABEL = "id long, name string, severity string, description string, source string, created_at timestamp, updated_at timestamp"
UPLOAD_LOG = "id long, filename string, file_type string, environment string, month_year string, csv_row_count long, inserted long, updated long, uploaded_at string"
SPL_QUERY = "id long, name string, query_type string, environment string, description string, spl string, created_at timestamp, updated_at timestamp"
_DETAIL = f"id long, query_hash string, raw_query_id long, {_KEPT}, month_year string"
SLOW_SQL = f"{_DETAIL}, host string, db_name string, environment string, creation_time string, last_execution_time string, max_elapsed_time_s double, avg_elapsed_time_s double, total_elapsed_time_s double, total_worker_time_s double, avg_io double, avg_logical_reads double, avg_logical_writes double, execution_count long, query_final string"
BLOCKER = f"{_DETAIL}, environment string, currentdbname string, victims string, resources string, lock_modes string, count long, latest string, earliest string, all_query string"
DEADLOCK = f"{_DETAIL}, host string, db_name string, environment string, event_time string, deadlock_id string, is_victim int, lock_mode string, wait_resource string, wait_time_ms long, transaction_name string, app_host string, sql_text string, raw_xml string"
SLOW_MONGO = f"{_DETAIL}, host string, db_name string, collection string, environment string, event_time string, duration_ms long, plan_summary string, op_type string, remote_client string, command_json string"

TABLES = {
    "raw_query": RAW_QUERY,
    "curated_query": CURATED_QUERY,
    "pattern_label": PATTERN_LABEL,
    "upload_log": UPLOAD_LOG,
    "spl_query": SPL_QUERY,
    "raw_query_slow_sql": SLOW_SQL,
    "raw_query_blocker": BLOCKER,
    "raw_query_deadlock": DEADLOCK,
    "raw_query_slow_mongo": SLOW_MONGO,
}
#: Tables that ingestion fills, and that a partial reset empties.
INGESTED = ["raw_query", "upload_log", "raw_query_slow_sql", "raw_query_blocker", "raw_query_deadlock", "raw_query_slow_mongo"]
#: Detail table of each kind, and its column that mirrors a common row's text.
DETAILS = {
    "slow_query": ("raw_query_slow_sql", "query_final"),
    "blocker": ("raw_query_blocker", "all_query"),
    "deadlock": ("raw_query_deadlock", "sql_text"),
    "slow_query_mongo": ("raw_query_slow_mongo", "command_json"),
}


def schema(table: str) -> StructType:
    if table not in TABLES:
        raise ValueError(f"unknown table: {table}")
    return StructType.fromDDL(TABLES[table])
