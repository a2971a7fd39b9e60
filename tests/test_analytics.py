"""The analytics on a hand-computed frame, and filters' edges."""

import pytest

from dbpulse.operators import analytics, browse, filters

ROWS = [
    (1, "h1", "2026-01-05 10:00:00", "sql", "WINDB11ST01N", "shop", "prod", "slow_query", "SELECT 1", "2026-01", 3),
    (2, "h2", "2026-01-05 11:00:00", "sql", "WINDB11ST01N", "shop", "prod", "slow_query", "SELECT 2", "2026-01", 7),
    (3, "h3", "2026-01-06 10:00:00", "sql", "WINFODB06HV12", "crm", "sat", "blocker", "UPDATE t", "2026-01", 2),
    (4, "h4", "2026-01-06 10:00:00", "sql", "WINDB11ST01N", "shop", "prod", "deadlock", "DELETE t", "2026-01", 1),
    (5, "h5", "2026-01-07 12:00:00", "mongodb", "MONGO1", "docs", "sat", "slow_query_mongo", '{"find":"x"}', "2026-01", 5),
]
SCHEMA = "id long, query_hash string, time string, source string, host string, db_name string, environment string, type string, query_details string, month_year string, occurrence_count long"


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_month(raw):
    [m] = analytics.by_month(raw).collect()
    assert tuple(m) == ("2026-01", 5, 18, None, None, 3, 2)


def test_co_occurrence(raw):
    assert [tuple(r) for r in analytics.co_occurrence(raw).collect()] == [("WINFODB06HV12", "2026-01", 2, 0, 2), ("WINDB11ST01N", "2026-01", 0, 1, 1)]
    assert analytics.co_occurrence(raw, both_only=True).count() == 0


def test_hosts_with_few_rows(raw):
    assert [r.host for r in analytics.host_stats(raw).collect()] == ["WINDB11ST01N"]


def test_empty(raw):
    none = raw.where("id < 0")
    assert analytics.by_month(none).count() == 0 and analytics.top_fingerprints(none).count() == 0 and analytics.by_hour(none).count() == 0
    [c] = analytics.curation_coverage(none, raw.selectExpr("id", "id as raw_query_id")).collect()
    assert c.coverage_pct == 0.0


def test_filter_values(raw):
    assert filters.analytics(raw, host="").count() == 0
    assert filters.listing(raw, host="").count() == 5
    assert filters.analytics(raw, system="nowhere", systems={}).count() == 0
    assert filters.analytics(raw, system="x", systems={"X": ["windb11st01n"]}).count() == 3
    with pytest.raises(ValueError):
        filters.analytics(raw, color="red")
    with pytest.raises(ValueError):
        analytics.by_host(raw, top_n=0)
    with pytest.raises(ValueError):
        browse.ordering("host")


def test_wildcards_in_search(raw):
    assert filters.listing(raw, search="select _").count() == 2
    assert filters.exported(raw, host="windb").count() == 3


def test_cell_page_beyond_the_end_is_empty(raw):
    page = analytics.by_hour_queries(raw, 10, 1, limit=1)
    assert [(r.id, r.total) for r in page.collect()] == [(3, 2)]
    assert analytics.by_hour_queries(raw, 10, 1, limit=1, offset=5).count() == 0


def test_plan_prunes_and_pushes(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    rows = orders.selectExpr("o_orderkey id", "o_orderstatus environment", "o_orderpriority month_year", "o_custkey occurrence_count")
    plan = analytics.by_month(rows, environment="P")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,P)" in plan and "o_totalprice" not in plan
