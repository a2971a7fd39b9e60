"""Every registered analytics query against its oracle SQL on the smallest tables."""

import pytest

from compare import oracle_rows, query_rows
from dbpulse.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_oracle(spark, sf, name):
    columns, rows = query_rows(QUERIES[name](spark, sf))
    if name in ORACLE_SQL:
        want = oracle_rows(ORACLE_SQL[name], sf)
        assert (columns, rows) == want
        if not want[1]:  # some filters hold nothing in the smallest tables
            larger = sf.replace("0.001", "0.01")
            got = query_rows(QUERIES[name](spark, larger))
            assert got == oracle_rows(ORACLE_SQL[name], larger) and got[1]
    else:
        assert rows


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_whole_bodies_are_kept(spark, sf):
    rows = QUERIES["fingerprint_strip_header_whole"](spark, sf).selectExpr("max(length(body))").first()
    assert rows[0] > 200


def test_set_operations_read_every_document(spark, sf):
    got = QUERIES["text_set_ops_whole"](spark, sf).first()
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("text").distinct().count()
    assert got.shared + got.left_only == texts
