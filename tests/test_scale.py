"""CSV files of many blocks, percentiles of hot hosts, links by digest, pages by place."""

import csv as plain
import random
from urllib.parse import unquote

import numpy as np
import pytest
from pyspark.sql import functions as F

from dbpulse.operators import analytics, browse, linking
from dbpulse.sources import csv


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("few", [True, False])
def test_a_file_is_read_by_several_tasks(spark, tmp_path, small_blocks, monkeypatch, end, few):
    rng = random.Random(4)
    piece = lambda: rng.choice(["a", "é", '"', ",", "\n", "long line without any quote ", '""', "\n\n", "x" * 50])
    names = ["id", "a.b", "text"]
    for f, n in (("one file+x.csv", 300), ("two.csv", 40), ("none.csv", 0)):
        with (tmp_path / f).open("w", newline="", encoding="utf-8") as out:
            w = plain.writer(out, lineterminator=end)
            w.writerow(names)
            for i in range(n):
                w.writerow([i, "".join(piece() for _ in range(rng.randint(0, 4))), "".join(piece() for _ in range(rng.randint(0, 400 if i == 7 else 9))) or "."])
    paths = [f"file://{tmp_path}/{f}" for f in ("one file+x.csv", "two.csv", "none.csv")]
    if not few:
        monkeypatch.setattr(csv, "BROADCAST_BLOCKS", -1)
    got = csv.read_split(spark, paths, names)
    assert csv.header(spark, paths[0]) == names
    whole = spark.read.options(**csv.OPTIONS).csv(paths).withColumn("file_name", F.col("_metadata.file_name"))
    rows = got.orderBy("file_name", "seq").collect()
    key = lambda r: (unquote(r.file_name), int(r.id), r["a.b"], r.text)
    assert [key(r) for r in rows] == sorted((key(r) for r in whole.collect()), key=lambda k: k[:2])
    assert len({(r.file_name, r.seq) for r in rows}) == len(rows) == 340
    if few:
        assert got.rdd.getNumPartitions() > 5


def test_headers(spark, tmp_path):
    (tmp_path / "h.csv").write_bytes('﻿"a\nb",,A,a\r\n1,2,3,4\r\n'.encode())
    (tmp_path / "empty.csv").write_bytes(b"")
    assert csv.header(spark, f"file://{tmp_path}/h.csv") == ["a\nb", "_c1", "A2", "a3"] and csv.header(spark, f"file://{tmp_path}/empty.csv") == []


@pytest.mark.parametrize("bins", [2, 7, 1024])
def test_percentiles_by_rank(spark, monkeypatch, bins):
    monkeypatch.setattr(analytics, "BINS", bins)
    rng = np.random.default_rng(bins)
    data = [("hot", int(v)) for v in rng.integers(-5_000, 5_000, 400)] + [(f"h{i % 9}", int(v)) for i, v in enumerate(rng.integers(0, 30, 120))] + [("one", 7), ("none", None), (None, 3)]
    df = spark.createDataFrame(data, "host string, v long")
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {r.host: [r[s] for s in shares] for r in analytics.ranked_percentiles(df, "host", "v", shares).collect()}
    for host in {h for h, v in data if v is not None and h}:
        assert np.allclose(got[host], np.percentile([v for h, v in data if h == host], [q * 100 for q in shares.values()]))
    assert "none" not in got and analytics.ranked_percentiles(df.limit(0), "host", "v", shares).count() == 0


def test_ranked_hosts_equal_plain_percentiles(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([("hot" if i % 3 == 0 else f"h{i % 40}", int(v), "prod") for i, v in enumerate(rng.integers(1, 3_000_000, 3000))], "host string, occurrence_count long, environment string")
    assert analytics.host_stats_ranked(rows, environment="prod").collect() == analytics.host_stats(rows, environment="prod").collect()


def test_links_shuffle_no_text(spark):
    rng = random.Random(3)
    value = lambda: rng.choice([None, "", "x", "y", "z" * 3000])
    common = [(i, value(), value(), value()) for i in range(200)]
    details = [(i, value(), "z" * 3000 if i % 3 else value(), value()) for i in range(300)]
    ddl = "id long, a string, b string, t string"
    left, right = spark.createDataFrame(details, ddl), spark.createDataFrame(common, ddl)
    for blank in (False, True):
        same = lambda x: (None if blank and x == "" else x)  # noqa: B023, E731
        want = {d[0]: min((c[0] for c in common if [same(v) for v in c[1:]] == [same(v) for v in d[1:]]), default=None) for d in details}
        got = linking.null_safe_first(left, right, [("a", "a"), ("b", "b"), ("t", "t")], blank_is_null=blank)
        assert {r.id: r.raw_query_id for r in got.collect()} == want and len(want) == 300
        assert all(r.b == details[r.id][2] for r in got.select("id", "b").collect())
    plan = linking.null_safe_first(left, right, [("a", "a"), ("b", "b"), ("t", "t")]).select("id", "raw_query_id")._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert not [line for line in physical.splitlines() if "Exchange" in line and ("t#" in line or "b#" in line)]


@pytest.mark.parametrize(("sort_by", "descending"), [("id", True), ("id", False), ("occurrence_count", True), ("occurrence_count", False)])
def test_pages_by_place_give_each_row_once(spark, sort_by, descending):
    data = [(i, None if i % 7 == 0 else i % 4) for i in range(90)]
    df = spark.createDataFrame(data, "id long, occurrence_count long").coalesce(1).cache()
    seen, last = [], None
    while True:
        page = browse.after(df, sort_by, descending, last and last.id, last and last[sort_by], 20).collect()
        if not page:
            break
        seen, last = seen + page, page[-1]
    want = []
    for offset in range(0, 90, 20):
        want += browse.page(df, browse.ordering(sort_by, descending), 20, offset).collect()
    assert seen == want and len(seen) == 90
    with pytest.raises(ValueError):
        browse.after(df, limit=0)
