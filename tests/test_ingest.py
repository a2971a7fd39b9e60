"""Files to tables: every layout, deduplication, accumulation, linking, export, maintenance."""

import csv as pycsv
import json

import pytest
from pyspark.sql import functions as F

from dbpulse import schemas
from dbpulse.operators import analytics, browse, curation, linking, merge

from dbpulse.plans import ingest
from dbpulse.plans.catalogue import GRAPH
from dbpulse.sources import csv, layouts
from dbpulse.sources.store import Store


def write(folder, name, rows):
    path = folder / name
    with path.open("w", newline="", encoding="utf-8") as f:
        w = pycsv.DictWriter(f, rows[0].keys())
        w.writeheader()
        w.writerows(rows)
    return str(path)


SLOW = [
    {"creation_time": "", "last_execution_time": "2026-02-01T10:00:00", "host": "H1", "db_name": "shop", "max_elapsed_time_s": "1.5", "execution_count": "3", "query_final": "SELECT  1\n FROM t WHERE a=@P12"},
    {"creation_time": "2026-01-31T10:00:00", "last_execution_time": "", "host": "H2", "db_name": "", "max_elapsed_time_s": "x", "execution_count": "", "query_final": 'SELECT "q"'},
]
SESSIONS = [{"_time": "2026-02-02T00:00:00", "host": "H1", "database_name": "shop", "session_id": str(i), "wait_type": "LCK", "command": "UPDATE", "head_blocker": "", "query_text": "UPDATE t", "blocked_sessions_count": "2"} for i in (1, 2)]


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store", buckets=4)
    s.create_all()
    return s


def test_slow_sql(store, tmp_path):
    path = write(tmp_path, "maxElapsedProdFeb26.csv", SLOW)
    out = ingest.ingest_file(store, path)
    assert (out.inserted, out.updated, out.rows, out.environment) == (2, 0, 2, "prod")
    rows = {r.host: r for r in store.read("raw_query").collect()}
    assert rows["H1"].query_details == "SELECT 1 FROM t WHERE a=@P?" and rows["H1"].month_year == "2026-02"
    assert rows["H2"].query_details == 'SELECT "q"' and rows["H2"].db_name is None and rows["H2"].month_year == "2026-01"
    assert sorted(r.id for r in rows.values()) == [1, 2]
    detail = {r.host: r for r in store.read("raw_query_slow_sql").collect()}
    assert detail["H1"].max_elapsed_time_s == 1.5 and detail["H2"].max_elapsed_time_s is None and detail["H1"].execution_count == 3
    assert detail["H1"].raw_query_id == rows["H1"].id
    [log] = store.read("upload_log").collect()
    assert (log.filename, log.csv_row_count, log.month_year) == ("maxElapsedProdFeb26.csv", 2, "2026-02")


def test_again_adds_up(store, tmp_path):
    path = write(tmp_path, "maxElapsedProdFeb26.csv", SLOW + SLOW[:1])
    ingest.ingest_file(store, path)
    again = ingest.ingest_file(store, path)
    assert (again.inserted, again.updated) == (0, 2)
    assert sorted(r.occurrence_count for r in store.read("raw_query").collect()) == [2, 4]
    assert store.read("upload_log").count() == 1
    assert ingest.ingest_file(store, path, only_once=True) is None


def test_blocker_layouts(spark, store, tmp_path):
    ingest.ingest_file(store, write(tmp_path, "blockersSat.csv", SESSIONS))
    rows = store.read("raw_query").collect()
    assert len(rows) == 2 and json.loads(rows[0].extra_metadata) == {"session_id": rows[0].extra_metadata.split('"')[3], "wait_type": "LCK", "command": "UPDATE", "blocked_sessions_count": "2"}
    detail = store.read("raw_query_blocker").orderBy("victims").collect()
    assert [(r.victims, r.resources, r.lock_modes, r["count"], r.latest) for r in detail] == [(s, "LCK", "UPDATE", 2, "2026-02-02T00:00:00") for s in ("1", "2")]
    old = [{"currentdbname": "shop", "victims": "a", "resources": "", "lock_modes": "X", "count": "5", "latest": "2026-02-03 00:00:00", "earliest": "", "all_query": "UPDATE u"}]
    df = csv.read_file(spark, write(tmp_path, "blockersOld.csv", old))
    [common] = layouts.blocker(df).collect()
    assert (common.db_name, common.extra_metadata) == ("shop", '{"victims": "a", "count": "5", "lock_modes": "X"}')
    [d] = merge.normalised_details(layouts.detail_blocker(df), F.current_timestamp()).collect()
    assert (d.month_year, d["count"]) == ("2026-02", 5)


def test_deadlock_raw(store, tmp_path):
    rows = [{"_time": "2025-11-03T08:41:19.000+0800", "host": "DB1", "id": "p1", "_raw": GRAPH}, {"_time": "t", "host": "DB1", "id": "only ids", "_raw": "garbled"}, {"_time": "t", "host": "DB1", "id": "", "_raw": ""}]
    ingest.ingest_file(store, write(tmp_path, "deadlocksProd.csv", rows))
    got = {r.query_details: r for r in store.read("raw_query").collect()}
    assert set(got) == {"UPDATE accounts SET n = 1", "SELECT a FROM b", "only ids"}
    assert got["SELECT a FROM b"].db_name == "shop" and got["SELECT a FROM b"].month_year == "2025-11"
    detail = {r.sql_text: r for r in store.read("raw_query_deadlock").collect()}
    assert detail["UPDATE accounts SET n = 1"].is_victim == 1 and detail["UPDATE accounts SET n = 1"].wait_time_ms == 1200
    assert "" in detail  # detail rows keep blank fragments


def test_deadlock_legacy(spark, tmp_path):
    base = {"_time": "2026-01-26T08:58:53", "host": "DB1", "hostname": "APP9", "currentdbname": "shop", "victim": "v", "lockMode": "U", "lockTimeout": "", "waittime": "12", "transactionname": "tx"}
    rows = [base | {"count": "4", "clean_query": "frame procname=shop.dbo.pay", "_raw": GRAPH}, base | {"count": "x", "clean_query": "SELECT z", "_raw": ""}]
    df = csv.read_file(spark, write(tmp_path, "deadlocksSat.csv", rows))
    a, b = layouts.deadlock(df).orderBy("seq").collect()
    assert (a.query_details, a.occurrence_count) == ("UPDATE accounts SET n = 1", 4) and json.loads(a.extra_metadata)["source"] == "legacy_csv"
    assert (b.query_details, b.occurrence_count) == ("SELECT z", 1)
    assert json.loads(b.extra_metadata) == {"source": "legacy_csv", "deadlock_victim": "v", "lockMode": "U", "waittime": "12", "transactionname": "tx", "apphost": "APP9"}
    d = layouts.detail_deadlock(df).orderBy("seq").collect()
    assert [r.sql_text for r in d] == ["frame procname=shop.dbo.pay", "SELECT z"] and [r.wait_time_ms for r in d] == [1200, 12]


def test_mongo_and_cascade(store, tmp_path):
    raw = json.dumps({"attr": {"command": {"find": "orders", "filter": {"a": 1}}}})
    rows = [{"host": "M1", "t.$date": "2026-02-01T00:00:00.000+08:00", "attr.ns": "shop.orders.x", "attr.durationMillis": "15", "attr.type": "command", "attr.planSummary": "COLLSCAN", "attr.remote": "r", "attr.queryShapeHash": "", "c": "COMMAND", "_raw": raw}]
    ingest.ingest_file(store, write(tmp_path, "mongodbSlowProd.csv", rows))
    [d] = store.read("raw_query_slow_mongo").collect()
    assert (d.db_name, d.collection, d.duration_ms, d.raw_query_id) == ("shop", "orders.x", 15, 1)
    raw_rows, details = store.read("raw_query"), store.read("raw_query_slow_mongo")
    [hit] = linking.detail_cascade(raw_rows, details, "slow_query_mongo").collect()
    assert (hit.step, hit.data.id) == (1, d.id)
    loose = details.withColumns({"raw_query_id": F.lit(None).cast("long"), "command_json": F.lit("other"), "collection": F.lit("orders")})
    [hit] = linking.detail_cascade(raw_rows, loose, "slow_query_mongo").collect()
    assert hit.step == 4


def test_refused_files(store, tmp_path):
    for name, rows, said in (("maxElapsedX.csv", [{"host": "a", "db_name": "b"}], "query_final"), ("whatever.csv", [{"a": 1}], "name"), ("deadlocksX.csv", [{"host": "a"}], "deadlock")):
        with pytest.raises(ingest.Invalid, match=said):
            ingest.ingest_file(store, write(tmp_path, name, rows))
    assert store.read("raw_query").count() == 0


def test_null_rate_warning(spark, tmp_path):
    df = csv.read_file(spark, write(tmp_path, "maxElapsedProd.csv", [{"host": h, "db_name": "d", "query_final": "q"} for h in ("a", "", "")]))
    verdict = ingest.validate(df, "slow_query_sql", "prod")
    assert verdict.is_valid and verdict.null_rates["host"] == 0.6667 and any("66.7%" in w for w in verdict.warnings)


def test_folder(store, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder, "maxElapsedProd.csv", SLOW)
    write(folder, "other.csv", [{"a": 1}])
    write(folder, "blockersSat.csv", SESSIONS)
    assert [o.file_name for o in ingest.ingest_path(store, f"file://{folder}")] == ["blockersSat.csv", "maxElapsedProd.csv"]


def test_export(spark, store, tmp_path):
    ingest.ingest_file(store, write(tmp_path, "maxElapsedProd.csv", SLOW))
    out = tmp_path / "out"
    csv.write_export(browse.export_rows(store.read("raw_query"), store.read("curated_query"), store.read("pattern_label")).coalesce(1), f"file://{out}")
    data = b"".join(p.read_bytes() for p in out.glob("part-*"))
    assert data.startswith(",".join(browse.EXPORT_COLUMNS).encode() + b"\r\n") and data.count(b"\r\n") == 3
    csv.write_export(browse.export_rows(store.read("raw_query").where("id < 0"), store.read("curated_query"), store.read("pattern_label")).coalesce(1), f"file://{tmp_path}/none")
    assert b"".join(p.read_bytes() for p in (tmp_path / "none").glob("part-*")).count(b"\r\n") == 1


def test_maintenance(store, tmp_path):
    ingest.ingest_file(store, write(tmp_path, "maxElapsedProd.csv", SLOW))
    store.write("pattern_label", curation.create_label(store.read("pattern_label"), "Keep"))
    counts = {r.table: r.rows for r in store.status().collect()}
    assert counts["raw_query"] == 2 and counts["pattern_label"] == 1
    ingest.ingest_file(store, write(tmp_path, "maxElapsedProd.csv", SLOW))  # replaces the files of the first intake
    assert store.vacuum("raw_query") >= 1 and store.read("raw_query").count() == 2
    assert store.cached("raw_query").count() == 2
    store.partial_reset()
    assert store.read("raw_query").count() == 0 and store.read("pattern_label").count() == 1
    with pytest.raises(ValueError, match="unknown table"):
        store.read("nope")


def test_curation(store, tmp_path):
    ingest.ingest_file(store, write(tmp_path, "maxElapsedProd.csv", SLOW))
    raw = store.read("raw_query")
    labels = curation.create_label(curation.create_label(store.read("pattern_label"), "B"), "A", severity="info")
    assert [r.name for r in curation.list_labels(labels).collect()] == ["A", "B"]
    curated = curation.create_curated(store.read("curated_query"), raw, 1, label_id=1, notes="n")
    with pytest.raises(curation.Conflict):
        curation.create_curated(curated, raw, 1)
    with pytest.raises(curation.NotFound):
        curation.create_curated(curated, raw, 99)
    with pytest.raises(curation.Conflict):
        curation.delete_label(labels, curated, 1)
    assert curation.delete_label(labels, curated, 2).count() == 1
    assert curation.get_curated(curation.update_curated(curated, 1, notes="m"), 1).notes == "m"
    [row] = browse.list_curated(curated, raw, labels).collect()
    assert (row.label_name, row.notes) == ("B", "n")
    [cov] = analytics.curation_coverage(raw, curated).collect()
    assert (cov.total_rows, cov.curated_rows, cov.coverage_pct) == (2, 1, 50.0)
    seeds = store.spark.createDataFrame([("A", "critical", "d", "sql"), ("C", "bad", "d", "both")], "name string, severity string, description string, source string")
    seeded = {r.name: r for r in curation.seed_labels(labels, seeds).collect()}
    assert seeded["A"].severity == "critical" and seeded["C"].id == 3 and seeded["C"].severity == "warning"
    spl = curation.create_spl(store.read("spl_query"), "s", "custom", "index=x")
    assert [r.query_type for r in curation.spl_types(spl).collect()] == [*curation.DEFAULT_SPL_TYPES, "custom"]


def test_streaming(spark, store, tmp_path):
    from dbpulse.streaming import ingest as stream

    folder = tmp_path / "arrivals"
    folder.mkdir()
    write(folder, "maxElapsedProd.csv", SLOW)
    for _ in range(2):
        q = stream.start(store, f"file://{folder}", list(SLOW[0]), f"file://{tmp_path}/check")
        q.awaitTermination(120)
    assert store.read("raw_query").count() == 2 and store.read("upload_log").count() == 1


class Lost(Exception):
    pass


def failing(store, at):
    """The store, failing at its ``at``-th commit."""
    commit, left = store.commit, [at]

    def once(table, *what):
        left[0] -= 1
        if left[0] == 0:
            raise Lost(table)
        return commit(table, *what)

    store.commit = once
    return commit


@pytest.mark.parametrize("at", [1, 2, 3, 4, 5, 6])
def test_an_intake_that_failed_between_writes_counts_once(spark, tmp_path, at):
    store = Store(spark, f"file://{tmp_path}/store", buckets=4)
    store.create_all()
    files = [write(tmp_path, "maxElapsedProd.csv", SLOW), write(tmp_path, "blockersSat.csv", SESSIONS)]
    take = lambda: ingest.ingest_frames(store, [(csv.read_file(spark, p), p.rsplit("/", 1)[-1]) for p in files], only_once=True)
    whole = failing(store, at)
    with pytest.raises(Lost):
        take()
    store.commit = whole
    outcomes = take()
    if at <= 4:  # the log is the fourth write; what fails after it is the linking, which is repeated with the next intake
        assert [(o.inserted, o.updated, o.detail_inserted, o.detail_updated) for o in outcomes] == [(2, 0, 2, 0), (2, 0, 2, 0)]
    else:
        assert outcomes == []
    assert [r.occurrence_count for r in store.read("raw_query").collect()] == [1] * 4
    assert sorted(r.id for r in store.read("raw_query").collect()) == [1, 2, 3, 4]
    assert store.read("upload_log").count() == 2 and sorted(r.id for r in store.read("upload_log").collect()) == [1, 2]
    # a later intake of the same names isn't mistaken for the failed one
    ingest.ingest_frames(store, [(csv.read_file(spark, files[0]), "maxElapsedProd.csv")], step="maxElapsedProd.csv\nblockersSat.csv")
    assert sorted(r.occurrence_count for r in store.read("raw_query").collect()) == [1, 1, 2, 2]


def test_a_folder_is_one_rewrite_of_each_table(spark, store, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder, "blockersSat.csv", SESSIONS)
    write(folder, "maxElapsedProd1.csv", SLOW)
    write(folder, "maxElapsedProd2.csv", SLOW[:1] + [SLOW[0] | {"host": "H9"}])
    before = store.version("raw_query").number
    got = ingest.ingest_path(store, f"file://{folder}")
    assert store.version("raw_query").number == before + 1
    assert [(o.file_name, o.rows, o.inserted, o.updated, o.detail_inserted, o.detail_updated) for o in got] == [("blockersSat.csv", 2, 2, 0, 2, 0), ("maxElapsedProd1.csv", 2, 2, 0, 2, 0), ("maxElapsedProd2.csv", 2, 1, 1, 1, 1)]
    rows = {r.host: r for r in store.read("raw_query").where("type = 'slow_query'").collect()}
    assert {h: r.occurrence_count for h, r in rows.items()} == {"H1": 2, "H2": 1, "H9": 1}
    assert sorted(r.id for r in store.read("raw_query").collect()) == [1, 2, 3, 4, 5]
    assert {r.filename: (r.inserted, r.updated) for r in store.read("upload_log").collect()} == {"blockersSat.csv": (2, 0), "maxElapsedProd1.csv": (2, 0), "maxElapsedProd2.csv": (1, 1)}
    with pytest.raises(ingest.Invalid):  # nothing of a folder with an invalid file is taken in
        write(folder, "maxElapsedBad.csv", [{"host": "a"}])
        ingest.ingest_path(store, f"file://{folder}")
    assert store.read("raw_query").count() == 5 and store.read("upload_log").count() == 3


def test_markers_name_the_newest_snapshot(spark, store):
    label = lambda name: curation.create_label(store.read("pattern_label"), name)
    store.write("pattern_label", label("one"))
    store.write("pattern_label", label("two"), "step")
    store.write("pattern_label", label("three"), "step")  # has been done already
    assert {r.name for r in store.read("pattern_label").collect()} == {"one", "two"}
    assert {r.name for r in store.before("pattern_label", "step").collect()} == {"one"}
    assert store.vacuum("pattern_label") == 1 and store.tokens("pattern_label") == {"step"}
    assert {r.name for r in store.read("pattern_label").collect()} == {"one", "two"}
    # a snapshot without a marker, as a failed write leaves it, isn't read
    spark.range(3).selectExpr("id", "'x' as name").write.parquet(f"{store.root}/pattern_label/half")
    assert store.read("pattern_label").count() == 2


def test_migration_of_stored_tables(spark, store, monkeypatch):
    with monkeypatch.context() as m:
        m.setitem(schemas.TABLES, "pattern_label", "id int, name string, gone int")
        store.write("pattern_label", spark.createDataFrame([(1, "a", 5)], "id int, name string, gone int"))
    assert store.migrate("pattern_label") and not store.migrate("pattern_label")
    [row] = store.read("pattern_label").collect()
    assert (row.id, row.name, row.severity) == (1, "a", None) and "gone" not in store.read("pattern_label").columns


def test_single_query(spark, store, tmp_path):
    ingest.ingest_file(store, write(tmp_path, "maxElapsedProd.csv", SLOW))
    raw = store.read("raw_query")
    curated = curation.create_curated(store.read("curated_query"), raw, 1)
    assert browse.get_query(raw, curated, 1).first().curated_id == 1 and browse.get_query(raw, curated, 2).first().curated_id is None
    assert browse.get_query(raw, curated, 9).count() == 0


def test_export_keeps_white_space_and_line_breaks(spark, tmp_path):
    texts = [" lead", "tail ", 'a "quoted", text', "two\nlines", "win\r\ndows", ",", "plain"]
    csv.write_export(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), f"file://{tmp_path}/out")
    back = csv.read_declared(spark, f"file://{tmp_path}/out", ["id", "text"])
    assert {int(r.id): r.text for r in back.collect()} == dict(enumerate(texts))


def test_hourly_windows_drop_what_is_late(spark, tmp_path):
    from dbpulse.streaming import ingest as stream

    folder = tmp_path / "rows"
    folder.mkdir()

    def arrive(n, *rows):
        spark.createDataFrame(list(rows), "time string, type string, occurrence_count long").coalesce(1).write.json(f"file://{folder}/{n}")

    arrive(0, ("2026-02-01 10:05:00", "blocker", 2), ("2026-02-01T10:59:00.000+0800", "blocker", 3), ("2026-02-01 11:00:00", "deadlock", 1))
    rows = spark.readStream.schema("time string, type string, occurrence_count long").json(f"file://{folder}/*")
    query = lambda: stream.hourly(rows).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start().awaitTermination(120)
    query()
    arrive(1, ("2026-02-01 15:00:00", "blocker", 1))
    query()
    arrive(2, ("2026-02-01 10:30:00", "blocker", 100), ("2026-02-02 00:00:00", "blocker", 1))  # the first is too late
    query()
    got = {(str(r.start), r.type): (r.occurrences, r.rows) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got[("2026-02-01 10:00:00", "blocker")] == (5, 2) and got[("2026-02-01 11:00:00", "deadlock")] == (1, 1)


def test_a_folder_whose_valid_files_are_taken_in(spark, store, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    write(folder, "maxElapsedProd.csv", SLOW)
    (folder / "maxElapsedSat.csv").write_text("host,db_name,query_final\nh1,d,q\nh2,d\nh3,d,q,more\n")
    write(folder, "blockersBad.csv", [{"host": "a"}])
    (folder / "deadlocksEmpty.csv").write_text("")
    write(folder, "nothing known.csv", SLOW)
    with pytest.raises(ingest.Invalid):
        ingest.ingest_path(store, f"file://{folder}")
    assert store.read("raw_query").count() == 0
    got = {o.file_name: o for o in ingest.ingest_path(store, f"file://{folder}", valid_only=True)}
    assert {n: (o.rows, o.inserted, o.malformed) for n, o in got.items()} == {"maxElapsedProd.csv": (2, 2, 0), "maxElapsedSat.csv": (3, 3, 2)}
    groups = [ingest.Group(csv.read_split(spark, [f"file://{folder}/blockersBad.csv"], ["host"]), "blocker")]
    outcomes, bad = ingest.ingest_groups(store, groups, ["blockersBad.csv", "deadlocksEmpty.csv"], valid_only=True)
    assert outcomes == [] and {n: r.is_valid for n, r in bad.items()} == {"blockersBad.csv": False, "deadlocksEmpty.csv": False}
    assert store.read("raw_query").count() == 5 and store.read("upload_log").count() == 2


def test_the_number_of_jobs_does_not_follow_the_files(spark, store, tmp_path):
    def jobs(n):
        folder = tmp_path / f"f{n}"
        folder.mkdir()
        for i in range(n):
            write(folder, f"maxElapsedProd{n}x{i}.csv", [SLOW[0] | {"host": f"H{n}x{i}"}])
        group = f"files-{n}"
        spark.sparkContext.setJobGroup(group, "")
        ingest.ingest_path(store, f"file://{folder}")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    few, many = jobs(2), jobs(9)
    assert abs(many - few) <= 6  # adaptive execution may add a job for a stage


def test_two_intakes_at_once_share_no_id(spark, store, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    files = [write(tmp_path, f"maxElapsedProd{i}.csv", [r | {"host": f"{r['host']}-{i}"} for r in SLOW] + SLOW) for i in range(2)]
    stores = [Store(spark, store.root, buckets=4) for _ in files]
    with ThreadPoolExecutor(2) as pool:
        outs = list(pool.map(ingest.ingest_file, stores, files))
    rows = store.read("raw_query").collect()
    assert len(rows) == len({r.id for r in rows}) == len({r.query_hash for r in rows}) == 6
    assert sum(r.occurrence_count for r in rows) == 8 and {o.rows for o in outs} == {4}
    assert {r.filename for r in store.read("upload_log").collect()} == {"maxElapsedProd0.csv", "maxElapsedProd1.csv"}
    linked = {r.host: r.raw_query_id for r in store.read("raw_query_slow_sql").where("host like 'H1%'").collect()}
    assert linked == {r.host: r.id for r in rows if r.host.startswith("H1")} and len(linked) == 3
