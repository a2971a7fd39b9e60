"""From files to the tables: read, validate, project, deduplicate, upsert, log, link.

Files that come together are united by kind and header and taken in at once: every
file is read once, and of every table the buckets into which its rows fall are
written once, however many files there are.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kinds import environment_of, file_category
from ..functions.times import month_of
from ..operators import linking, merge
from ..operators.validation import Report, facts_of_files, own_columns, report, validate  # noqa: F401
from ..schemas import DETAILS
from ..sources import csv, layouts
from ..sources.store import Store

FILE_BITS = 47  # a file's rows are numbered below this bit, files above it
TRIES = 8  # of a write that others got in the way of


class Invalid(ValueError):
    def __init__(self, report: Report):
        super().__init__("; ".join(report.errors))
        self.report = report


@dataclass
class Outcome:
    file_name: str
    file_type: str
    environment: str
    rows: int
    inserted: int
    updated: int
    detail_inserted: int
    detail_updated: int
    malformed: int = 0  # rows that don't fit the header; they are taken in as far as they go


def name_facts(spark: SparkSession, name: str) -> tuple[str, str]:
    """(category, environment) that a file's name tells."""
    row = spark.range(1).select(file_category(F.lit(name)).alias("c"), environment_of(F.lit(name)).alias("e")).first()
    return row.c, row.e


def extract(df: DataFrame, category: str) -> tuple[DataFrame, DataFrame] | None:
    """The common rows and the detail rows of a file; None for an unknown kind."""
    if category not in layouts.BY_CATEGORY:
        return None
    common, detail, _ = layouts.BY_CATEGORY[category]
    return common(df), detail(df)


def upload_row(uploads: DataFrame, outcome: Outcome, common: DataFrame, place: int = 1) -> DataFrame:
    """The log's row of a file, the ``place``-th that is added; its month is that of the first row's time."""
    first = common.agg(F.min_by("time", "seq").alias("time"))
    last = uploads.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    now = dt.datetime.now(dt.UTC).isoformat()
    return first.crossJoin(F.broadcast(last)).select(
        (F.col("last") + place).alias("id"), F.lit(outcome.file_name).alias("filename"), F.lit(outcome.file_type).alias("file_type"), F.lit(outcome.environment).alias("environment"), month_of(F.col("time")).alias("month_year"),
        F.lit(outcome.rows).cast("long").alias("csv_row_count"), F.lit(outcome.inserted).cast("long").alias("inserted"), F.lit(outcome.updated).cast("long").alias("updated"), F.lit(now).alias("uploaded_at"),
    )


@dataclass(frozen=True)
class Group:
    """Files of one kind and one header: their rows, with ``file_name`` and ``seq``."""

    rows: DataFrame
    category: str


def ingest_file(store: Store, path: str, only_once: bool = False) -> Outcome | None:
    """Takes a file in. With ``only_once`` a file that is logged already is left alone and None returned."""
    df = csv.read_file(store.spark, path)
    return ingest_frame(store, df, path.rstrip("/").rsplit("/", 1)[-1], only_once)


def ingest_frame(store: Store, df: DataFrame, name: str, only_once: bool = False, step: str = "") -> Outcome | None:
    return next(iter(ingest_frames(store, [(df, name)], only_once, step)), None)


def ingest_frames(store: Store, files: Sequence[tuple[DataFrame, str]], only_once: bool = False, step: str = "") -> list[Outcome]:
    """Takes files in, in this order, each table being written once. Nothing is written if any of them is invalid.

    ``step`` names the intake. An intake that failed between two of its writes can be repeated under the same name:
    what it has written stays, so that no occurrence counts twice. With ``only_once`` the files' names are such a name.
    """
    kinds = names_facts(store.spark, [name for _, name in files])
    groups = [Group(df.withColumn("file_name", F.lit(name)), kinds[name][0]) for df, name in files]
    return ingest_groups(store, groups, [name for _, name in files], only_once, step)[0]


def names_facts(spark: SparkSession, names: Sequence[str]) -> dict[str, tuple[str, str]]:
    """(category, environment) that each file's name tells."""
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", file_category(F.col("name")).alias("c"), environment_of(F.col("name")).alias("e"))
    return {r.name: (r.c, r.e) for r in rows.collect()}


def ingest_groups(store: Store, groups: Sequence[Group], names: Sequence[str], only_once: bool = False, step: str = "", valid_only: bool = False) -> tuple[list[Outcome], dict[str, Report]]:
    """Takes in files by their groups, in the order of their names; the number of jobs follows the groups, not the files.

    Returns what became of each file, and the reports of invalid ones. Without ``valid_only`` an invalid file stops all.
    """
    if only_once:
        logged = {r.filename for r in store.read("upload_log").where(F.col("filename").isin(list(names))).select("filename").collect()}
        names = [n for n in names if n not in logged]
        step = step or "\n".join(names)
    if not names:
        return [], {}
    token = _token(store, step) if step else ""
    kinds = names_facts(store.spark, names)
    seen = [facts_of_files(g.rows, g.category) for g in groups]
    reports, broken = {}, {}
    for name in names:
        category, environment = kinds[name]
        g, facts = next(((g, s[name]) for g, s in zip(groups, seen, strict=True) if name in s), (None, {"__rows": 0}))
        broken[name] = facts.get("__malformed", 0)
        reports[name] = report(own_columns(g.rows) if g else [], facts, category, environment, [])
    bad = {n: r for n, r in reports.items() if not r.is_valid}
    if bad and not valid_only:
        raise Invalid(next(iter(bad.values())))
    names = [n for n in names if n not in bad]
    if not names:
        return [], bad
    # a file's rows keep their order, and files theirs
    numbers = F.broadcast(store.spark.createDataFrame(list(enumerate(names)), "__file long, file_name string"))
    commons, by_kind = [], {}
    for g in groups:
        if pair := extract(g.rows.join(numbers, "file_name").withColumn("seq", F.col("seq") + F.shiftleft("__file", FILE_BITS)).drop("__file"), g.category):
            commons.append(pair[0])
            by_kind.setdefault(g.category, []).append(pair[1])
    now = F.current_timestamp()
    # every file is read and parsed once; all that follows starts from the staged rows
    staged = {"raw_query": store.stage("raw_query", merge.keyed(reduce(DataFrame.unionByName, commons)))}
    for kind, parts in by_kind.items():
        table = layouts.BY_CATEGORY[kind][2]
        staged[table] = store.stage(table, merge.keyed_details(reduce(DataFrame.unionByName, parts)))
    counts = {t: _counts(store.before(t, token, s.buckets), s.rows) for t, s in staged.items()}
    months = {r.file: r.month for r in staged["raw_query"].rows.groupBy(F.shiftright("seq", FILE_BITS).alias("file")).agg(month_of(F.min_by("time", "seq")).alias("month")).collect()}  # a row per file
    for table, rows in staged.items():
        settle = merge.settled if table == "raw_query" else merge.settled_details
        store.rewrite(table, rows, lambda old, new, t=table, f=settle: _upserted(store, t, old, f(new, now), token), token, TRIES)
    outcomes = []
    for i, name in enumerate(names):
        kind, environment = kinds[name]
        outcomes.append(Outcome(name, kind, environment, reports[name].row_count, *counts["raw_query"].get(i, (0, 0)), *counts[layouts.BY_CATEGORY[kind][2]].get(i, (0, 0)), broken[name]))
    _log(store, outcomes, months, token)
    for kind in by_kind:
        link_details(store, kind)
    return outcomes, bad


def _upserted(store: Store, table: str, old: DataFrame, new: DataFrame, token: str) -> DataFrame:
    """The next rows of the buckets touched, with ids that no other writer gets."""
    fresh = new.select("query_hash").join(old.select("query_hash"), "query_hash", "left_anti").count()
    return merge.upsert(old, new, after=store.reserve_ids(table, fresh, token))


def _log(store: Store, outcomes: list[Outcome], months: dict[int, str | None], token: str) -> None:
    """Logs the files in place of earlier rows of the same names."""
    if token and token in store.tokens("upload_log"):
        return
    first, now = store.reserve_ids("upload_log", len(outcomes), token), dt.datetime.now(dt.UTC).isoformat()
    rows = [(first + i, o.file_name, o.file_type, o.environment, months.get(i - 1), o.rows, o.inserted, o.updated, now) for i, o in enumerate(outcomes, 1)]
    store.rewrite("upload_log", store.spark.createDataFrame(rows, store.schema("upload_log")), lambda old, new: merge.replace_by_key(old, new, "filename"), token, TRIES)


def _token(store: Store, step: str) -> str:
    """The token of an intake's writes. The log is written last, so a token that it bears is of an intake that ended, and the next one has another."""
    name, done = hashlib.md5(step.encode()).hexdigest(), store.tokens("upload_log")
    return next(t for i in range(len(done) + 1) if (t := f"{name}-{i}") not in done)


def _counts(old: DataFrame, keyed: DataFrame) -> dict[int, tuple[int, int]]:
    """(inserted, updated) by the number of the file."""
    found = merge.accounting_by(old, keyed.withColumn("file", F.shiftright("seq", FILE_BITS)), "file").collect()  # a row per file
    return {r.file: (r.inserted, r.updated) for r in found}


def link_details(store: Store, category: str, blank_is_null: bool = False) -> None:
    """Links detail rows that have no common row yet; only the buckets of those that find one are written."""
    kind = {"slow_query_sql": "slow_query"}.get(category, category)
    table = DETAILS[kind][0]
    raw, details = store.read("raw_query"), store.read(table).where("raw_query_id is null")
    linked = linking.link(details, raw, kind, blank_is_null)
    if kind == "slow_query_mongo":
        linked = linking.link_by_hash(linked, raw.where(F.col("type") == kind))
    staged = store.stage(table, linked.where("raw_query_id is not null").select("query_hash", F.col("raw_query_id").alias("__link")))
    if staged.buckets:
        store.rewrite(table, staged, _with_links, tries=TRIES)


def _with_links(old: DataFrame, links: DataFrame) -> DataFrame:
    both = old.join(links.withColumnRenamed("query_hash", "__key"), F.col("query_hash") == F.col("__key"), "left")
    return both.withColumn("raw_query_id", F.coalesce("raw_query_id", "__link")).select(*old.columns)


def ingest_path(store: Store, path: str, only_once: bool = False, valid_only: bool = False) -> list[Outcome]:
    """Takes in a file, or every known CSV file of a folder at once; with ``valid_only`` the valid ones of them."""
    found = csv.list_files(store.spark, path)
    by_header: dict[tuple, list[str]] = {}
    for p, kind in found:
        by_header.setdefault((kind, *csv.header(store.spark, p)), []).append(p)
    groups = [Group(csv.read_split(store.spark, paths, list(columns)), kind) for (kind, *columns), paths in by_header.items() if columns]
    return ingest_groups(store, groups, [p.rsplit("/", 1)[-1] for p, _ in found], only_once, valid_only=valid_only)[0]
