"""The analytics, each a function of tables and filters that returns one lazy DataFrame.

Filters reach the scan; roll-ups happen in the plan; orders are total, so limits
and ties are the same on every run. The sums by environment, type, source, host,
database and month (``summary``, ``by_host``, ``by_db``, ``by_month``, ``co_occurrence``)
also take a kept roll-up in place of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NO_BODY, folded, has_body, without_header
from ..functions.times import event_time
from . import filters

FILE_TYPES = {"blocker": "blocker", "deadlock": "deadlock", "slow_query": "slow_query_sql", "slow_query_mongo": "slow_query_mongo"}


def _bounded(name: str, value: int, most: int) -> int:
    if not 1 <= value <= most:
        raise ValueError(f"{name} is 1 to {most}")
    return value


def _weights(df: DataFrame) -> tuple[Column, Column]:
    """(rows, occurrences) that a row stands for: itself, or those of a roll-up's group."""
    return (F.col("row_count"), F.col("total_occurrences")) if "row_count" in df.columns else (F.lit(1), F.col("occurrence_count"))


def _sums(df: DataFrame, *keys: str) -> DataFrame:
    rows, occurrences = _weights(df)
    return df.groupBy(*keys).agg(F.sum(rows).cast("long").alias("row_count"), F.sum(occurrences).cast("long").alias("total_occurrences"))


def summary(raw: DataFrame, **where) -> DataFrame:
    """Rows and occurrences by environment, type and source."""
    out = _sums(filters.analytics(raw, **where), "environment", "type", "source")
    return out.orderBy(*[F.asc_nulls_last(c) for c in ("environment", "type", "source")])


def by_host(raw: DataFrame, top_n: int = 20, **where) -> DataFrame:
    rows = filters.analytics(raw, **where).where("host is not null")
    out = _sums(rows, "host", "environment")
    return out.orderBy(F.desc("total_occurrences"), "host", F.asc_nulls_last("environment")).limit(_bounded("top_n", top_n, 100))


def by_db(raw: DataFrame, top_n: int = 20, **where) -> DataFrame:
    rows = filters.given(filters.analytics(raw, **where), "db_name")
    out = _sums(rows, "db_name", "source")
    return out.orderBy(F.desc("total_occurrences"), "db_name", F.asc_nulls_last("source")).limit(_bounded("top_n", top_n, 100))


def by_month(raw: DataFrame, **where) -> DataFrame:
    """Months with their change from the month before among those shown."""
    rows = filters.analytics(raw, **where).where("month_year is not null")
    weight, occurrences = _weights(rows)
    of = lambda name: F.coalesce(F.sum(F.when(F.col("environment") == name, weight)), F.lit(0)).cast("long").alias(f"{name}_count")
    months = rows.groupBy("month_year").agg(F.sum(weight).cast("long").alias("row_count"), F.sum(occurrences).cast("long").alias("total_occurrences"), of("prod"), of("sat"))
    order = Window.orderBy("month_year")  # one row per month
    delta = lambda c: F.col(c) - F.lag(c).over(order)
    return months.select("month_year", "row_count", "total_occurrences", delta("row_count").alias("row_delta"), delta("total_occurrences").alias("occ_delta"), "prod_count", "sat_count").orderBy("month_year")


def by_month_type(raw: DataFrame, uploads: DataFrame, environment: str | None = None) -> DataFrame:
    """Rows of the latest upload of each file by month and kind, beside the month's patterns."""
    env = environment.lower() if environment else None
    patterns = filters.analytics(raw, environment=env).where("month_year is not null").groupBy("month_year").agg(F.count("*").alias("total_patterns"))
    latest = Window.partitionBy("filename").orderBy(F.expr("try_cast(uploaded_at as timestamp)").desc_nulls_last(), F.desc("id"))
    files = uploads.where("month_year is not null")
    files = (files if env is None else files.where(F.col("environment") == env)).withColumn("rn", F.row_number().over(latest)).where("rn = 1")
    total = lambda name, test: F.sum(F.when(test, F.col("csv_row_count"))).cast("long").alias(name)
    kinds = [total(k, F.col("file_type") == v) for k, v in FILE_TYPES.items()]
    split = [total(f"{k}_{e}", (F.col("file_type") == v) & (F.col("environment") == e)) for e in ("prod", "sat") for k, v in FILE_TYPES.items()]
    pivot = files.groupBy("month_year").agg(*kinds, *split, F.sum("csv_row_count").cast("long").alias("total_file_rows"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    both = patterns.join(pivot, "month_year", "full_outer")
    names = list(FILE_TYPES)
    return both.select(
        "month_year", *map(zero, names), "total_file_rows", zero("total_patterns"), *[zero(f"{k}_{e}") for e in ("prod", "sat") for k in names]
    ).orderBy(F.desc("month_year"))


def month_type_deltas(months: DataFrame) -> DataFrame:
    """Each kind's change from the month before."""
    order = Window.orderBy("month_year")
    return months.select("month_year", *[(F.col(k) - F.lag(k).over(order)).alias(f"{k}_delta") for k in FILE_TYPES]).orderBy("month_year")


def curation_coverage(raw: DataFrame, curated: DataFrame, **where) -> DataFrame:
    """How many rows have a curated record."""
    rows = filters.analytics(raw, **where).select("id")
    marks = curated.select("raw_query_id", F.col("id").alias("curated_id"))
    both = rows.join(marks, rows["id"] == marks["raw_query_id"], "left").agg(F.count("*").alias("total_rows"), F.count("curated_id").alias("curated_rows"))
    share = F.when(F.col("total_rows") > 0, F.round(F.col("curated_rows") / F.col("total_rows") * 100, 4)).otherwise(0.0)
    return both.select("total_rows", "curated_rows", (F.col("total_rows") - F.col("curated_rows")).alias("uncurated_rows"), share.alias("coverage_pct"))


def _timed(raw: DataFrame, week_start, week_end, where: dict) -> DataFrame:
    """Rows with their time ``at``, null where it can't be read: a filter here would read every time once more."""
    rows = filters.analytics(raw, **where).where("time is not null").withColumn("at", event_time(F.col("time")))
    return filters.in_week(rows, F.col("at"), week_start, week_end)


def by_hour(raw: DataFrame, week_start=None, week_end=None, **where) -> DataFrame:
    """Heatmap cells that aren't empty: occurrences, by type, and the five top hosts and databases.

    One pass: a row for each value of each dimension, ranked within its cell.
    """
    dims = {"type": "unknown", "host": "", "db_name": ""}
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("dim"), F.coalesce(c, F.lit(other)).alias("value")) for c, other in dims.items()])).alias("d")
    rows = _timed(raw, week_start, week_end, where).select("at", values, "occurrence_count").where("d.value <> '' or d.dim = 'type'")
    each = rows.groupBy(F.hour("at").alias("hour"), F.weekday("at").alias("weekday"), F.col("d.dim").alias("dim"), F.col("d.value").alias("value"))
    each = each.agg(F.sum("occurrence_count").cast("long").alias("n"), F.max("at").alias("last")).where("last is not null").drop("last")
    rank = Window.partitionBy("hour", "weekday", "dim").orderBy(F.desc("n"), "value")
    kept = each.withColumn("r", F.row_number().over(rank)).where("r <= 5 or dim = 'type'")
    of = lambda dim, what: F.collect_list(F.when(F.col("dim") == dim, what))
    tops = lambda dim, name: F.transform(F.array_sort(of(dim, F.struct("r", "value", "n"))), lambda x: F.struct(x["value"].alias(dim), x["n"].alias("count"))).alias(name)
    return kept.groupBy("hour", "weekday").agg(
        F.sum(F.when(F.col("dim") == "type", F.col("n"))).cast("long").alias("count"),
        F.map_from_entries(F.array_sort(of("type", F.struct(F.col("value").alias("type"), "n")))).alias("by_type"),
        tops("host", "top_hosts"),
        tops("db_name", "top_dbs"),
    ).orderBy("weekday", "hour")


def by_hour_flat(raw: DataFrame, week_start=None, week_end=None, **where) -> DataFrame:
    """The heatmap at its finest grain: hour, weekday, type, host, database."""
    rows = _timed(raw, week_start, week_end, where)
    keys = [F.hour("at").alias("hour"), F.weekday("at").alias("weekday"), F.coalesce("type", F.lit("unknown")).alias("type"), F.coalesce("host", F.lit("")).alias("host"), F.coalesce("db_name", F.lit("")).alias("db_name")]
    return rows.groupBy(*keys).agg(F.sum("occurrence_count").cast("long").alias("count"), F.max("at").alias("last")).where("last is not null").drop("last")


def by_hour_queries(raw: DataFrame, hour: int, weekday: int, limit: int = 50, offset: int = 0, week_start=None, week_end=None, **where) -> DataFrame:
    """A page of a cell's rows, most occurrences first, each with the cell's total."""
    rows = filters.in_cell(_timed(raw, week_start, week_end, where), hour, weekday)
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy(F.desc("occurrence_count"), F.desc("id")).offset(offset).limit(_bounded("limit", limit, 200))
    return page.crossJoin(F.broadcast(total)).select("id", "type", "host", "db_name", "environment", "source", "time", "month_year", "occurrence_count", "query_details", "total")


def _with_text(raw: DataFrame, where: dict) -> DataFrame:
    return filters.given(filters.analytics(raw, **where), "query_details")


def _blank(c: str, other: str = "") -> Column:
    return F.coalesce(c, F.lit(other)).alias(c)


def _siblings(rows: DataFrame, **columns: Column) -> DataFrame:
    """For each database and host the columns of its first whole parametrised statement, in one pass."""
    whole = rows.where(F.col("query_details").like("(@P?%")).withColumn("__body", without_header(F.col("query_details"))).where(~F.col("__body").like("(@p%"))
    first = whole.groupBy(_blank("db_name"), _blank("host")).agg(F.min_by(F.struct(*[c.alias(k) for k, c in columns.items()]), "id").alias("__first"))
    return first.select("db_name", "host", *[F.col("__first")[k].alias(k) for k in columns])


def _shaped(rows: DataFrame, replace_all: bool, *texts: str) -> DataFrame:
    """Rows with their fingerprint, beside ``texts`` the whole text (query_details) and what its sibling lends (lent)."""
    lent = {"recovered": folded(without_header(F.col("query_details")), replace_all)} | {t: F.col("query_details") for t in texts if t == "lent"}
    own = [t for t in texts if t == "query_details"]
    dims = [_blank("type", "unknown"), *map(_blank, ("host", "db_name", "month_year", "environment", "source"))]
    base = rows.select("id", *own, without_header(F.col("query_details")).alias("body"), *dims, "occurrence_count")
    fingerprint = F.when(has_body(F.col("body")), folded(F.col("body"), replace_all)).otherwise(F.coalesce("recovered", F.lit(NO_BODY)))
    return base.join(_siblings(rows, **lent), ["db_name", "host"], "left").withColumn("fingerprint", fingerprint)


def fingerprints(raw: DataFrame, replace_all: bool = False, **where) -> DataFrame:
    """Each row with its fingerprint; a statement cut off within its parameters takes that of a sibling on the same host and database."""
    rows = _shaped(_with_text(raw, where), replace_all, "query_details", "lent")
    sample = F.coalesce(F.when(F.col("body").like("(@p%"), F.col("lent")), F.col("query_details"))
    return rows.select("id", "fingerprint", sample.alias("sample"), "type", "host", "db_name", "month_year", "environment", "source", "occurrence_count")


def top_fingerprints(raw: DataFrame, top_n: int = 20, replace_all: bool = False, **where) -> DataFrame:
    """The statement shapes with the most occurrences, with samples and where they occur.

    Examples are the host and database with the most occurrences, ties by name; the sample is that of the row with
    the most, then the smallest id. Shapes are rolled up by ids alone, so every text is read twice, for its shape and for what it
    lends to others, and whole texts are kept for the winners only. Runs when called.
    """
    dims = ["type", "host", "db_name", "month_year", "environment", "source"]
    rows = _with_text(raw, where)
    base = F.expr("10000000000000000000BD")  # occurrences and id as one number, which aggregates without a sort
    place = F.col("occurrence_count").cast("decimal(18,0)") * base - F.col("id")
    fine = _shaped(rows, replace_all).groupBy("fingerprint", *dims).agg(F.sum("occurrence_count").cast("long").alias("n"), F.count("*").alias("rows"), F.max(place).alias("best"))
    # one pass over all dimensions: a row for each value of each, and one for the total, then one per fingerprint
    values = F.explode(F.array(F.struct(F.lit("").alias("dim"), F.lit("").alias("value")), *[F.struct(F.lit(c).alias("dim"), F.col(c).alias("value")) for c in dims])).alias("d")
    each = fine.select("fingerprint", values, "n", "rows", "best").where("d.value <> '' or d.dim in ('', 'type')").groupBy("fingerprint", F.col("d.dim").alias("dim"), F.col("d.value").alias("value"))
    each = each.agg(F.sum("n").cast("long").alias("n"), F.sum("rows").cast("long").alias("rows"), F.max("best").alias("best"))
    of = lambda dim, what: F.when(F.col("dim") == dim, what)
    names = lambda dim: F.array_sort(F.collect_list(of(dim, F.col("value"))))
    most = lambda dim: F.min(of(dim, F.struct((-F.col("n")).alias("n"), F.col("value").alias("v"))))["v"]
    rolled = each.groupBy("fingerprint").agg(
        F.max(of("", F.col("n"))).alias("count"),
        F.max(of("", F.col("rows"))).alias("row_count"),
        F.max(of("", F.col("best"))).alias("best"),
        F.map_from_entries(F.array_sort(F.collect_list(of("type", F.struct("value", "n"))))).alias("by_type"),
        names("month_year").alias("months"),
        names("environment").alias("environments"),
        most("host").alias("example_host"),
        most("db_name").alias("example_db"),
        F.min(of("source", F.col("value"))).alias("example_source"),
    )
    top = rolled.orderBy(F.desc("count"), "fingerprint").limit(_bounded("top_n", top_n, 200)).withColumn("id", F.pmod(-F.col("best"), base).cast("long")).drop("best")
    # 200 rows at most: their texts are looked up by id, which a scan can use, and those of siblings by database and host
    winners = top.collect()
    found = rows.where(F.col("id").isin([w.id for w in winners])).select("id", "query_details", _blank("host"), _blank("db_name"), without_header(F.col("query_details")).like("(@p%").alias("cut")).collect()
    cut = [r for r in found if r.cut]
    near = rows.where(F.coalesce("host", F.lit("")).isin([r.host for r in cut]) & F.coalesce("db_name", F.lit("")).isin([r.db_name for r in cut]))
    lent = {(r.db_name, r.host): r.lent for r in _siblings(near, lent=F.col("query_details")).collect()} if cut else {}
    sample = {r.id: (lent.get((r.db_name, r.host)) if r.cut else None) or r.query_details for r in found}
    out = [(w.fingerprint, sample[w.id], w["count"], w.row_count, sorted(w.by_type.items()), w.months, w.environments, w.example_host or "", w.example_db or "", w.example_source or "") for w in winners]
    kinds = "fingerprint string, sample_query string, count long, row_count long, by_type array<struct<k: string, n: long>>, months array<string>, environments array<string>, example_host string, example_db string, example_source string"
    return raw.sparkSession.createDataFrame(out, kinds).withColumn("by_type", F.map_from_entries("by_type")).orderBy(F.desc("count"), "fingerprint")


def host_stats(raw: DataFrame, top_n: int = 30, **where) -> DataFrame:
    """Exact percentiles of occurrences per host with at least three rows."""
    rows = filters.analytics(raw, **where).where("host is not null")
    at = lambda q, name: F.round(F.percentile("occurrence_count", F.lit(q)), 1).alias(name)
    out = rows.groupBy("host").agg(at(0.5, "p50"), at(0.95, "p95"), at(0.99, "p99"), F.max("occurrence_count").cast("long").alias("max_occ"), F.sum("occurrence_count").cast("long").alias("total_occurrences"), F.count("*").alias("row_count"))
    return out.where("row_count >= 3").orderBy(F.desc("p95"), F.desc("total_occurrences"), "host").limit(_bounded("top_n", top_n, 200))


BINS = 1_024  # of a histogram


def ranked_percentiles(rows: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(key, one column for each share): exact percentiles of whole numbers, between neighbours in proportion.

    The rank that a share asks for is looked for in a histogram of the key's range, then in one of the bin that holds it, until a
    bin is one number. A round adds up at most ``BINS`` counts for each key and share, whatever the key's number of rows or
    of different values, so no task holds the values of a key with very many. The range decides the rounds: two for a million.
    """
    # integral values only: bins are of whole numbers
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), F.col(value).cast("long").alias("v")).agg(F.count("*").alias("n"))
    low, high = counted.agg(F.min("v"), F.max("v")).first()
    rounds, width = 1, BINS
    while low is not None and width <= high - low:
        rounds, width = rounds + 1, width * BINS
    place = lambda q: F.lit(q) * (F.col("total") - 1)
    want = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), end.alias("end"), f(place(q)).cast("long").alias("rank")) for name, q in shares.items() for end, f in ((F.lit(0), F.floor), (F.lit(1), F.ceil))]))
    totals = counted.groupBy("k").agg(F.sum("n").alias("total"))
    open_ = totals.select("k", "total", want.alias("w")).select("k", "total", "w.*", F.lit(low or 0).cast("long").alias("start"), F.lit(0).cast("long").alias("before"))
    for r in range(rounds):
        width = BINS ** (rounds - 1 - r)
        asked = open_.select("k", "name", "end", "rank", "start", "before")
        bin_ = F.floor((F.col("v") - F.col("start")) / F.lit(width)) if width > 1 else F.col("v") - F.col("start")
        within = counted.join(asked, "k").where((F.col("v") >= F.col("start")) & (F.col("v") - F.col("start") < F.lit(width) * BINS))
        bins = within.groupBy("k", "name", "end", "rank", "start", "before", bin_.cast("long").alias("bin")).agg(F.sum("n").alias("n"))
        upto = F.col("before") + F.sum("n").over(Window.partitionBy("k", "name", "end").orderBy("bin"))  # BINS rows at most
        found = bins.withColumn("upto", upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        open_ = found.select("k", "name", "end", "rank", (F.col("start") + F.col("bin") * F.lit(width)).alias("start"), (F.col("upto") - F.col("n")).alias("before"))
    ends = lambda name, end: F.max(F.when((F.col("name") == name) & (F.col("end") == end), F.col("start")))
    both = open_.groupBy("k").agg(*[ends(name, end).alias(f"{name}_{end}") for name in shares for end in (0, 1)]).join(totals, "k")
    part = lambda name, q: F.when(F.col(f"{name}_0") == F.col(f"{name}_1"), F.col(f"{name}_0").cast("double")).otherwise((F.ceil(place(q)) - place(q)) * F.col(f"{name}_0") + (place(q) - F.floor(place(q))) * F.col(f"{name}_1"))
    return both.select(F.col("k").alias(key), *[part(name, q).alias(name) for name, q in shares.items()])


def host_stats_ranked(raw: DataFrame, top_n: int = 30, digits: int = 1, **where) -> DataFrame:
    """What ``host_stats`` gives, for hosts with any number of rows and of different occurrences."""
    rows = filters.analytics(raw, **where).where("host is not null")
    sums = rows.groupBy("host").agg(F.max("occurrence_count").cast("long").alias("max_occ"), F.sum("occurrence_count").cast("long").alias("total_occurrences"), F.count("*").alias("row_count"))
    ranked = ranked_percentiles(rows, "host", "occurrence_count", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    out = sums.where("row_count >= 3").join(ranked, "host", "left").select("host", *[F.round(c, digits).alias(c) for c in ("p50", "p95", "p99")], "max_occ", "total_occurrences", "row_count")
    return out.orderBy(F.desc("p95"), F.desc("total_occurrences"), "host").limit(_bounded("top_n", top_n, 200))


def co_occurrence(raw: DataFrame, limit: int = 200, both_only: bool = False, **where) -> DataFrame:
    """Blockers and deadlocks by host and month, in one pass."""
    rows = filters.analytics(raw, **where).where(F.col("type").isin("blocker", "deadlock") & F.col("host").isNotNull() & F.col("month_year").isNotNull())
    _, occurrences = _weights(rows)
    part = lambda kind: F.coalesce(F.sum(F.when(F.col("type") == kind, occurrences)), F.lit(0)).cast("long").alias(f"{kind}_count")
    out = rows.groupBy("host", "month_year").agg(part("blocker"), part("deadlock")).withColumn("combined_score", F.col("blocker_count") + F.col("deadlock_count"))
    if both_only:
        out = out.where("blocker_count > 0 and deadlock_count > 0")
    return out.orderBy(F.desc("combined_score"), "host", "month_year").limit(_bounded("limit", limit, 1000))


def kpis(raw: DataFrame, uploads: DataFrame, month_year: str | None = None) -> DataFrame:
    """Distinct hosts and months, and file rows, of one month or all."""
    rows = filters.analytics(raw, month_year=month_year)
    files = filters.analytics(uploads, month_year=month_year)
    hosts = rows.agg(F.countDistinct("host").alias("hosts"), F.countDistinct("month_year").alias("months"))
    return hosts.crossJoin(F.broadcast(files.agg(F.coalesce(F.sum("csv_row_count"), F.lit(0)).cast("long").alias("file_rows"))))
