"""Linking detail rows to common rows: null-safe keys, hash reconstruction, and the lookup cascade."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import joined_hash
from ..schemas import DETAILS

# What must agree for a link, besides the text, by kind.
LINK_KEYS = {
    "slow_query": ("sql", ["environment", "month_year", "host", "db_name"]),
    "blocker": ("sql", ["environment", "month_year"]),
    "deadlock": ("sql", ["environment", "month_year", "host", "db_name"]),
    "slow_query_mongo": ("mongodb", ["environment", "host", "db_name"]),
}


HOT = 1_000  # a key with more than one in so many rows is joined apart; there are fewer such keys than that


def null_safe_first(details: DataFrame, common: DataFrame, pairs: list[tuple[str, str]], out: str = "raw_query_id", blank_is_null: bool = False) -> DataFrame:
    """Detail rows with the smallest id of the common rows whose keys are equal, nulls being equal to nulls.

    Keys are joined by one SHA-256 of them all, made where the rows are read, so no text is shuffled for its own sake. The
    common side is one row per key before the join, so nothing fans out. Keys that many details share are found by a
    count first, and joined by sending these few to every task, so no task gets all rows of one key.
    """
    value = lambda c: F.nullif(c, F.lit("")) if blank_is_null else c
    digest = lambda df, names: F.unhex(F.sha2(F.to_json(F.struct(*[value(df[c]).cast("string").alias(f"k{i}") for i, c in enumerate(names)])), 256))  # noqa: E731  nulls are left out, so they differ from empty texts
    least = common.select(digest(common, [b for _, b in pairs]).alias("__key"), "id").groupBy("__key").agg(F.min("id").alias("__id"))
    keyed = details.withColumn("__own", digest(details, [a for a, _ in pairs]))
    total = keyed.agg(F.count("*").alias("__total"))
    counts = keyed.groupBy(F.col("__own").alias("__hot")).agg(F.count("*").alias("__n"))
    hot = F.broadcast(counts.crossJoin(F.broadcast(total)).where(F.col("__n") * HOT > F.col("__total")).select("__hot"))
    marked = keyed.join(hot, F.col("__own") == F.col("__hot"), "left")
    few = least.join(hot, F.col("__key") == F.col("__hot"), "left_semi")  # no more rows than there are hot keys
    joined = marked.where("__hot is null").join(least, F.col("__own") == F.col("__key"), "left").unionByName(marked.where("__hot is not null").join(F.broadcast(few), F.col("__own") == F.col("__key"), "left"))
    link = F.coalesce(out, "__id") if out in details.columns else F.col("__id")
    return joined.withColumn(out, link).drop("__id", "__key", "__own", "__hot")


def link(details: DataFrame, raw: DataFrame, kind: str, blank_is_null: bool = False) -> DataFrame:
    """Sets raw_query_id where it is null and a common row of the kind agrees."""
    source, keys = LINK_KEYS[kind]
    text = DETAILS[kind][1]
    common = raw.where((F.col("type") == kind) & (F.col("source") == source))
    return null_safe_first(details, common, [*[(k, k) for k in keys], (text, "query_details")], blank_is_null=blank_is_null)


def link_by_hash(details: DataFrame, raw: DataFrame) -> DataFrame:
    """Sets what is still null by the key that host, database, environment and text give."""
    own = raw.select(joined_hash(*[F.col(c) for c in ("host", "db_name", "environment", "query_details")]).alias("__hash"), "id").groupBy("__hash").agg(F.min("id").alias("__id"))
    joined = details.join(own, F.col("query_hash") == F.col("__hash"), "left")
    return joined.withColumn("raw_query_id", F.coalesce("raw_query_id", "__id")).drop("__hash", "__id")


def link_by_text(details: DataFrame, raw: DataFrame, text_col: str) -> DataFrame:
    """Sets what is still null by text alone: the smallest id of each text."""
    return null_safe_first(details, raw.where("query_details is not null"), [(text_col, "query_details")])


def coverage(details: dict[str, DataFrame]) -> DataFrame:
    """Per detail table, rows linked and in all."""
    parts = [df.agg(F.lit(name).alias("table"), F.count("raw_query_id").alias("linked"), F.count("*").alias("total")) for name, df in details.items()]
    return reduce(DataFrame.unionByName, parts).withColumn("share", F.when(F.col("total") > 0, F.round(F.col("linked") / F.col("total"), 4)).otherwise(0.0))


def text_coverage(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """How many distinct texts both sides share, and how many only one has."""
    x, y = (df.select(F.col(c).alias("t")).where("t is not null").distinct() for df, c in ((left, a), (right, b)))
    both = x.withColumn("x", F.lit(1)).join(y.withColumn("y", F.lit(1)), "t", "full_outer")
    return both.agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("shared"), F.count_if(F.col("y").isNull()).alias("left_only"), F.count_if(F.col("x").isNull()).alias("right_only"))


def detail_cascade(raw: DataFrame, details: DataFrame, kind: str) -> DataFrame:
    """(id, type, step, data): the detail of each common row of a kind, by the first step that finds one.

    Steps: the link; the exact text; for document stores also the reconstructed key, then collection with
    environment and, where given, host and database, most occurrences first. Ties go to the smallest detail id.
    Data is null where no step finds any; the raw graph text isn't part of it.
    """
    text = DETAILS[kind][1]
    rows = raw.where(F.col("type") == kind).select("id", "type", "host", "db_name", "environment", "query_details")
    given = F.col("query_details").isNotNull() & (F.col("query_details") != "")
    # each step first leaves one detail id per key, so nothing fans out, and sees only what the steps before left open
    least = lambda c: details.groupBy(F.col(c).alias("__key")).agg(F.min("id").alias("__found"))
    steps = [(F.col("id"), least("raw_query_id")), (F.when(given, F.col("query_details")), least(text))]
    if kind == "slow_query_mongo":
        key = joined_hash(*[F.col(c) for c in ("host", "db_name", "environment", "query_details")])
        steps.append((F.when(given, key), least("query_hash")))
    found, left = [], rows
    for n, (value, one) in enumerate(steps, 1):
        both = left.withColumn("__value", value).join(one, F.col("__value") == F.col("__key"), "left").drop("__value", "__key")
        found.append(both.where("__found is not null").select(*rows.columns, F.lit(n).alias("step"), "__found"))
        left = both.where("__found is null").drop("__found")
    if kind == "slow_query_mongo":
        found.append(_by_collection(left.where(given), details).withColumn("step", F.lit(len(steps) + 1)).select(*rows.columns, "step", "__found"))
    every = reduce(DataFrame.unionByName, found).select("id", "step", "__found")
    data = details.select(F.struct(*[c for c in details.columns if c != "raw_xml"]).alias("data"))
    first_step = every.join(data, F.col("__found") == F.col("data.id")).select(F.col("id").alias("__id"), "step", "data")
    return rows.join(first_step, rows["id"] == F.col("__id"), "left").select("id", "type", "step", "data")


def _by_collection(rows: DataFrame, details: DataFrame) -> DataFrame:
    """Rows with the detail (``__found``) of their collection and environment that occurs most, on their host and database where given.

    Details are ranked once for each way in which host and database may be given, so every row meets one of them.
    """
    name = F.get(F.map_values(F.from_json("query_details", "map<string,string>")), F.lit(0))  # the operation's value
    blank = lambda c: F.coalesce(c, F.lit(""))
    keyed = rows.withColumns({"__name": name, "__host": blank("host"), "__db": blank("db_name")})
    best = F.min(F.struct((-F.col("occurrence_count")).alias("n"), "id"))["id"].alias("__found")
    own = details.select("id", "occurrence_count", "collection", "environment", "host", "db_name")
    # a row for the exact host and database, and one for each of them left open
    wide = own.select("id", "occurrence_count", F.col("collection").alias("__name"), F.col("environment").alias("__environment"), F.explode(F.array_distinct(F.array(blank("host"), F.lit("")))).alias("__host"), "db_name")
    wide = wide.select("id", "occurrence_count", "__name", "__environment", "__host", F.explode(F.array_distinct(F.array(blank("db_name"), F.lit("")))).alias("__db"))
    ranked = wide.groupBy("__name", "__environment", "__host", "__db").agg(best)
    met = keyed.withColumn("__environment", F.col("environment")).join(ranked, ["__name", "__environment", "__host", "__db"])
    return met.select(*rows.columns, "__found")
