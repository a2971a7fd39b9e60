"""Normalising, deduplicating and upserting rows; snapshots are rewritten by joins, not row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kinds
from ..functions.text import strip
from ..functions.times import month_in, month_of


def normalised(rows: DataFrame, now: Column) -> DataFrame:
    """Common rows as raw_query rows, without id: clamped, keyed, and one per key.

    Of rows with one key the first by ``seq`` stays and occurrences add up. ``rows`` has time, source, host, db_name,
    environment, type, query_details, seq, and may have occurrence_count and extra_metadata.
    """
    return settled(keyed(rows), now)


def settled(keyed_rows: DataFrame, now: Column) -> DataFrame:
    """Keyed common rows as raw_query rows, one per key."""
    return _seen_now(deduplicated(keyed_rows.withColumn("month_year", month_of(F.col("time")))), now)


def keyed(rows: DataFrame) -> DataFrame:
    """Common rows, clamped, each with its key."""
    has = rows.columns
    blank = lambda c: F.nullif(strip(F.col(c)), F.lit(""))
    occurrences = F.col("occurrence_count").cast("long") if "occurrence_count" in has else F.lit(None).cast("long")
    typed = rows.select(
        "seq",
        blank("time").alias("time"),
        kinds.clamp(strip(F.col("source")), kinds.SOURCES, "sql").alias("source"),
        blank("host").alias("host"),
        blank("db_name").alias("db_name"),
        kinds.clamp(strip(F.col("environment")), kinds.ENVIRONMENTS, "unknown").alias("environment"),
        kinds.clamp(strip(F.col("type")), kinds.TYPES, "unknown").alias("type"),
        blank("query_details").alias("query_details"),
        (blank("extra_metadata") if "extra_metadata" in has else F.lit(None).cast("string")).alias("extra_metadata"),
        F.when(F.coalesce(occurrences, F.lit(0)) == 0, 1).otherwise(occurrences).alias("occurrence_count"),
    )
    key = kinds.common_hash(*[F.col(c) for c in ("source", "host", "db_name", "environment", "type", "time", "query_details", "extra_metadata")])
    return typed.withColumn("query_hash", key)


def normalised_details(rows: DataFrame, now: Column) -> DataFrame:
    """Detail rows keyed by their ``hash_parts``, one per key with the number of rows it stands for."""
    return settled_details(keyed_details(rows), now)


def settled_details(keyed_rows: DataFrame, now: Column) -> DataFrame:
    """Keyed detail rows, one per key."""
    month = F.coalesce("month_year", month_in(F.col("hash_parts")))
    counted = keyed_rows.withColumn("month_year", month).withColumn("occurrence_count", F.lit(1).cast("long")).withColumn("raw_query_id", F.lit(None).cast("long"))
    return _seen_now(deduplicated(counted.drop("hash_parts")), now)


def keyed_details(rows: DataFrame) -> DataFrame:
    """Detail rows, each with the key that its ``hash_parts`` give."""
    key = F.md5(F.concat_ws("|", F.transform("hash_parts", lambda p: F.coalesce(strip(p), F.lit("")))).cast("binary"))
    return rows.withColumn("query_hash", key)


def deduplicated(rows: DataFrame, key: str = "query_hash", order: str = "seq", count: str = "occurrence_count") -> DataFrame:
    """One row per key: the first by order, with the counts added up."""
    others = [c for c in rows.columns if c not in (key, order, count)]
    both = rows.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("__first"), F.sum(count).cast("long").alias(count), F.min(order).alias(order))
    return both.select(key, count, order, *[F.col("__first")[c].alias(c) for c in others])


def _seen_now(rows: DataFrame, now: Column) -> DataFrame:
    return rows.withColumns({c: now for c in ("first_seen", "last_seen", "created_at", "updated_at")})


def upsert(old: DataFrame, new: DataFrame, key: str = "query_hash", order: str = "seq", after: int | None = None) -> DataFrame:
    """The next rows: new keys are added, known keys keep their content, add occurrences and were seen last now.

    Ids go on densely by ``order`` from ``after``, or from the largest of ``old``; what ``new`` has beyond the table's columns is dropped.
    """
    fresh = new.select(F.col(key).alias("__key"), F.col("occurrence_count").alias("__n"), F.col("last_seen").alias("__seen"), F.col("updated_at").alias("__updated"))
    kept = old.join(fresh, old[key] == F.col("__key"), "left").select(
        *[
            (F.coalesce("occurrence_count", F.lit(0)) + F.coalesce("__n", F.lit(0))).alias(c)
            if c == "occurrence_count"
            else F.coalesce("__seen", c).alias(c)
            if c == "last_seen"
            else F.coalesce("__updated", c).alias(c)
            if c == "updated_at"
            else F.col(c)
            for c in old.columns
        ]
    )
    added = numbered(new.join(old.select(F.col(key).alias("__old")), F.col(key) == F.col("__old"), "left_anti"), order, old if after is None else after)
    given = set(added.columns)
    return kept.unionByName(added.select(*[F.col(f.name).cast(f.dataType) if f.name in given else F.lit(None).cast(f.dataType).alias(f.name) for f in old.schema.fields]))


def numbered(rows: DataFrame, order: str, after: DataFrame | int, id_col: str = "id") -> DataFrame:
    """Rows with ids that go on densely from ``after``, a number or the largest in a table, by a whole-number order.

    Rows are ranked within runs of 65,536 values of the order, so their number of tasks follows the rows.
    """
    dealt = rows.withColumn("__part", F.floor(F.col(order) / 65_536).cast("long"))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per run
    starts = sizes.select("__part", before.alias("__before"))
    if isinstance(after, int):
        starts = starts.withColumn("__last", F.lit(after).cast("long"))
    else:
        starts = starts.crossJoin(F.broadcast(after.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("__last"))))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    return dealt.withColumn("__rank", rank).join(starts, "__part").withColumn(id_col, F.col("__last") + F.col("__before") + F.col("__rank")).drop("__part", "__rank", "__before", "__last")


def accounting(old: DataFrame, new: DataFrame, key: str = "query_hash") -> DataFrame:
    """How many keys of ``new`` an upsert inserts and how many it updates."""
    known = new.join(old.select(F.col(key).alias("__old")), F.col(key) == F.col("__old"), "left")
    return known.agg(F.count_if(F.col("__old").isNull()).alias("inserted"), F.count_if(F.col("__old").isNotNull()).alias("updated"))


def accounting_by(old: DataFrame, new: DataFrame, by: str, key: str = "query_hash") -> DataFrame:
    """Per part of ``new``, how many of its keys an upsert inserts and how many it updates, parts being taken in by ascending ``by``.

    A key that two parts bring is inserted by the first and updated by the others.
    """
    pairs = new.select(key, by).distinct()
    first = pairs.groupBy(key).agg(F.min(by).alias("__first"))
    fresh = first.join(old.select(F.col(key).alias("__old")), F.col(key) == F.col("__old"), "left_anti").select(F.col(key).alias("__key"), "__first")
    met = pairs.join(fresh, (F.col(key) == F.col("__key")) & (F.col(by) == F.col("__first")), "left")
    return met.groupBy(by).agg(F.count("__key").alias("inserted"), F.count_if(F.col("__key").isNull()).alias("updated"))


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` in place of the rows that share its keys."""
    rest = old.join(new.select(F.col(key).alias("__key")).distinct(), F.col(key) == F.col("__key"), "left_anti")
    return rest.unionByName(new, allowMissingColumns=True)


def reuploaded(uploads: DataFrame) -> DataFrame:
    """Files logged more than once, with the log row to keep."""
    return uploads.groupBy("filename").agg(F.count("*").alias("uploads"), F.sum("csv_row_count").cast("long").alias("rows"), F.max("id").alias("keep_id")).where("uploads > 1")


def latest_uploads(uploads: DataFrame) -> DataFrame:
    """The log with only the newest row of each file."""
    newest = uploads.groupBy("filename").agg(F.max("id").alias("__keep"))
    return uploads.join(newest.select("__keep"), F.col("id") == F.col("__keep"), "left_semi")


def month_backfilled(raw: DataFrame) -> DataFrame:
    """Missing months derived from the rows' times."""
    return raw.withColumn("month_year", F.coalesce("month_year", month_of(F.col("time"))))
