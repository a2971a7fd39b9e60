"""Row changes between two versions of a table, and what can be kept up to date by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GONE, CAME = ("delete", "update_before"), ("insert", "update_after")


def replayed(old: DataFrame, feed: DataFrame, key: str) -> DataFrame:
    """The newer version: the older one with the changes of a feed applied."""
    gone = feed.where(F.col("change").isin(*GONE)).select(F.col(key).alias("__gone"))
    rest = old.join(gone, old[key].eqNullSafe(F.col("__gone")), "left_anti")
    return rest.unionByName(feed.where(F.col("change").isin(*CAME)).drop("change"))


def inverted(feed: DataFrame) -> DataFrame:
    """The feed that leads back: what came goes, what went comes."""
    back = dict(zip([*GONE, *CAME], ["insert", "update_after", "delete", "update_before"], strict=True))
    return feed.withColumn("change", F.element_at(F.create_map(*[F.lit(x) for pair in back.items() for x in pair]), F.col("change")))


def signed(rows: DataFrame) -> DataFrame:
    """Rows of a feed with ``sign``: 1 for what came, -1 for what went."""
    return rows.withColumn("sign", F.when(F.col("change").isin(*GONE), -1).otherwise(1)).drop("change")


def rolled(rows: DataFrame, keys: list[str], count: str = "occurrence_count") -> DataFrame:
    """Rows and occurrences of each group, by sign; both add up, so roll-ups of parts can be added and taken back."""
    return rows.groupBy(*keys).agg(F.sum("sign").cast("long").alias("row_count"), F.sum(F.col("sign") * F.coalesce(count, F.lit(0))).cast("long").alias("total_occurrences"))


def added_up(rollup: DataFrame, keys: list[str]) -> DataFrame:
    """Roll-ups by the same or finer keys as one; groups without rows go."""
    return rollup.groupBy(*keys).agg(F.sum("row_count").cast("long").alias("row_count"), F.sum("total_occurrences").cast("long").alias("total_occurrences")).where("row_count <> 0")
