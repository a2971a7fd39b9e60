"""Optional streaming intake: CSV files that arrive in a folder go through the batch path, file by batch.

The batch path defines what is right; the stream only decides when. The files of
a batch are taken in together, under a name that the files give: a batch that is
repeated after a failure between two writes leaves alone what is written, and
files that are logged aren't taken in again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.kinds import file_category
from ..functions.times import event_time
from ..plans.ingest import Group, ingest_groups, names_facts
from ..sources.csv import OPTIONS
from ..sources.store import Store


def incoming(spark: SparkSession, folder: str, columns: list[str], files_per_batch: int = 50) -> DataFrame:
    """The rows of files of one layout as they arrive."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.readStream.options(**OPTIONS, maxFilesPerTrigger=str(files_per_batch)).schema(schema).csv(folder)
    return rows.withColumn("file_name", F.col("_metadata.file_name"))


def start(store: Store, folder: str, columns: list[str], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Takes arriving files in, each once."""

    def batch(df: DataFrame, _: int) -> None:
        rows = df.withColumn("seq", F.monotonically_increasing_id())
        names = [r.file_name for r in rows.select("file_name").distinct().orderBy("file_name").collect()]  # at most files_per_batch
        kinds = {kind for kind, _ in names_facts(store.spark, names).values()} if names else set()
        groups = [Group(rows.where(file_category(F.col("file_name")) == kind), kind) for kind in sorted(kinds)]
        ingest_groups(store, groups, names, only_once=True)

    writer = incoming(store.spark, folder, columns).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def hourly(rows: DataFrame, time_col: str = "time", late: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """Occurrences by event-time window and type; rows later than ``late`` are dropped by the watermark."""
    timed = rows.withColumn("at", event_time(F.col(time_col)).cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "type").agg(F.sum("occurrence_count").alias("occurrences"), F.count("*").alias("rows")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "type", "occurrences", "rows")
