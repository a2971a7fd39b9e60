"""Labels, curated records and saved searches: small tables, changed by making their next snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import clamp

SEVERITIES = ["critical", "warning", "info"]
LABEL_SOURCES = ["sql", "mongodb", "both"]
DEFAULT_SPL_TYPES = ["slow_query", "blocker", "deadlock", "slow_query_mongo"]


class NotFound(LookupError):
    pass


class Conflict(ValueError):
    pass


def _now() -> Column:
    return F.current_timestamp()


def _next_id(df: DataFrame) -> int:
    return (df.agg(F.max("id")).first()[0] or 0) + 1


def _one(df: DataFrame, row_id: int, what: str):
    row = df.where(F.col("id") == row_id).first()
    if row is None:
        raise NotFound(f"no {what} {row_id}")
    return row


def _added(df: DataFrame, values: dict) -> DataFrame:
    fields = {"id": F.lit(_next_id(df)), "created_at": _now(), "updated_at": _now()} | {k: F.lit(v) for k, v in values.items()}
    row = df.sparkSession.range(1).select(*[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    return df.unionByName(row)


def _changed(df: DataFrame, row_id: int, values: dict, what: str) -> DataFrame:
    _one(df, row_id, what)
    hit = F.col("id") == row_id
    fields = {k: F.lit(v) for k, v in values.items()} | {"updated_at": _now()}
    return df.withColumns({k: F.when(hit, v.cast(df.schema[k].dataType)).otherwise(F.col(k)) for k, v in fields.items()})


def _removed(df: DataFrame, row_id: int, what: str) -> DataFrame:
    _one(df, row_id, what)
    return df.where(F.col("id") != row_id)


def list_labels(labels: DataFrame) -> DataFrame:
    return labels.orderBy("name", "id")


def create_label(labels: DataFrame, name: str, severity: str = "warning", description: str | None = None, source: str = "both") -> DataFrame:
    return _added(labels, {"name": name, "severity": severity, "description": description, "source": source})


def update_label(labels: DataFrame, label_id: int, /, **values) -> DataFrame:
    return _changed(labels, label_id, values, "label")


def label_uses(curated: DataFrame, label_id: int) -> int:
    return curated.where(F.col("label_id") == label_id).count()


def uses_of_labels(curated: DataFrame) -> DataFrame:
    """How many curated records use each label."""
    return curated.where("label_id is not null").groupBy("label_id").agg(F.count("*").alias("uses"))


def delete_label(labels: DataFrame, curated: DataFrame, label_id: int) -> DataFrame:
    """Without the label; refused while curated records use it."""
    if uses := label_uses(curated, label_id):
        raise Conflict(f"label {label_id} is used by {uses} records")
    return _removed(labels, label_id, "label")


def seed_labels(labels: DataFrame, seeds: DataFrame) -> DataFrame:
    """Labels with the seeds: known names take over severity, description and source, others are added in the seeds' order."""
    fresh = seeds.select(F.col("name").alias("__name"), F.col("severity").alias("__severity"), F.col("description").alias("__description"), F.col("source").alias("__source"))
    kept = labels.join(fresh, F.col("name") == F.col("__name"), "left")
    take = {c: F.coalesce(f"__{c}", c) for c in ("severity", "description", "source")}
    kept = kept.select(*[(take[c] if c in take else F.when(F.col("__name").isNotNull(), _now()).otherwise(F.col(c)) if c == "updated_at" else F.col(c)).alias(c) for c in labels.columns])
    new = seeds.join(labels.select(F.col("name").alias("__old")), F.col("name") == F.col("__old"), "left_anti")
    from pyspark.sql import Window

    last = labels.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__last"))
    ids = new.crossJoin(F.broadcast(last)).withColumn("id", F.col("__last") + F.row_number().over(Window.orderBy("name")))  # a handful of seeds
    rows = ids.select("id", "name", clamp(F.col("severity"), SEVERITIES, "warning").alias("severity"), "description", clamp(F.col("source"), LABEL_SOURCES, "both").alias("source"), _now().alias("created_at"), _now().alias("updated_at"))
    return kept.unionByName(rows)


def create_curated(curated: DataFrame, raw: DataFrame, raw_query_id: int, label_id: int | None = None, notes: str | None = None) -> DataFrame:
    """With a record for the row; refused if there is no such row, or it has one."""
    _one(raw, raw_query_id, "query")
    if curated.where(F.col("raw_query_id") == raw_query_id).first() is not None:
        raise Conflict(f"query {raw_query_id} is curated already")
    return _added(curated, {"raw_query_id": raw_query_id, "label_id": label_id, "notes": notes})


def get_curated(curated: DataFrame, curated_id: int):
    return _one(curated, curated_id, "curated record")


def update_curated(curated: DataFrame, curated_id: int, /, **values) -> DataFrame:
    return _changed(curated, curated_id, values, "curated record")


def delete_curated(curated: DataFrame, curated_id: int) -> DataFrame:
    return _removed(curated, curated_id, "curated record")


def list_spl(spl: DataFrame) -> DataFrame:
    return spl.orderBy("query_type", "name", "id")


def spl_types(spl: DataFrame, defaults: list[str] = DEFAULT_SPL_TYPES) -> DataFrame:
    """The default types in their order, then the others by name."""
    first = spl.sparkSession.createDataFrame([(i, t) for i, t in enumerate(defaults)], "rank int, query_type string")
    every = first.unionByName(spl.select(F.lit(len(defaults)).alias("rank"), "query_type").where("query_type is not null"))
    return every.groupBy("query_type").agg(F.min("rank").alias("rank")).orderBy("rank", "query_type").select("query_type")


def create_spl(spl: DataFrame, name: str, query_type: str, text: str, environment: str = "both", description: str | None = None) -> DataFrame:
    return _added(spl, {"name": name, "query_type": query_type, "spl": text, "environment": environment, "description": description})


def update_spl(spl: DataFrame, spl_id: int, /, **values) -> DataFrame:
    return _changed(spl, spl_id, values, "saved search")


def delete_spl(spl: DataFrame, spl_id: int) -> DataFrame:
    return _removed(spl, spl_id, "saved search")
