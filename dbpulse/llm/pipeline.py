"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and works on all it is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packing, quality, toxicity
from .common import broadcast_if, cut, table
from .minhash import MinMaxParams, near_duplicates


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose chance of a usable grade is at least one half."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below the toxicity cutoff."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str, params: MinMaxParams = MinMaxParams()) -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest id.

    Of rows that repeat this id with the same text one stays, that with the least of the other columns in their order;
    rows that repeat an id with another text stay or go with it. Rows without an id can't be referred to and stay.
    """
    dropped = cut(near_duplicates(docs, params).where("not kept").select(F.col("doc_id").alias("dropped")).distinct(), "dropped")
    gone = broadcast_if(dropped, dropped.count(), params.broadcast_rows)
    kept = docs.join(gone, F.col("doc_id") == F.col("dropped"), "left_anti")
    twice = cut(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("twice")).count().where("count > 1").select("twice"), "twice")
    n = twice.count()
    if not n:
        return kept
    repeats = broadcast_if(twice, n, params.broadcast_rows)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    again = kept.join(repeats, F.col("doc_id") == F.col("twice"), "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0).alias("none"), *[F.col(c) for c in rest])).alias("rest"))
    once = again.select(*[F.col("rest")[c].alias(c) if c in rest else F.col(c) for c in docs.columns])
    return kept.join(repeats, F.col("doc_id") == F.col("twice"), "left_anti").unionByName(once)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)
