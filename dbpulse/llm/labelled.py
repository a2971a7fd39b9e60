"""Labelled rows for training: which may be learnt from, and a bounded sample of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample


def remainder(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 3; rows with 1 are held out of training everywhere."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3))


def held_out(id_col: Column) -> Column:
    return F.coalesce(remainder(id_col) == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, grade: Column, most: int, each: bool = False) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, grade) of at most ``most`` documents by hash order of their id, none held out; and the number of labelled documents by grade.

    With ``each``, as many of every grade. Documents labelled twice take the lower grade; null grades and ids don't
    count. The sample's ids are at most ``most`` rows (of each grade), so they are broadcast and the documents
    aren't shuffled. Of rows that repeat a sampled id the one with the smallest text comes.
    """
    rows = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.cast("int").alias("grade"))
        .where(F.col("doc_id").isNotNull() & F.col("grade").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("grade").alias("grade"))
    )
    total = {r.grade: r["count"] for r in rows.groupBy("grade").count().collect()}
    if each:
        parts = [hash_sample(rows.where(F.col("grade") == g), "doc_id", most, n) for g, n in sorted(total.items())]
        rows = reduce(DataFrame.union, parts) if parts else rows.limit(0)
    else:
        rows = hash_sample(rows, "doc_id", most, sum(total.values()))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(rows), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text")).select("doc_id", "text", "grade"), total
