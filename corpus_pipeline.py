"""The corpus pipeline: quality, toxicity, near-duplicates, packing, over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dbpulse.llm import pipeline as p
from dbpulse.llm.common import cut, table

STAGES = [
    ("quality", p.good_quality),
    ("toxicity", p.not_toxic),
    ("near_dedup", p.one_of_each),
    ("packing", p.packed),
]

#: Fitted classifiers and tokenizer ids are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
