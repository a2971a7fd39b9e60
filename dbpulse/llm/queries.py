"""The registered queries of this subpackage: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import digest, licences, neighbours, packing, periodic, pieces, quality, sharding, tiles, toxicity, trie, warc
from .common import table
from .minhash import MinMaxParams, near_duplicates
from .oracles import OP2_SQL, OP6_SQL, OP8_SQL, OP11_SQL

OP2 = MinMaxParams(shingle=3, percent=85)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), OP2)


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"), licences.fit())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archived(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.with_shared_openings(trie.sequences(table(spark, sf_dir, "conversations"))))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.with_edits(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.periodic_runs(table(spark, sf_dir, "documents"), rewrite=periodic.looped))


QUERIES = {"op1_quality": op1_quality, "op2_minhash": op2_minhash, "op3_licences": op3_licences, "op4_toxicity": op4_toxicity, "op5_neighbours": op5_neighbours, "op6_warc": op6_warc, "op7_sharding": op7_sharding, "op8_near_vectors": op8_near_vectors, "op9_packing": op9_packing, "op10_sentencepiece": op10_sentencepiece, "op11_prefix_trie": op11_prefix_trie, "op12_fingerprints": op12_fingerprints, "op13_periodic_runs": op13_periodic_runs}
ORACLE_SQL: dict[str, str] = {"op2_minhash": OP2_SQL, "op6_warc": OP6_SQL, "op8_near_vectors": OP8_SQL, "op11_prefix_trie": OP11_SQL}
