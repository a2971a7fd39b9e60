"""Connected components of a link table by alternating large-star and small-star steps.

Each step is an aggregate with map-side combining, written as a table, and a join
with that table. A join straight with the aggregate would be dealt as the aggregate
is, which adaptive execution can't split; so a star with a third of all rows stays
spread. Links are never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import cut


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from each node that has a link. Null ends and loops are left out."""
    edges, shape = _counted(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while shape["n"]:
        edges, now = _counted(_small_star(cut(_large_star(edges), "stars")))
        if now == shape:
            break
        shape = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _counted(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The edges as a written table, with their number and a sum of hashes: the same twice running means that nothing moved."""
    seen = Observation()
    out = cut(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hash")), "edges")
    return out, seen.get


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), "least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
