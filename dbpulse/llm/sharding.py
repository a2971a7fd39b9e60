"""Shards along a Hilbert curve over quantised metadata, with DataFrame functions only.

Several metadata dimensions are quantised to a few bits each; a row's cell on
that grid has a place on the Hilbert curve, and shards are runs of the curve's
order cut so that their row counts differ by at most one. Neighbouring cells
share shards, so files written by shard have narrow ranges in every dimension.

The global order is never sorted in one place: cells (a number fixed by the
grid) are counted, cells with many rows are split by the hash of the id that
also orders the rows within a cell, the counts of these bounded parts are added
up, and each row adds its rank within its own part. No text is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


@dataclass(frozen=True)
class HilbertParams:
    shards: int = 24
    bits: int = 4  # of each dimension
    parts: int = 1024  # rows of a cell beyond a 1024th of all go to further parts
    size_extra: int = 8  # bytes added to a text's


def hilbert_order(bits: int, dims: int) -> list[int]:
    """Place on the curve of every cell, cells numbered with the first dimension's bits on top.

    The cells are listed in curve order by expanding the curve level by level: a step to a child
    cell is a Gray code, turned and reflected by its parent's entry point and direction.
    """
    width = (1 << dims) - 1
    turn = lambda x, k: ((x << k % dims) | (x >> (dims - k % dims))) & width
    trailing = lambda i: (~i & i + 1).bit_length() - 1  # noqa: E731  number of 1 bits at the end
    entry = lambda w: 0 if w == 0 else (w - 1 & ~1) ^ ((w - 1 & ~1) >> 1)
    way = lambda w: 0 if w == 0 else (trailing(w - 1) if w % 2 == 0 else trailing(w)) % dims
    walks = [((0,) * dims, 0, 0)]
    for _ in range(bits):
        longer = []
        for cell, e, d in walks:
            for w in range(1 << dims):
                corner = turn(w ^ (w >> 1), d + 1) ^ e
                child = tuple(c << 1 | corner >> j & 1 for j, c in enumerate(cell))
                longer.append((child, e ^ turn(entry(w), d + 1), (d + way(w) + 1) % dims))
        walks = longer
    places = [0] * (1 << bits * dims)
    for place, (cell, _, _) in enumerate(walks):
        number = 0
        for c in cell:
            number = number << bits | c
        places[number] = place
    return places


def curve_place(levels: list[Column], bits: int) -> Column:
    """The Hilbert place of a row from its quantised dimensions, by a table of the grid's cells."""
    number = F.lit(0)
    for level in levels:
        number = number * F.lit(1 << bits) + level
    table = ",".join(map(str, hilbert_order(bits, len(levels))))
    return F.element_at(F.split(F.lit(table), ","), number.cast("int") + 1).cast("int")


def size_level(size: Column, bits: int) -> Column:
    """Two levels to each doubling of the size from 32 bytes on."""
    return F.least(F.lit((1 << bits) - 1), F.greatest(F.lit(0), F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")) * 1.5 - 8))).cast("int")


def name_level(value: Column, bits: int) -> Column:
    """A level for a name: null is 0, others share the rest by checksum."""
    return F.when(value.isNull(), 0).otherwise(1 + F.pmod(F.crc32(value.cast("string").cast("binary")), F.lit((1 << bits) - 1))).cast("int")


def shard(docs: DataFrame, params: HilbertParams = HilbertParams()) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve) of every row of (doc_id, text, lang, source).

    Law ``rows``: the shards' row counts are at most one apart. size is the text's UTF-8 bytes plus 8; a null text
    has none and the checksum of no bytes. Within a cell rows stand by the md5 of their id, or of their place where they have none, then by id, size and
    checksum; rows that agree in all of these are interchangeable. A group of equal texts isn't kept together: its
    rows share a cell if language and source agree, but stand by their ids. Null languages and sources have their own
    level. An empty table gives no rows. Other columns are not read.
    """
    p = params
    raw = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "utf-8")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw) + p.size_extra).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        name_level(F.col("lang"), p.bits).alias("lang_level"),
        name_level(F.col("source"), p.bits).alias("source_level"),
        # rows without an id stand by where they were read, so that they are dealt to parts like others; written once, so it stays
        F.coalesce(F.md5(F.col("doc_id").cast("long").cast("string").cast("binary")), F.md5(F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string")).cast("binary"))).alias("order"),
    )
    levels = [F.col("lang_level"), size_level(F.col("size"), p.bits), F.col("source_level")]
    placed = cut(rows.select("doc_id", "size", "text_crc32", "order", curve_place(levels, p.bits).alias("curve")), "placed")  # texts are read once
    cells = placed.groupBy("curve").agg(F.count("*").alias("n"))
    total = F.lit(placed.count()).cast("long")
    # at most 2 ** (bits * dimensions) cells, and as many parts and 1024 more: both fit any executor
    split = cells.select("curve", total.alias("total"), F.ceil(F.col("n") * p.parts / total).cast("int").alias("split"))
    lead = F.coalesce(F.conv(F.substring("order", 1, 8), 16, 10).cast("long"), F.lit(0))
    dealt = placed.join(F.broadcast(split), "curve").withColumn("part", F.floor(lead * F.col("split") / F.lit(1 << 32)).cast("int"))
    counts = dealt.groupBy("curve", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("curve", "part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("curve", "part", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("curve", "part").orderBy("order", "doc_id", "size", "text_crc32"))
    at = dealt.withColumn("rank", rank).join(F.broadcast(starts), ["curve", "part"]).withColumn("at", F.col("before") + F.col("rank") - 1)
    # the run of shard s begins at the first place whose share reaches s
    numbered = at.withColumn("shard", F.expr(f"cast((at * {p.shards}) div total as int)"))
    begin = F.expr(f"(shard * total + {p.shards - 1}) div {p.shards}")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("at") - begin).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")
