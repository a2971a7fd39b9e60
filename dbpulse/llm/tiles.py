"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

A unit vector x is held as scale * q + e with q of int8 components and |e| known.
For two vectors the product of the quantised ones differs from the cosine by at
most |xq||ey| + |ex||yq| + |ex||ey|; that bound is bilinear, so three more columns
make one matrix product give quantised cosine plus bound. Pairs that it lets
through get their integer product, from which bound and cosine follow exactly:
some are surely links, and only those left open are computed again in double
precision.

Equal vectors are one class. Classes are dealt to blocks near one of a few
pivots; a pair of blocks whose angles to their pivots rule out any link isn't
compared. Tiles hold codes, scales and errors of two blocks. They return, per
vector, how many rows it surely links with, the links that span those, and which
vectors have an open pair; a second pass brings just these vectors' components to
the tile. No pair is a row anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hash_sample, ship
from .components import connected_components
from .vectors import matrix, packed, unpacked, usable


@dataclass(frozen=True)
class TileParams:
    threshold: float = 0.95
    block: int = 8192  # vectors in a block, about
    pivots: int = 32  # sampled vectors that blocks gather around, at least; as many as give cells of two blocks,
    most_pivots: int = 16_384  # and no more than the square root of the rows and this many
    rows: int = 256  # of a block multiplied at a time
    tasks: int = 10_000  # for the tiles, at most


class Codes(NamedTuple):
    """Quantised vectors: int8 components, scales, and norms of the errors."""

    q: np.ndarray
    scale: np.ndarray
    error: np.ndarray


def unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their norm; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantised(u: np.ndarray) -> Codes:
    scale = np.abs(u).max(axis=1) / 127
    q = np.rint(u / scale[:, None]).astype(np.int8)
    return Codes(q, scale, np.sqrt(((u - q * scale[:, None]) ** 2).sum(axis=1)))


def _norms(x: Codes) -> np.ndarray:
    return x.scale * np.sqrt((x.q.astype(np.float64) ** 2).sum(axis=1))


def _bounded(q: np.ndarray, scale: np.ndarray, error: np.ndarray, left: bool) -> np.ndarray:
    """Factors whose product is the quantised cosine plus its error bound."""
    rough, norm = q * scale[:, None].astype(np.float32), _norms(Codes(q, scale, error))
    return np.concatenate([rough, np.stack([norm, error, error] if left else [error, norm, error], axis=1)], axis=1).astype(np.float32)


def tile_pairs(x: Codes, y: Codes, same: bool, p: TileParams) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, columns, sure) of the pairs whose bound reaches the threshold; above the diagonal if same.

    Sure pairs reach it whatever the errors are. Both verdicts come from integer products, so they don't depend on
    which other vectors are in the tile.
    """
    a, b = _bounded(*x, True), _bounded(*y, False)
    nx, ny = _norms(x), _norms(y)
    floor = np.float32(p.threshold - 1e-4)  # the product's own rounding in single precision stays far below this margin
    for at in range(0, len(a), p.rows):
        could = a[at : at + p.rows] @ b.T >= floor
        if same:
            could &= np.arange(len(b))[None, :] > (at + np.arange(len(could)))[:, None]
        rows, columns = np.nonzero(could)
        for lo in range(0, len(rows), 65_536):
            r, c = rows[lo : lo + 65_536] + at, columns[lo : lo + 65_536]
            product = np.einsum("ij,ij->i", x.q[r].astype(np.int64), y.q[c].astype(np.int64))
            cosine = product * (x.scale[r] * y.scale[c])
            bound = nx[r] * y.error[c] + x.error[r] * ny[c] + x.error[r] * y.error[c] + 1e-12
            open_or_sure = cosine + bound >= p.threshold
            r, c, sure = r[open_or_sure], c[open_or_sure], (cosine - bound >= p.threshold)[open_or_sure]
            yield r, c, sure


class Forest:
    """Union by smallest number over the members of a tile."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return int(i)

    def join(self, rows: np.ndarray, columns: np.ndarray) -> Iterator[tuple[int, int]]:
        while len(rows):
            roots = self.parent.copy()
            while not np.array_equal(roots, roots[roots]):
                roots = roots[roots]
            self.parent = roots
            x, y = roots[rows], roots[columns]
            apart = x != y
            rows, columns, x, y = rows[apart], columns[apart], x[apart], y[apart]
            _, first = np.unique(np.maximum(x, y), return_index=True)
            for i in first:
                if self.find(int(x[i])) != self.find(int(y[i])):
                    self.parent[max(self.find(int(x[i])), self.find(int(y[i])))] = min(self.find(int(x[i])), self.find(int(y[i])))
                    yield int(rows[i]), int(columns[i])


class _Block(NamedTuple):
    rep: np.ndarray
    key: np.ndarray
    members: np.ndarray
    codes: Codes


def _block(rows: pa.Table) -> _Block:
    return _Block(rows["rep"].to_numpy(), rows["key"].to_numpy(), rows["members"].to_numpy(), Codes(unpacked(rows["q"], np.int8), rows["scale"].to_numpy(), rows["error"].to_numpy()))


BLOCK = pa.schema([("rep", pa.int64()), ("key", pa.int64()), ("members", pa.int64()), ("q", pa.binary()), ("scale", pa.float64()), ("error", pa.float64())])
FOUND = "tile string, rep long, key long, other long, n long"


def _result(tile: str, left: _Block, right: _Block, same: bool, pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    """Rows of FOUND: counts have no other end, links have one, vectors with an open pair have a tile."""
    shift = 0 if same else len(left.rep)
    links, open_pair = np.zeros(shift + len(right.rep), np.int64), np.zeros(shift + len(right.rep), bool)
    forest, edges = Forest(len(links)), []
    for r, c, sure in pairs:
        open_pair[r[~sure]] = open_pair[c[~sure] + shift] = True
        r, c = r[sure], c[sure]
        links += np.bincount(r, right.members[c], len(links)).astype(np.int64)
        links += np.bincount(c + shift, left.members[r], len(links)).astype(np.int64)
        edges += forest.join(r, c + shift)
    rep, key = (left.rep, left.key) if same else (np.concatenate([left.rep, right.rep]), np.concatenate([left.key, right.key]))
    hit, again = np.flatnonzero(links), np.flatnonzero(open_pair)
    x, y = (np.array([e[i] for e in edges], np.int64) for i in (0, 1))
    at = np.concatenate([hit, x, again])
    return pa.table({
        "tile": pa.array([None] * (len(hit) + len(x)) + [f"{int(i >= shift and not same)}/{tile}" for i in again], pa.string()),
        "rep": rep[at], "key": key[at],
        "other": pa.concat_arrays([pa.nulls(len(hit), pa.int64()), pa.array(rep[y]), pa.nulls(len(again), pa.int64())]),
        "n": np.concatenate([links[hit], np.zeros(len(x) + len(again), np.int64)]),
    })


def _tile(p: TileParams):
    """A tile of one block or two: its sure links and its open vectors."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block")
        blocks = [_block(pa.ipc.open_stream(x).read_all()) for x in rows["data"].to_pylist()]
        same = len(blocks) == 1
        return _result(rows["tile"][0].as_py(), blocks[0], blocks[-1], same, tile_pairs(blocks[0].codes, blocks[-1].codes, same, p))

    return run


def _settle(p: TileParams):
    """The open vectors of a tile, with their components: the links among its open pairs."""

    def run(rows: pa.Table) -> pa.Table:
        side = np.array([x[0] == "1" for x in rows["tile"].to_pylist()])
        parts = [rows.filter(pa.array(m)).sort_by([("rep", "ascending"), ("key", "ascending")]) for m in (~side, side)]
        same = not side.any()
        left, right = parts[0], parts[0] if same else parts[1]
        u, v = unpacked(left["u"], np.float64), unpacked(right["u"], np.float64)
        x, y = _block(left), _block(right)

        def exact() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for r, c, sure in tile_pairs(x.codes, y.codes, same, p):
                r, c = r[~sure], c[~sure]
                link = np.einsum("ij,ij->i", u[r], v[c]) >= p.threshold
                yield r[link], c[link], np.ones(int(link.sum()), bool)

        return _result("", x, y, same, exact())

    return run


def near_vectors(table: DataFrame, params: TileParams = TileParams(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row with an id.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of
    different lengths don't link with each other. Rows that repeat an id are linked like any other rows. A null
    id is left out, as nothing could refer to it. Other columns are not read.
    """
    p = params
    spark = table.sparkSession
    ship(spark)
    vec = F.col(vec_col)
    kind = dict(table.dtypes)[vec_col]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.when(usable(vec), vec).cast(kind).alias("v")).where("vec_id is not null")
    classes = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("members"))
    # a class is known by two hashes of its vector; two with one smallest id, from repeated ids, share a node
    hashes = [F.xxhash64("v").alias("key"), F.xxhash64(F.lit(1), "v").alias("key2")]
    reps = cut(classes.select("v", "rep", "members", *hashes), "classes")
    n = reps.count()
    most = min(p.most_pivots, math.isqrt(n), -(-n // (2 * p.block)))
    pivots = [r.v for r in hash_sample(reps, "key", max(p.pivots, most), n).select("v").collect()]
    by_dims = {d: unit(np.array([v for v in pivots if len(v) == d], float)) for d in {len(v) for v in pivots}}
    held = spark.sparkContext.broadcast(by_dims)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector's codes, nearest pivot and angle to it."""
        for batch in batches:
            sizes = np.asarray(batch.column(0).value_lengths())
            for d in np.unique(sizes):
                part = batch.filter(pa.array(sizes == d))
                u = unit(matrix(part.column(0)))
                near = held.value.get(int(d))
                if near is None:  # a length that no pivot has: one cell of its own, never ruled out
                    own, angle = np.zeros(len(u), np.int64), np.full(len(u), math.pi)
                else:
                    cosine = u @ near.T
                    own = np.argmax(cosine, axis=1)
                    angle = np.arccos(np.clip(cosine[np.arange(len(u)), own], -1, 1))
                q, scale, error = quantised(u)
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), part.column(2), part.column(3), pa.array(np.full(len(u), d, np.int32)), pa.array(own.astype(np.int32)), pa.array(angle), pa.array(packed(q), pa.binary()), pa.array(scale), pa.array(error)],
                    names=["rep", "members", "key", "dims", "pivot", "angle", "q", "scale", "error"],
                )

    placed = cut(reps.select("v", "rep", "members", "key").mapInArrow(place, "rep long, members long, key long, dims int, pivot int, angle double, q binary, scale double, error double"), "placed")
    cells = placed.groupBy("dims", "pivot").agg(F.count("*").alias("in_cell"), F.max("angle").alias("radius"))  # bounded by the pivots
    # small cells share blocks: a block is a hash part of a large cell or a bundle of whole small ones
    bundles = max(1, math.ceil(n / p.block))
    named = placed.join(F.broadcast(cells), ["dims", "pivot"]).withColumn("loose", F.col("in_cell") < p.block // 2)
    part = F.pmod(F.xxhash64("key"), F.when(F.col("loose"), bundles).otherwise(F.ceil(F.col("in_cell") / p.block).cast("int")))
    named = named.withColumn("cell", F.when(F.col("loose"), -1).otherwise(F.col("pivot"))).withColumn("block", F.concat_ws("/", "dims", "cell", part))

    def gather(rows: pa.Table) -> pa.Table:
        own = rows.select(BLOCK.names).sort_by([("rep", "ascending"), ("key", "ascending")]).combine_chunks().cast(BLOCK)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, BLOCK) as out:
            out.write_table(own)
        return pa.table({"block": rows["block"][:1], "dims": rows["dims"][:1], "cell": rows["cell"][:1], "data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    blocks = cut(named.select("block", "dims", "cell", *BLOCK.names).groupBy("block").applyInArrow(gather, "block string, dims int, cell int, data binary"), "blocks")
    plan = cut(_tiles(blocks.select("block", "dims", "cell"), cells.where(F.col("in_cell") >= p.block // 2), by_dims, math.acos(p.threshold), blocks.count()), "plan")
    tasks = max(1, min(p.tasks, plan.select("tile").distinct().count()))
    found = cut(blocks.select("block", "data").join(plan, "block").repartition(tasks, "tile").groupBy("tile").applyInArrow(_tile(p), FOUND), "tiles")

    def components_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column(0).value_lengths())
            for d in np.unique(sizes):
                some = batch.filter(pa.array(sizes == d))
                yield pa.RecordBatch.from_arrays([some.column(1), some.column(2), pa.array(packed(unit(matrix(some.column(0)))), pa.binary())], names=["rep", "key", "u"])

    asked = found.where("tile is not null").select("tile", "rep", "key")
    wanted = reps.join(asked.select("rep", "key").distinct(), ["rep", "key"], "left_semi")
    full = wanted.select("v", "rep", "key").mapInArrow(components_of, "rep long, key long, u binary")
    unsure = asked.join(full, ["rep", "key"]).join(placed.select(*BLOCK.names), ["rep", "key"])
    settled = cut(unsure.withColumn("pair", F.expr("substring(tile, 3)")).groupBy("pair").applyInArrow(_settle(p), FOUND), "settled")
    every = found.where("tile is null").union(settled)
    totals = every.where("other is null").groupBy("rep", "key").agg(F.sum("n").alias("n"))
    components = connected_components(every.where("other is not null"), "rep", "other")
    known = reps.select("rep", "key", "key2", "members").join(totals, ["rep", "key"], "left").join(components, F.col("rep") == F.col("node"), "left")
    known = known.select("key", "key2", (F.coalesce("n", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    own = rows.select("vec_id", *[F.when(F.col("v").isNotNull(), h).alias(k) for h, k in zip(hashes, ("key", "key2"), strict=True)])
    out = own.join(known, ["key", "key2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))


def _tiles(outline: DataFrame, cells: DataFrame, pivots: dict[int, np.ndarray], reach: float, n: int) -> DataFrame:
    """(block, tile) for each pair of blocks that may hold a link, blocks paired with themselves included.

    Cells of two pivots may hold one only if the pivots' angle is at most what both radii and reach span. Bundles of
    small cells (cell -1) are compared with every block of their length; n blocks are paired in salted parts.
    """
    spark = outline.sparkSession
    radius = {d: np.zeros(len(v)) for d, v in pivots.items()}
    large = cells.select("dims", "pivot", "radius").collect()  # bounded by the pivots
    for r in large:
        if r.dims in radius:
            radius[r.dims][r.pivot] = r.radius
    held = spark.sparkContext.broadcast((pivots, radius))

    def near_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                points, span = (x.get(d) for x in held.value)
                other = np.zeros(1, np.int64)  # a length without pivots is one cell
                if points is not None:
                    apart = np.arccos(np.clip(points @ points[i], -1, 1))
                    other = np.flatnonzero((apart <= span + span[i] + reach + 1e-6) | (np.arange(len(points)) == i))
                    other = other[other >= i]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(other), v, np.int32)) for v in (d, i)] + [pa.array(other.astype(np.int32))], names=["dims", "cell", "cell2"])

    pairs = cells.select("dims", "pivot").repartition(max(1, len(large) // 64), "pivot").mapInArrow(near_cells, "dims int, cell int, cell2 int")
    other = outline.select(F.col("block").alias("block2"), "dims", F.col("cell").alias("cell2"))
    once = (F.col("cell") != F.col("cell2")) | (F.col("block") <= F.col("block2"))
    close = outline.join(pairs, ["dims", "cell"]).join(other, ["dims", "cell2"]).where(once).select("block", "block2")
    salts = max(1, n // 256)
    salted = outline.where("cell < 0").withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    loose = salted.join(other.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["dims", "salt"]).where(once).select("block", "block2")
    tile = F.concat_ws("|", F.least("block", "block2"), F.greatest("block", "block2"))
    return close.union(loose).select(F.explode(F.array_distinct(F.array("block", "block2"))).alias("block"), tile.alias("tile"))
