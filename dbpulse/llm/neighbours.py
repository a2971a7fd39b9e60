"""Approximate nearest neighbours: an inverted file with product-quantised residuals.

Coarse centroids and codebooks are trained on a bounded sample; every vector is
indexed, its residual as a code of its direction and a length, with the error that the
code leaves. A query scans its own list and those that promise it most by asymmetric distance tables
(exact query against coded residual). What the errors leave open is scored exactly on the
original vectors, where the codes are, so within the scanned lists nothing is missed. How many
lists are scanned follows from the true neighbours, among all vectors, of some of the
queries, so that the asked recall is that of the whole table and of the rows that ask, whatever
training saw; it is returned with the results. ``exact`` scans every list: then nothing is
approximate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hash_sample, ship
from .vectors import lengths, matrix, packed, unit, unpacked, usable


@dataclass(frozen=True)
class IvfParams:
    k: int = 20
    sample: int = 16_384  # vectors that training reads at most
    probes: int = 256  # queries whose neighbours among all vectors decide how many lists are scanned
    recall: float = 0.99  # asked of the scanned lists on these
    most_lists: int = 1024
    sub_dims: int = 2  # dimensions of a sub-quantiser, of up to 256 codes
    rounds: int = 8
    exact: bool = False  # every list is scanned
    part: int = 32_768  # vectors scanned together, at most
    least: int = 4_096  # and at least, where few vectors leave tasks to spare
    spread: int = 64  # tasks that few vectors are dealt to
    ask: int = 65_536  # queries in a task
    seed: int = 7


@dataclass(frozen=True)
class IvfIndex:
    coarse: np.ndarray  # (lists, dims)
    books: np.ndarray  # (sub-quantisers, codes, sub_dims), of residuals of length one
    reach: np.ndarray  # (lists,) root mean square of the residuals' lengths
    share: np.ndarray  # (lists,) of the sample
    wide: float = 0.0  # how much of its reach a list's promise counts
    probe: int = 1  # lists that a query scans
    recall: float = 1.0  # against all vectors, on the sample queries

    def promise(self, queries: np.ndarray) -> np.ndarray:
        """(queries, lists) for queries of length one: what a list's vectors may reach."""
        return queries @ self.coarse.T + self.wide * self.reach

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = _split(unit(x - self.coarse[lists]), self.books)
        return np.stack([_nearest(rest[:, m], self.books[m]) for m in range(len(self.books))], axis=1).astype(np.uint8)

    def decoded(self, codes: np.ndarray, dims: int) -> np.ndarray:
        return np.concatenate([self.books[m][codes[:, m]] for m in range(len(self.books))], axis=1)[:, :dims]

    def ways(self) -> np.ndarray:
        return unit(self.coarse)

    def gains(self, x: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What codes leave: the factor that brings each decoded direction nearest to its residual, the error along the centroid, that across it, and rounding."""
        rest, way = x - self.coarse[lists], self.decoded(codes, x.shape[1])
        gain = (rest * way).sum(axis=1) / np.maximum((way * way).sum(axis=1), 1e-300)
        left, centre = rest - gain[:, None] * way, self.ways()[lists]
        along = (left * centre).sum(axis=1)
        rounding = np.abs(gain) * (len(self.books) + 4) * 2e-7 + 1e-12 * (lengths(x) + lengths(self.coarse)[lists])  # tables are of single precision
        return gain, along, lengths(left - along[:, None] * centre), rounding


def _split(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    m, _, sub = books.shape
    return np.pad(x, ((0, 0), (0, m * sub - x.shape[1]))).reshape(len(x), m, sub)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centres * centres).sum(axis=1) / 2
    for at in range(0, len(x), 8192):
        out[at : at + 8192] = np.argmax(x[at : at + 8192] @ centres.T - half, axis=1)
    return out


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        counts = np.bincount(own, minlength=k)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
    return centres


def train(sample: np.ndarray, n: int, p: IvfParams) -> IvfIndex:
    """Centroids and codebooks, from a sample of n vectors."""
    rng = np.random.default_rng(p.seed)
    lists = max(1, min(p.most_lists, int(math.sqrt(n)), len(sample) // 8 or 1))
    coarse = _kmeans(sample, lists, p.rounds, rng)
    own = _nearest(sample, coarse)
    dims = sample.shape[1]
    m = -(-dims // p.sub_dims)
    rest = sample - coarse[own]
    counts = np.bincount(own, minlength=lists)
    reach = np.sqrt(np.bincount(own, (rest * rest).sum(axis=1), lists) / np.maximum(counts, 1))
    rest = _split(unit(rest), np.zeros((m, 1, p.sub_dims)))
    codes = min(256, len(sample))
    books = np.stack([_kmeans(rest[:, i], codes, p.rounds, rng) for i in range(m)])
    return IvfIndex(coarse, books, reach, counts / len(sample))


def measured(index: IvfIndex, reps: DataFrame, asking: int, scale: float, p: IvfParams) -> IvfIndex:
    """The index with as many scanned lists as the asked recall takes, measured against all vectors.

    The true neighbours of a bounded number of the queries are found in one pass over all vectors. The rank of each one's
    list decides how many lists are scanned, at worst all, and how much of its reach a list's promise counts is what
    then leaves the fewest vectors to scan.
    """
    h = F.xxhash64(F.lit(p.seed), "rep")
    drawn = reps.where("query")
    if asking > 4 * p.probes:
        drawn = drawn.where(h < int(-(1 << 63) + 2 * p.probes / asking * (1 << 64)))
    asked = drawn.select("rep", "v", "members").orderBy(h, "rep").limit(p.probes).toArrow()
    if not asked.num_rows:
        return index
    q, k, coarse = unit(matrix(asked["v"]) / scale), p.k, index.coarse
    own, alone = asked["rep"].to_numpy()[:, None], asked["members"].to_numpy()[:, None] == 1  # a query's copies are its neighbours

    def truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lists, scores = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
        for batch in batches:
            if batch.num_rows:
                x, here = matrix(batch.column(1)) / scale, batch.column(0).to_numpy()
                new = np.where(alone & (own == here), -np.inf, q @ x.T)
                add = [np.broadcast_to(a, new.shape) for a in (here, _nearest(x, coarse))]
                ids, lists, scores = (np.concatenate(c, axis=1) for c in ((ids, add[0]), (lists, add[1]), (scores, new)))
                top = np.lexsort((ids, -scores), axis=1)[:, :k]
                ids, lists, scores = (np.take_along_axis(a, top, axis=1) for a in (ids, lists, scores))
        who, col = np.nonzero(scores > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (who.astype(np.int32), ids[who, col], lists[who, col], scores[who, col])], names=["q", "rep", "list", "score"])

    best = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    found = reps.select("rep", "v").mapInArrow(truth, "q int, rep long, list long, score double").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    true = found.select("q", "list").toArrow()  # probes * k rows
    if not true.num_rows:
        return index
    who, lists = true["q"].to_numpy(), true["list"].to_numpy()
    home = _nearest(matrix(asked["v"]) / scale, coarse)[who]
    tried = []
    for wide in (0.0, 0.1, 0.2, 0.3, 0.5):
        ranked = np.argsort(-replace(index, wide=wide).promise(q), axis=1, kind="stable")
        rank = np.empty_like(ranked)
        np.put_along_axis(rank, ranked, np.arange(ranked.shape[1])[None, :], axis=1)
        need = np.sort(np.where(lists == home, 0, rank[who, lists]))  # a query's own list is scanned in any case
        probe = int(need[math.ceil(p.recall * len(need)) - 1]) + 1
        tried.append((float(index.share[ranked[:, :probe]].sum()), wide, probe, float((need < probe).mean())))
    _, wide, probe, recall = min(tried)
    return replace(index, wide=wide, probe=probe, recall=recall)


def adc(index: IvfIndex, centre: int | np.ndarray, queries: np.ndarray, codes: np.ndarray, gain: float | np.ndarray = 1.0) -> np.ndarray:
    """(queries, vectors) inner products by tables: the centroid's, and each sub-quantiser's at the vector's code."""
    tables = np.einsum("qms,mcs->mqc", _split(queries, index.books), index.books).astype(np.float32)
    coded = np.zeros((len(queries), len(codes)), np.float32)
    for m in range(codes.shape[1]):
        coded += np.take(tables[m], codes[:, m], axis=1)
    lists, which = np.unique(centre, return_inverse=True)
    return (queries @ index.coarse[lists].T)[:, which.reshape(-1)] + coded.astype(np.float64) * gain


def products(queries: np.ndarray, vectors: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Inner products of pairs in double precision, added component by component."""
    out = np.zeros(len(row))
    for a, b in zip(queries.T, vectors.T, strict=True):
        out += a[row].astype(np.float64) * b[col].astype(np.float64)
    return out


def scanned_part(index: IvfIndex, vectors: pa.Table, queries: pa.Table, kind, scale: float, k: int) -> pa.Table:
    """(query_rep, rep, score) of each query's k nearest among the vectors that lie in lists which it scans.

    A vector is scored exactly unless its coded product and error show that k others are nearer.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if vectors.num_rows and queries.num_rows:
        lists, ids, gain, along, off, rounding = (vectors[c].to_numpy() for c in ("list", "rep", "gain", "along", "off", "rounding"))
        codes, v = unpacked(vectors["codes"], np.uint8), unpacked(vectors["v"], kind)
        numbers, which = np.unique(lists, return_inverse=True)
        centres = index.ways()[numbers]
        who, raw = queries["query_rep"].to_numpy(), unpacked(queries["q"], kind)
        ways = unit(raw.astype(np.float64) / scale)
        promise = index.promise(ways)[:, numbers]
        probed = (promise >= queries["floor"].to_numpy()[:, None]) | (queries["home"].to_numpy()[:, None] == numbers)
        alike = np.argsort(promise.argmax(axis=1), kind="stable")  # queries of near lists together
        for at in range(0, len(alike), 128):
            block = alike[at : at + 128]
            some = np.flatnonzero(probed[block].any(axis=0)[which])
            if not len(some):
                continue
            q, hit = ways[block], probed[block][:, which[some]]
            # of a query's product with the error, the share along the centroid is known, so that near copies are told apart
            toward = q @ centres.T
            across = np.sqrt(np.maximum(0, ((q * q).sum(axis=1)[:, None] - toward * toward)) + 1e-14)[:, which[some]]
            near = adc(index, lists[some], q, codes[some], gain[some]) + toward[:, which[some]] * along[some]
            near = np.where(hit, near, -np.inf)
            least = np.full(len(q), -np.inf)
            if len(some) > k:
                first = np.argpartition(-near, min(2 * k, len(some) - 1), axis=1)[:, : 2 * k]
                sure = np.where(np.take_along_axis(hit, first, axis=1), np.einsum("qd,qnd->qn", q, v[some[first]].astype(np.float64) / scale), -np.inf)
                least = -np.partition(-sure, k - 1, axis=1)[:, k - 1]
            row, col = np.nonzero(hit & (near + across * off[some] + rounding[some] >= least[:, None]))
            col = some[col]
            score = products(raw[block], v, row, col)
            order = np.lexsort((ids[col], -score, row))
            place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
            order = order[place < k]
            out.append((who[block[row[order]]], ids[col[order]], score[order]))
    cat = lambda i, t: np.concatenate([o[i] for o in out]) if out else np.zeros(0, t)
    return pa.table({"query_rep": cat(0, np.int64), "rep": cat(1, np.int64), "score": cat(2, np.float64)})


def nearest(table: DataFrame, is_query: Column, params: IvfParams = IvfParams(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, sample_recall): for each row that is a query, its k nearest others by inner product.

    Nearest first, ties to the smaller vec_id; all candidates where there are fewer than k. Vectors that are null,
    empty, zero, or hold null or non-finite components take no part as query or candidate. Vectors of different
    lengths have no product: each length is searched by itself. Rows that repeat an id count as one, with the
    smallest vector (the shortest, then by components). sample_recall is what the search found of the neighbours of the
    queries that it was measured on. An empty table gives no rows.
    """
    spark = table.sparkSession
    ship(spark)
    kind = dict(table.dtypes)[vec_col]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind).alias("v"), F.coalesce(is_query, F.lit(False)).alias("query")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    twice = cut(rows.groupBy(F.col("vec_id").alias("twice")).count().where("count > 1").select("twice"), "twice")
    if not twice.isEmpty():  # only rows that repeat an id are compared as wholes
        again = rows.join(twice, F.col("vec_id") == F.col("twice"), "left_semi").groupBy("vec_id").agg(F.min(F.struct(F.size("v").alias("dims"), "v"))["v"].alias("v"), F.max("query").alias("query"))
        rows = rows.join(twice, F.col("vec_id") == F.col("twice"), "left_anti").unionByName(again)
    lengths = sorted(r.dims for r in rows.select(F.size("v").alias("dims")).distinct().collect())
    found = [_nearest_of(rows.where(F.size("v") == d), params) for d in lengths]
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, sample_recall double")


def _nearest_of(rows: DataFrame, p: IvfParams) -> DataFrame:
    """The search among vectors of one length.

    Equal vectors are searched once: of a class of equal vectors no result needs more than its k + 1 smallest ids.
    """
    spark = rows.sparkSession
    hashes = [F.xxhash64("v").alias("key"), F.xxhash64(F.lit(1), "v").alias("key2")]  # a class is known by two hashes of its vector
    reps = cut(rows.groupBy("v").agg(F.min("vec_id").alias("rep"), F.max("query").alias("query"), F.count("*").alias("members")).select("*", *hashes), "vectors")
    owned = cut(rows.select("vec_id", "query", *hashes).join(reps.select("key", "key2", "rep"), ["key", "key2"]).select("vec_id", "query", "rep"), "owned")
    sizes = reps.agg(F.sum("members").alias("n"), F.count("*").alias("classes"), F.count_if("query").alias("asking"), F.max(F.array_max(F.transform("v", F.abs))).cast("double").alias("largest")).first()
    n = sizes.n
    kind = np.float32 if dict(reps.dtypes)["v"] == "array<float>" else np.float64
    scale = sizes.largest
    found = hash_sample(reps.select("v", "rep"), "rep", p.sample, sizes.classes).select("v").toArrow()
    index = train(matrix(found["v"]) / scale, n, p)
    index = replace(index, probe=len(index.coarse)) if p.exact else measured(index, reps, sizes.asking, scale, p)
    held = spark.sparkContext.broadcast(index)
    groups = max(1, min(len(index.coarse), round(n / p.part)))  # near lists are scanned together, so that few groups hold what a query scans
    group_of = _nearest(index.coarse, _kmeans(index.coarse, groups, p.rounds, np.random.default_rng(p.seed))).astype(np.int32)
    grouped = spark.sparkContext.broadcast(group_of)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1)) / scale
                own = _nearest(x, held.value.coarse)
                codes = held.value.encode(x, own)
                left = held.value.gains(x, own, codes)
                raw = packed(matrix(batch.column(1), kind))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.astype(np.int32)), pa.array(packed(codes), pa.binary()), *map(pa.array, left), pa.array(raw, pa.binary()), pa.array(grouped.value[own])], names=["rep", "list", "codes", "gain", "along", "off", "rounding", "v", "grp"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each group that holds a list which the query scans, with the promise that its scanned lists reach."""
        for batch in batches:
            if batch.num_rows:
                promise = held.value.promise(unit(matrix(batch.column(1)) / scale))
                probe = min(held.value.probe, promise.shape[1])
                home = _nearest(matrix(batch.column(1)) / scale, held.value.coarse)  # its copies lie there
                floor = -np.partition(-promise, probe - 1, axis=1)[:, probe - 1] - 1e-9 * np.abs(promise).max(axis=1)  # products round apart in other tasks
                hit = np.zeros((len(promise), groups), bool)
                q, lists = np.nonzero(promise >= floor[:, None])
                hit[q, grouped.value[lists]] = True
                hit[np.arange(len(home)), grouped.value[home]] = True
                q, group = np.nonzero(hit)
                raw = packed(matrix(batch.column(1), kind))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(q)), pa.array(group.astype(np.int32)), pa.array(floor[q]), pa.array(home[q].astype(np.int32)), pa.array([raw[i] for i in q], pa.binary())], names=["query_rep", "grp", "floor", "home", "q"])

    coded = cut(reps.select("rep", "v").mapInArrow(code, "rep long, list int, codes binary, gain double, along double, off double, rounding double, v binary, grp int"), "codes")
    asked = cut(reps.where("query").select("rep", "v").repartition("rep").mapInArrow(spread, "query_rep long, grp int, floor double, home int, q binary"), "asked")
    # a group with many vectors is dealt to parts, each of which sees the group's queries, very many of them in turns
    part = min(p.part, max(p.least, -(-n // p.spread)))
    turns = asked.groupBy("grp").agg(F.ceil(F.count("*") / p.ask).cast("int").alias("turns"))
    parts = cut(coded.groupBy("grp").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")).join(turns, "grp"), "parts")
    in_all = max(1, parts.agg(F.sum(F.col("parts") * F.col("turns"))).first()[0] or 1)
    each = lambda most: F.explode(F.sequence(F.lit(0), F.col(most) - 1))
    of = lambda key, most: F.pmod(F.xxhash64(key), F.col(most)).cast("int")
    dealt = coded.join(F.broadcast(parts), "grp").select("rep", "list", "codes", "gain", "along", "off", "rounding", "v", "grp", of("rep", "parts").alias("part"), each("turns").alias("turn"))
    sent = asked.join(F.broadcast(parts), "grp").select("query_rep", "grp", "floor", "home", "q", of("query_rep", "turns").alias("turn"), each("parts").alias("part"))

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        return scanned_part(held.value, left, right, kind, scale, p.k + 1)

    # a scan is much work on few bytes: a task for each, which adaptive execution would gather by size
    keys = ["grp", "part", "turn"]
    left_side, right_side = (df.repartition(2 * in_all, *keys).groupBy(*keys) for df in (dealt, sent))
    scanned = left_side.cogroup(right_side).applyInArrow(scan, "query_rep long, rep long, score double")
    exact = Window.partitionBy("query_rep").orderBy(F.desc("score"), "rep")
    scored = scanned.withColumn("r", F.row_number().over(exact)).where(F.col("r") <= p.k + 1).drop("r")
    least = Window.partitionBy("rep").orderBy("vec_id")
    members = owned.select("rep", "vec_id").withColumn("r", F.row_number().over(least)).where(F.col("r") <= p.k + 1).drop("r")
    order = Window.partitionBy("query_rep").orderBy(F.desc("score"), "vec_id")
    named = scored.join(members, "rep").withColumn("r", F.row_number().over(order)).where(F.col("r") <= p.k + 1).select("query_rep", "vec_id", "score")
    asking = owned.where("query").select(F.col("rep").alias("query_rep"), F.col("vec_id").alias("query_id"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = asking.join(named, "query_rep").where("query_id <> vec_id").withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= p.k)
    return ranked.select("query_id", "rank", "vec_id", "score", F.lit(index.recall).alias("sample_recall"))
