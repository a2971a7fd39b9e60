"""MinHash near-duplicates by min-max hashing.

Every permutation is evaluated once per shingle and gives two signature values,
its minimum and its maximum. A band joins the values of a few permutations;
documents that share a band are candidates, and each candidate pair is confirmed
on the full shingle sets of both documents, whose words are told apart by their
bytes. Hashes only find candidates.

Plan: (1) one Arrow pass signs each document; equal sequences of words are one class
from here on. (2) Classes that share a band meet at the band's smallest id, and chains of
such meetings are candidate groups. (3) Each group is compared exactly, on full
sets, in blocks within tasks: no pair is a row anywhere, and a tile returns only
the links that span what it found. Members of a large group are first compared with
a few leaders; what these join needs no comparison within itself, so only the rest
meets the whole group, dealt to tiles by size class and hash. (4) Components of the
links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if, cut, ship
from .components import connected_components
from .textvec import buffers, exact_sets, fold_words, mix, seeds, shingle_sets, words


@dataclass(frozen=True)
class MinMaxParams:
    shingle: int = 5
    percent: int = 80  # links have 100 * intersection >= percent * union
    perms_per_band: int = 3  # each gives two values of the band
    miss: float = 1.2e-5  # chance that a pair of just the asked similarity shares no band
    block: int = 512  # members of a group compared with as many others in a task
    bucket: int = 256  # members of small groups in a bucket, about
    leaders: int = 16  # of a large group, that its members are compared with first
    broadcast_rows: int = 500_000  # of 40 bytes, sent to every executor at most; beyond, the join shuffles

    @property
    def bands(self) -> int:
        """As many as ``miss`` asks for: 24 at 85 percent, 38 at 80."""
        shared = (self.percent / 100) ** (2 * self.perms_per_band)
        return 1 if shared >= 1 else math.ceil(math.log(self.miss) / math.log(1 - shared))


def signatures(sets: np.ndarray, offsets: np.ndarray, perms: int) -> np.ndarray:
    """(2 * perms, documents): minimum and maximum of each permutation over each non-empty set."""
    mult, add = seeds(perms, 5000) | np.uint64(1), seeds(perms, 9000)
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((2 * perms, len(offsets) - 1), np.uint64)
    step = 1 << 15
    at = 0
    while at < len(full):
        to = max(at + 1, int(np.searchsorted(offsets[full], offsets[full[at]] + step)))
        rows = full[at:to]
        lo, hi = offsets[rows[0]], offsets[rows[-1] + 1]
        part, cuts = sets[lo:hi], offsets[rows] - lo
        for k in range(perms):
            values = part * mult[k]
            values += add[k]
            out[2 * k, rows] = np.minimum.reduceat(values, cuts)
            out[2 * k + 1, rows] = np.maximum.reduceat(values, cuts)
        at = to
    return out


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """(documents, bands) keys; the band's number is part of the key."""
    rows = len(sig) // bands
    weights = seeds(rows, 20000) | np.uint64(1)
    out = np.empty((sig.shape[1], bands), np.uint64)
    for b in range(bands):
        key = np.full(sig.shape[1], b + 1, np.uint64)
        for i in range(rows):
            key = mix(key + sig[b * rows + i] * weights[i])
        out[:, b] = key
    return out


def _signer(p: MinMaxParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = fold_words()
        for batch in batches:
            ids = batch.column(0)
            for raw, offsets, at in buffers(batch.column(1)):
                n, data = len(offsets) - 1, raw.tobytes()
                texts = [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                sets, cuts = shingle_sets(words(raw, offsets, fold), p.shingle, texts)
                keys = band_keys(signatures(sets, cuts, p.bands * p.perms_per_band), p.bands)
                sizes = np.diff(cuts)
                marks = np.frombuffer(b"".join(blake2b(b" ".join(t.lower().split()), digest_size=16).digest() for t in texts), np.int64).reshape(n, 2)
                digest = [np.ascontiguousarray(marks[:, i]) for i in (0, 1)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * p.bands), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, n), pa.array(sizes), *map(pa.array, digest), lists],
                    names=["doc_id", "n_shingles", "d1", "d2", "bands"],
                )

    return run


def spanning_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between members of ``left`` and ``right`` (numbers into ``sets``) that join what isn't joined yet.

    All pairs are compared, exactly: intersections are products of 0/1 rows over the shingles that more than one
    set holds, a slice of shingles at a time. A link is left out only where others join its ends already.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    used = np.unique(np.concatenate([left, right]))
    owner = np.repeat(used, sizes[used])
    values, column, counts = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
    keep = counts[column] > 1
    owner, column = owner[keep], column[keep]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], (np.cumsum(counts > 1) - 1)[column[order]]
    at_left, at_right = np.full(len(sets), -1), np.full(len(sets), -1)
    at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
    common = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    for lo in range(0, int(counts[counts > 1].size), width):
        a, b = np.searchsorted(column, [lo, lo + width])
        bits = [np.zeros((len(side), width), np.float32) for side in (left, right)]
        for side, where in zip(bits, (at_left, at_right), strict=True):
            rows = where[owner[a:b]]
            side[rows[rows >= 0], column[a:b][rows >= 0] - lo] = 1
        common += bits[0] @ bits[1].T
    inter = common.astype(np.int64)
    x, y = np.nonzero(100 * inter >= percent * (sizes[left][:, None] + sizes[right][None, :] - inter))
    x, y = left[x], right[y]
    x, y = x[x != y], y[x != y]
    label, found = np.arange(len(sets)), []
    while len(x):
        found.append((int(x[0]), int(y[0])))
        label[label == label[x[0]]] = label[y[0]]
        open_still = label[x] != label[y]
        x, y = x[open_still], y[open_still]
    return found


def _comparer(p: MinMaxParams):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("grp", "ascending"), ("rep", "ascending")])
        groups, reps, sides = rows["grp"].to_numpy(), rows["rep"].to_numpy(), rows["side"].to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1], [True]]))
        a, b = [], []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            numbers = np.arange(hi - lo)
            side = sides[lo:hi]
            sets = exact_sets([t.encode() for t in rows["text"].slice(lo, hi - lo).to_pylist()], p.shingle)
            for i, j in spanning_links(sets, numbers[side != 1], numbers[side != 0], p.percent):
                a.append(reps[lo + i])
                b.append(reps[lo + j])
        return pa.table({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def _tile(name: Column, side: Column | int) -> Column:
    """Where a member is compared: side 0 is a tile's left, 1 its right, 2 both."""
    return F.struct(name.alias("tile"), (F.lit(side) if isinstance(side, int) else side).alias("side"))


def _leading_tiles(p: MinMaxParams) -> Column:
    """Every member of a large group in a block of its own, and the leaders in all blocks."""
    parts = F.ceil(F.col("members") / p.block).cast("int")
    name = lambda k: F.concat_ws("/", F.col("grp"), F.lit("lead"), k)
    own = F.array(_tile(name(F.pmod(F.xxhash64("rep"), parts)), 1))
    lead = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: _tile(name(k), 0))
    return F.explode(F.when(F.col("lead"), F.concat(own, lead)).otherwise(own))


def _open_tiles() -> Column:
    """Open members (left) with all members (right) of a large group.

    Both are dealt by size class, where sets of two classes that aren't neighbours can't be similar enough, and then
    by a hash; each open block meets each block of the same or a neighbouring class.
    """
    near = F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)
    name = lambda c, i, d, j: F.concat_ws("/", F.col("grp"), c, i, d, j)
    as_member = F.flatten(F.transform(near, lambda c: F.transform(F.sequence(F.lit(0), F.col("open_blocks") - 1), lambda i: _tile(name(c, i, F.col("class"), F.pmod(F.xxhash64("rep"), F.col("blocks"))), 1))))
    as_open = F.flatten(F.transform(near, lambda c: F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: _tile(name(F.col("class"), F.pmod(F.xxhash64(F.lit(1), "rep"), F.col("open_blocks")), c, j), 0))))
    return F.explode(F.when(F.col("open"), F.concat(as_member, as_open)).otherwise(as_member))


def near_duplicates(docs: DataFrame, params: MinMaxParams = MinMaxParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row with an id.

    Null or empty texts and texts of white space have no shingles, link with nothing and are
    kept. Rows that repeat a doc_id count once per row; a null doc_id is left out, as nothing
    could refer to it. Other columns are not read.
    """
    p = params
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    signed = cut(
        texts.mapInArrow(_signer(p), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"),
        "signed",
    )
    classes = cut(signed.where("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    bands = signed.select("doc_id", "d1", "d2", "n_shingles", "bands").join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "d1", "d2", "n_shingles"], "left_semi")
    members = bands.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("key"))
    firsts = members.groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first <> last").drop("last")
    meet = members.join(firsts, "key").where("rep <> first").select("rep", "first")
    groups = cut(connected_components(meet, "rep", "first"), "groups")  # candidates that a chain of shared bands joins
    plan = groups.select(F.col("node").alias("rep"), F.col("component").alias("grp")).join(classes.select("rep", F.col("n_shingles").alias("n")), "rep")
    step = -np.log(p.percent / 100) * (1 + 1e-9)  # a little more than the similarity allows, against rounding
    plan = plan.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / F.lit(float(step))).cast("int"))
    sizes = plan.groupBy("grp").agg(F.count("*").alias("members"))
    plan = cut(plan.join(sizes, "grp").select("rep", "grp", "class", "members"), "plan")
    n = plan.count()

    def compared(members: DataFrame, count: int, at: Column) -> DataFrame:
        """The spanning links of the tiles that ``at`` deals members to."""
        asked = texts.join(broadcast_if(members.withColumnRenamed("rep", "doc_id"), count, p.broadcast_rows), "doc_id")
        spread = asked.withColumnRenamed("doc_id", "rep").select("rep", "grp", "text", at.alias("at")).select("rep", "grp", "text", "at.tile", "at.side")
        return cut(spread.groupBy("tile").applyInArrow(_comparer(p), "a long, b long"), "links")

    bucket = F.explode(F.array(_tile(F.concat_ws("/", F.lit("bucket"), F.pmod(F.xxhash64("grp"), F.lit(max(1, n // p.bucket)))), 2)))
    links = compared(plan.where(F.col("members") <= p.block), n, bucket)
    large = plan.where(F.col("members") > p.block)
    if m := large.count():
        rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.xxhash64("rep"), "rep"))
        leaders = large.withColumn("r", rank).where(F.col("r") <= p.leaders).select(F.col("rep").alias("leader"))
        led = cut(large.join(leaders, F.col("rep") == F.col("leader"), "left").select("rep", "grp", "members", F.col("leader").isNotNull().alias("lead")), "led")
        found = compared(led, m, _leading_tiles(p))
        # the component that joins most of a group is settled within itself; everything else is open
        joined = cut(large.join(connected_components(found), F.col("rep") == F.col("node"), "left").select("rep", "grp", "class", "component"), "joined")
        most = joined.where("component is not null").groupBy("grp", "component").agg(F.count("*").alias("k")).groupBy("grp").agg(F.max(F.struct("k", "component"))["component"].alias("settled"))
        state = joined.join(most, "grp", "left").select("rep", "grp", "class", (~F.coalesce(F.col("component") == F.col("settled"), F.lit(False))).alias("open"))
        of_class = state.groupBy("grp", "class").agg(F.count("*").alias("k"), F.count_if("open").alias("o"))
        blocks = of_class.groupBy("grp").agg(F.ceil(F.max("k") / p.block).cast("int").alias("blocks"), F.ceil(F.max("o") / p.block).cast("int").alias("open_blocks"))
        near = of_class.where("o > 0").select("grp", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("class")).distinct()
        rest = cut(state.join(near, ["grp", "class"], "left_semi").join(blocks, "grp").select("rep", "grp", "class", "open", "blocks", "open_blocks"), "open")
        links = links.union(found)
        if k := rest.count():
            links = links.union(compared(rest, k, _open_tiles()))
    components = cut(connected_components(links), "components")
    reached = classes.join(components, F.col("rep") == F.col("node"), "left").select("d1", "d2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "d1", "d2").join(reached, ["d1", "d2", "n_shingles"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))
