"""Prefix trie of conversations by Patricia construction.

A conversation is a key: 40 bytes for each turn, the SHA-256 of role and text and
the text's length. Equal keys are one row from here on. Keys are sorted and dealt to
parts by ranges, and each part is read once, in order, with a stack of the points
above the current key: ends, leaves and branches, joined by edges of any length.
Counts and sums are of points only; when a point is left, the turns of the edge above
it, which have one child each, follow from it by adding up the edge from below.

What several parts share are the prefixes on both sides of their borders. A part
gives its share of these by digest, and one small aggregate adds the shares up. The
sums are made so that shares add: what a subtree saves is the bytes of all its
members' turns less the bytes of its nodes, and a node's bytes belong to the part
in which its first member lies.

A conversation's key is held whole by the task that reads it; texts never are.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if, cut, ship
from .dealing import bounds, part_of

UNIT = 40
PER_PART = 256  # distinct conversations in a part, about
ID_BLOCK = 12  # bits of ids that are joined to one text before members are hashed
BROADCAST_ROWS = 500_000  # shared prefixes of 80 bytes, sent to every executor at most; beyond, the join shuffles
NO_ENDS = sha256(b"").hexdigest()


def sequences(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns) of every id: its turns' units in hexadecimal, by turn, null first.

    Null role or text counts as empty. Turns with one number are ordered by their units; rows without an id are left out.
    Other columns are not read.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    unit = F.concat(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), F.lpad(F.hex(F.octet_length(text)), 16, "0"))
    number = F.col(turn_col).cast("long")
    rows = conversations.select(F.col(id_col).cast("long").alias("conv_id"), number.isNotNull().alias("given"), F.coalesce(number, F.lit(0)).alias("turn"), unit.alias("unit")).where("conv_id is not null")
    ordered = F.array_sort(F.collect_list(F.struct("given", "turn", "unit")))  # collected per task before the shuffle
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: t["unit"]).alias("turns"))


def with_shared_openings(rows: DataFrame, every: int = 5, most: int = 8) -> DataFrame:
    """The sequences in which each conversation's first h turns are those of the one at the multiple of ``every`` below.

    h is the unsigned checksum of the id modulo ``most`` + 1. Where the other has fewer turns all of them are taken, and none where it is absent.
    """
    heads = rows.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    both = rows.withColumn("h", h).join(heads, F.col("conv_id") - F.col("conv_id") % every == F.col("base"), "left")
    head = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), F.col("h"))
    return both.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def shared_turns(a: bytes, b: bytes) -> int:
    """How many turns two keys share from the start."""
    n = min(len(a), len(b)) // UNIT
    lo, step = 0, 1
    while lo < n:
        m = min(step, n - lo)
        if a[lo * UNIT : (lo + m) * UNIT] == b[lo * UNIT : (lo + m) * UNIT]:
            lo, step = lo + m, 2 * step
        elif m == 1:
            break
        else:
            step = max(1, m // 2)
    return lo


class _Point:
    """An end, a leaf or a branch: its members, and what lies below it."""

    __slots__ = ("depth", "n", "least", "leaves", "children", "below", "turns", "distinct", "ends", "waiting")

    def __init__(self, depth: int, n: int = 0, least: int | None = None, ends: str | None = None):
        self.depth, self.n, self.least, self.ends = depth, n, least, ends
        self.leaves = self.children = self.below = self.turns = self.distinct = 0
        self.waiting: list[int] = []  # rows whose parent this is


_NODES = "depth long, conv_id long, n_convs long, n_children long, n_leaves long, turns long, distinct long, ends string, shared binary, parent_conv_id long, parent binary"
_KINDS = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in _NODES.split(", ")]


class _Part:
    """The nodes of the ascending keys of one part, of which ``left`` turns of the first and ``right`` of the last go on in other parts; -1 where no part follows."""

    def __init__(self, left: int, right: int):
        self.left, self.right = left, right
        self.stack: list[_Point] = []
        self.key, self.as_first, self.last = b"", -1, False
        self.marks: list[list[bytes]] = [[], []]  # digests of the shared prefixes of the first and the last key
        self.out: list[list] = []

    def add(self, key: bytes, conv_id: int, n: int, ends: str) -> None:
        if self.stack:
            shared = shared_turns(self.key, key)
            self._leave(shared)
            self.as_first = min(self.as_first, shared)
        else:
            self.as_first = len(key) // UNIT
            self.marks[0] = self._digests(key, self.left)
        self.key = key
        self.stack.append(_Point(len(key) // UNIT, n, conv_id, ends))

    def close(self) -> list[list]:
        self.last = True
        self.marks[1] = self._digests(self.key, self.right)
        self._leave(0)
        root = self.stack.pop()
        self._row(root, 0, root.children, root.leaves or int(not root.below and self.right < 0), root.turns, root.distinct)
        self._settle(root)
        return self.out

    @staticmethod
    def _digests(key: bytes, most: int) -> list[bytes]:
        running, out = sha256(), []
        for d in range(most + 1):
            running.update(key[max(0, d - 1) * UNIT : d * UNIT])
            out.append(running.copy().digest())
        return out

    def _mark(self, depth: int) -> bytes | None:
        """The digest of the current key's prefix if other parts share it."""
        if depth <= min(self.left, self.as_first):
            return self.marks[0][depth]
        return self.marks[1][depth] if self.last and depth <= self.right else None

    def _owned(self, depth: int) -> int:
        return int(depth > min(self.left, self.as_first))

    def _row(self, p: _Point, depth: int, children: int, leaves: int, turns: int, distinct: int) -> int:
        self.out.append([depth, p.least, p.n, children, leaves, turns, distinct, p.ends if depth == p.depth else None, self._mark(depth), None, None])
        return len(self.out) - 1

    def _settle(self, p: _Point) -> None:
        """Tells the rows below a point who their parent is, now that all its members are known."""
        mark = self._mark(p.depth)
        for at in p.waiting:
            self.out[at][-2:] = (None, mark) if mark else (p.least, None)

    def _leave(self, shared: int) -> None:
        """Closes the points deeper than ``shared`` and makes the one at that depth, if there is none."""
        while self.stack[-1].depth > shared:
            p = self.stack.pop()
            up = max(shared, self.stack[-1].depth if self.stack else -1)
            leaves = p.leaves or int(not p.below and not (self.last and p.depth <= self.right))
            turns, distinct, children = p.turns, p.distinct, p.children
            for depth in range(p.depth, up, -1):  # the point, then the turns of the edge above it
                size = int.from_bytes(self.key[depth * UNIT - 8 : depth * UNIT], "big")
                turns, distinct = turns + p.n * size, distinct + size * self._owned(depth)
                at = self._row(p, depth, children, leaves, turns, distinct)
                if depth == p.depth:
                    self._settle(p)
                else:
                    mark = self._mark(depth)
                    self.out[at - 1][-2:] = (None, mark) if mark else (p.least, None)
                children = self._owned(depth)
            if not self.stack or self.stack[-1].depth < up:
                self.stack.append(_Point(up))
            above = self.stack[-1]
            above.n, above.least = above.n + p.n, p.least if above.least is None else min(above.least, p.least)
            above.leaves, above.turns, above.distinct = above.leaves + leaves, above.turns + turns, above.distinct + distinct
            above.children, above.below = above.children + children, above.below + 1
            above.waiting.append(at)


def _walk(borders: dict[int, tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part = None, None
        names = [c.split()[0] for c in _NODES.split(", ")]
        as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=names)
        for batch in batches:
            for to, key, conv_id, n, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if to != number:
                    if part is not None:
                        yield as_batch(part.close())
                    number, part = to, _Part(*borders[to])
                part.add(key, conv_id, n, ends)
        if part is not None:
            yield as_batch(part.close())

    return run


def _border(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([-1 if b is None else shared_turns(a, b) for a, b in both], pa.int64())], names=["part", "shared"])


def _hash_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each class's ids, from blocks of them in order; a class of any size is a stream."""
    name, running = None, sha256()
    for batch in batches:
        done = []
        for cls, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if cls != name:
                if name is not None:
                    done.append((name, running.hexdigest()))
                name, running = cls, sha256(ids.as_py().encode())
            else:
                running.update(b"," + ids.as_py().encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], names=["cls", "ends"])
    if name is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, running.hexdigest())], names=["cls", "ends"])


def _ends(keyed: DataFrame) -> DataFrame:
    """(cls, ends): the digest of the ascending ids, comma-joined, of each class."""
    blocks = keyed.groupBy("cls", F.shiftright("conv_id", ID_BLOCK).alias("block")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    texts = blocks.select("cls", "block", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    ordered = texts.repartition("cls").sortWithinPartitions("cls", "block")
    return ordered.select("cls", "ids").mapInArrow(_hash_members, "cls string, ends string")


def prefix_trie(rows: DataFrame, turns: Column | str = "turns") -> DataFrame:
    """The nodes of the trie of ``rows`` (conv_id, turns), ids being distinct; see ``sequences``.

    Per node: conv_id (its smallest member), depth, parent_conv_id (its parent's; null for the root), n_convs, n_children, n_leaves
    (childless nodes below it, itself included), saved_tokens (summed over the nodes below it, itself included, all
    but one member's bytes of the node's turn) and ends_sha256 (of the members that end there). Without conversations there is no node.
    """
    ship(rows.sparkSession)
    key = F.unhex(F.array_join(turns, ""))
    keyed = cut(rows.select("conv_id", key.alias("key")).withColumn("cls", F.sha2("key", 256)), "sequences")
    classes = keyed.groupBy("cls", "key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
    classes = cut(classes.join(_ends(keyed), "cls").select("key", "conv_id", "n", "ends"), "classes")
    cuts = bounds(classes, "key", PER_PART)
    dealt = cut(classes.withColumn("at", part_of(F.col("key"), cuts, "binary")).select("at.part", "key", "conv_id", "n", "ends"), "dealt")
    ranges = dealt.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))  # a row for each part
    after = ranges.select("part", "high", F.lead("low").over(Window.orderBy("part")).alias("next")).mapInArrow(_border, "part int, shared long")
    right = {r.part: r.shared for r in after.collect()}
    borders = {p: (right.get(p - 1, -1), s) for p, s in right.items()}
    nodes = cut(dealt.repartition("part").sortWithinPartitions("part", "key").mapInArrow(_walk(borders), _NODES), "nodes")
    sums = [F.sum(c).cast("long").alias(c) for c in ("n_convs", "n_children", "n_leaves", "turns", "distinct")]
    merged = cut(nodes.where("shared is not null").groupBy("shared").agg(F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums, F.max("ends").alias("ends"), F.max("parent").alias("parent")), "shared")
    whole = nodes.where("shared is null").unionByName(merged.withColumn("parent_conv_id", F.lit(None).cast("long")))
    above = broadcast_if(merged.select(F.col("shared").alias("parent"), F.col("conv_id").alias("of_parent")), merged.count(), BROADCAST_ROWS)
    known = whole.where("parent is null")
    found = whole.where("parent is not null").drop("parent_conv_id").join(above, "parent").withColumnRenamed("of_parent", "parent_conv_id")
    out = known.unionByName(found)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("turns") - F.col("distinct")).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))
