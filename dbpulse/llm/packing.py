"""Best-fit packing of documents into token sequences, improved by swap-based local search.

Documents become pieces of at most ``capacity`` tokens; full pieces are
sequences of their own. The others are dealt by a hash into groups of bounded
size. Each group is packed best-fit by decreasing length; then pieces are moved
or exchanged one-for-one and two-for-one between underfull bins whenever that
raises the sum of squared fills, so that the emptiest bins drain and vanish.
A second pass packs what the groups' last, underfull bins hold.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship, shipped_file, tokenizer_path
from .textvec import buffers, fold_words, hash_spans, mix, spans
from .wordcache import WordCache, of_worker


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECE_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]
#: Texts on which the words' ids end to end must be those of the tokenizers library.
PROBES = [
    "", " ", "Hello world", "two  blanks\n\ttab", "don't stop. It's", "a.b, c", "1,234.5", "é.", "Ünïcödé STRASSE ﬁ Å", "İ,", "日本語 テキスト。", "emoji 👩‍👩‍👧.", "x<|endoftext|>y", "...", "(a) [b] {c}",
    "https://example.com/?q=1&x=%20", "a\x00b \x01c", "tail ", "'s.", "é combining", "x" * 300,
]


@dataclass(frozen=True)
class PackParams:
    capacity: int = 4096
    tokenizer: str | None = None  # a tokenizers file; the public word BPE where none is given
    end_id: int = 1  # follows each document's ids
    group: int = 8000  # pieces packed together, about
    partners: int = 64  # emptiest underfull bins that a bin is offered in a round; this bounds time, no piece depends on it
    nearly: float = 0.98  # bins filled less than this are underfull
    chunk: int = 1 << 20  # bytes of text encoded together


def text_encoder(key: str, data: bytes) -> "TextEncoder":
    """The worker's encoder for a tokenizers file; only one whose ids can be put together word by word."""

    def made() -> TextEncoder:
        encoder = TextEncoder(data)
        encoder.verify()
        return encoder

    return of_worker(("packing", key), made)


class TextEncoder:
    """Ids of whole texts by a tokenizers file like the public word BPE.

    That one composes characters (NFC), makes white space single blanks, lowers case and drops blanks in its
    split, so no token crosses white space; its split also never joins a letter or digit with punctuation, so a
    point or comma that ends a word is a word of its own. A text's ids are its words' ids end to end.
    """

    def __init__(self, source: str | bytes):
        """``source`` is the tokenizers file, or its bytes."""
        from tokenizers import Tokenizer

        t = Tokenizer.from_buffer(source) if isinstance(source, bytes) else Tokenizer.from_file(source)
        self._whole = lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        self._cache = WordCache(self._whole)
        self._fold = fold_words()
        self._plain = np.zeros(256, bool)
        self._plain[[*range(48, 58), *range(97, 123)]] = True

    def verify(self) -> None:
        """Raises unless whole texts get the same ids from the library."""
        raw = [t.encode() for t in PROBES]
        got = self.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        for text, ids, want in zip(PROBES, got, self._whole(PROBES), strict=True):
            if ids.tolist() != want:
                raise ValueError(f"this tokenizer's ids can't be put together word by word: {text[:40]!r}")

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text of a chunk."""
        n = len(offsets) - 1
        if not len(raw):
            return [np.zeros(0, np.uint32)] * n
        starts, ends, low = spans(raw, offsets, self._fold)
        last = low[ends - 1]
        stop = ((last == 46) | (last == 44)) & (ends - starts > 1)
        stop &= self._plain[low[ends - 2]]
        points = ends[stop] - 1
        ends = ends - stop
        starts, ends = np.concatenate([starts, points]), np.concatenate([ends, points + 1])
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
        ids, lengths = self._cache.encode(raw, starts, ends, hash_spans(low, starts, ends), low)
        at = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(starts, offsets)]
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _tokenize(p: PackParams, key: str, data):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(key, data.value)
        end = np.array([p.end_id], np.uint32)
        task, seen = np.uint64(TaskContext.get().partitionId()), 0
        for batch in batches:
            for raw, offsets, at in buffers(batch.column(1), p.chunk):
                row, k, start, n, crc = [], [], [], [], []
                for i, ids in enumerate(encoder.encode(raw, offsets)):
                    ids = np.concatenate([ids, end]).astype("<u4")
                    for piece, lo in enumerate(range(0, len(ids), p.capacity)):
                        part = ids[lo : lo + p.capacity]
                        row.append(at + i)
                        k.append(piece)
                        start.append(lo)
                        n.append(len(part))
                        crc.append(zlib.crc32(part))
                # pieces are dealt to groups by where they come from, so that no id or text, however frequent, gathers in one
                deal = mix(np.arange(seen, seen + len(row), dtype=np.uint64) + (task << np.uint64(40)))
                seen += len(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(deal.view(np.int64))],
                    names=[*PIECE_COLUMNS, "deal"],
                )

    return run


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of piece numbers."""
    bins: list[list[int]] = []
    at_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # ascending, those with a bin
    for n in np.argsort(-lengths, kind="stable"):
        need = int(lengths[n])
        i = bisect_left(rooms, need)
        if i < len(rooms):
            room = rooms[i]
            b = at_room[room].pop()
            if not at_room[room]:
                del at_room[room]
                rooms.pop(i)
            bins[b].append(int(n))
        else:
            room, b = capacity, len(bins)
            bins.append([int(n)])
        if left := room - need:
            if left not in at_room:
                at_room[left] = []
                insort(rooms, left)
            at_room[left].append(b)
    return bins


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int, nearly: float, partners: int = PackParams.partners) -> list[list[int]]:
    """Moves and exchanges between underfull bins, each raising the sum of squared fills; emptied bins go.

    Bins are taken from the fullest underfull one down. Into its room goes, from the emptiest bins, whichever of
    these fills it best: a piece that fits (move), a larger piece for one of its own (one-for-one), or two pieces
    for one of its own (two-for-one). What it takes in always weighs more than what it gives, and it was the fuller
    bin, so squared fill grows with every step and the search ends.
    """
    size = lambda b: sum(int(lengths[n]) for n in b)
    changed = True
    while changed:
        fills = [size(b) for b in bins]
        under = sorted((i for i, f in enumerate(fills) if f < nearly * capacity), key=lambda i: (-fills[i], i))
        changed = False
        lo, hi = 0, len(under) - 1
        while lo < hi:
            a = under[lo]
            for j in range(hi, max(lo, hi - partners), -1):
                b = under[j]
                if fills[a] == capacity:
                    break
                while bins[b] and fills[a] < capacity and (step := _best_step(bins[a], bins[b], lengths, capacity - fills[a])):
                    gives, takes = step
                    gain = sum(int(lengths[n]) for n in takes) - sum(int(lengths[n]) for n in gives)
                    if not gives and not takes or gain <= 0 or fills[a] < fills[b]:
                        break
                    for n in gives:
                        bins[a].remove(n)
                        bins[b].append(n)
                    for n in takes:
                        bins[b].remove(n)
                        bins[a].append(n)
                    fills[a] += gain
                    fills[b] -= gain
                    changed = True
            while hi > lo and not bins[under[hi]]:
                hi -= 1
            lo += 1
        bins = [b for b in bins if b]
    return bins


def _best_step(a: list[int], b: list[int], lengths: np.ndarray, room: int) -> tuple[list[int], list[int]] | None:
    """What the fuller bin a gives to b and takes from it, so that it gains the most within its room."""
    mine: dict[int, int | None] = {0: None} | {int(lengths[n]): n for n in a}  # one of each length
    theirs = sorted((int(lengths[n]), n) for n in b)
    sizes = [x for x, _ in theirs]
    best, step = 0, None
    for own, n in mine.items():
        if min(room + own, sizes[-1] + (sizes[-2] if len(sizes) > 1 else 0)) - own <= best:
            continue
        most = room + own
        i = bisect_left(sizes, most + 1) - 1
        if i >= 0 and sizes[i] - own > best:
            best, step = sizes[i] - own, ([] if n is None else [n], [theirs[i][1]])
        lo, hi = 0, len(sizes) - 1
        while lo < hi and best < room:
            two = sizes[lo] + sizes[hi]
            if two > most:
                hi -= 1
            else:
                if two - own > best:
                    best, step = two - own, ([] if n is None else [n], [theirs[lo][1], theirs[hi][1]])
                lo += 1
        if best == room:
            break
    return step


def pack(lengths: np.ndarray, p: PackParams) -> list[list[int]]:
    return local_search(best_fit(lengths, p.capacity), lengths, p.capacity, p.nearly, p.partners)


def _pack_group(p: PackParams):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = rows["length"].to_numpy()
        at, offset, fill = (np.zeros(rows.num_rows, np.int64) for _ in range(3))
        for b, members in enumerate(pack(lengths, p)):
            sizes = lengths[members]
            at[members], offset[members], fill[members] = b, np.cumsum(sizes) - sizes, sizes.sum()
        return rows.append_column("bin", pa.array(at)).append_column("offset", pa.array(offset)).append_column("fill", pa.array(fill))

    return run


def packed(docs: DataFrame, params: PackParams = PackParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row.

    A null text counts as empty and yields its end id alone. Rows are packed one by one, so a null or repeated
    id is no special case; equal rows may share a sequence or not. Other columns are not read. The tokenizer must
    give whole texts the ids of their words, as the public word BPE does; another one is refused.
    """
    p = params
    ship(docs.sparkSession)
    key, data = shipped_file(docs.sparkSession, p.tokenizer or tokenizer_path("word_bpe_49k.json"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = cut(rows.mapInArrow(_tokenize(p, key, data), f"{PIECE}, deal long"), "pieces")
    part = pieces.where(F.col("length") < p.capacity)
    groups = max(1, math.ceil(part.count() / p.group))
    dealt = part.select(*PIECE_COLUMNS, F.pmod("deal", F.lit(groups)).alias("pack_group"))
    kind = f"{PIECE}, pack_group long, bin long, offset long, fill long"
    first = cut(dealt.groupBy("pack_group").applyInArrow(_pack_group(p), kind), "packed")
    # what is left over: each group's underfull bins, packed again in groups as large
    loose = F.col("fill") < p.nearly * p.capacity
    again = max(1, math.ceil(first.where(loose).count() / p.group))
    second = (
        first.where(loose)
        .select(*PIECE_COLUMNS, F.pmod("pack_group", F.lit(again)).alias("pack_group"))
        .groupBy("pack_group")
        .applyInArrow(_pack_group(p), kind)
    )
    # sequence ids: whole pieces by their row's hash would collide, so each kind has its own range
    whole = pieces.where(F.col("length") == p.capacity).select(*PIECE_COLUMNS, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    number = lambda base: (F.lit(base) + F.col("pack_group") * F.lit(1 << 20) + F.col("bin")).alias("sequence_id")
    return whole.union(first.where(~loose).select(*PIECE_COLUMNS, number(-(1 << 62)), "offset")).union(second.select(*PIECE_COLUMNS, number(-(1 << 61)), "offset"))
