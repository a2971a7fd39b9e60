"""Runs of words that repeat with a period, found by aligned blocks.

A run is a stretch of words whose smallest period is q, at least ``least`` words and
two periods long, that no neighbouring word extends. A stretch of a run as long as
the run less q holds equal words q further on. So for every q there is a power
of two B for which an aligned block of B words lies in that stretch: the largest
with 2B - 1 <= max(q, least - q). The aligned blocks of each B are the keys of an
Aho-Corasick automaton over word numbers, which is searched across the document.
An occurrence at a distance that B is answerable for seeds an exact extension to both
sides. Words are numbered by a dictionary of the document, so nothing rests on hashes.

Only blocks and stretches whose every pair of words recurs near enough are built and
searched: others have no such occurrence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .textvec import buffers

Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def scales(n: int, least: int) -> list[tuple[int, int, int]]:
    """(block, smallest distance, largest distance): which block size finds which periods of a text of n words."""
    out: list[tuple[int, int, int]] = []
    q, most = 1, n // 2
    while q <= most:
        block = 1 << ((max(q, least - q) + 1) // 2).bit_length() - 1
        # the block stays the same while the longer of both sides of the maximum stays in its octave
        end = least - (2 * block - 1) if q < least - q else 4 * block - 2
        end = min(most, max(q, end))
        out.append((block, q, end))
        q = end + 1
    return out


def _gaps(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far on, and how far back, the same code stands next; very far where it doesn't."""
    order = np.argsort(codes, kind="stable")
    after, before = np.full(len(codes), 1 << 60), np.full(len(codes), 1 << 60)
    same = codes[order[1:]] == codes[order[:-1]]
    gap = (order[1:] - order[:-1])[same]
    after[order[:-1][same]], before[order[1:][same]] = gap, gap
    return after, before


def _seeds(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, distance, block) of aligned blocks that stand again at a distance that their size is answerable for."""
    n, found = len(ids), []
    one, two = _gaps(ids), _gaps(ids[:-1] * (ids.max() + 1) + ids[1:])
    for block, low, high in scales(n, least):
        width = max(1, block - 1)  # codes in a block
        after, before = two if block > 1 else one
        far = np.concatenate([[0], np.cumsum(after > high)])
        places = np.arange(0, n - block + 1, block)
        places = places[far[places + width] == far[places]]
        if not len(places):
            continue
        keys: dict[tuple, int] = {}
        number = np.full(n // block + 1, -1)
        number[places // block] = [keys.setdefault(tuple(ids[j : j + block].tolist()), len(keys)) for j in places]
        search = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for key, k in keys.items():
            search.add_word(key, k)
        search.make_automaton()
        near = np.concatenate([[False], before <= high, [False]])
        begin, end = np.flatnonzero(near[1:] & ~near[:-1]), np.flatnonzero(near[:-1] & ~near[1:])
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            if b - a < width:
                continue
            hits = list(search.iter(tuple(ids[a : b + block - width].tolist())))
            if not hits:
                continue
            last, key = np.array(hits).T
            at = last + (a - block + 1)
            for back in range((high - low) // block + 2):
                place = ((at - low) // block - back) * block
                fits = (place >= 0) & (at - place >= low) & (at - place <= high)
                fits[fits] = number[place[fits] // block] == key[fits]
                found.append((place[fits], (at - place)[fits], np.full(int(fits.sum()), block)))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    place, distance, block = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((place, distance))
    return place[order], distance[order], block[order]


def _extend(ids: np.ndarray, place: int, q: int, block: int) -> tuple[int, int]:
    """The longest stretch around a seed in which every word equals the one q further on: its start, and the end of the run."""
    begin, end, step = place, place + block, 64
    while end + q < len(ids):
        m = min(step, len(ids) - q - end)
        other = np.flatnonzero(ids[end : end + m] != ids[end + q : end + q + m])
        if len(other):
            end += int(other[0])
            break
        end, step = end + m, 2 * step
    step = 64
    while begin:
        m = min(step, begin)
        other = np.flatnonzero(ids[begin - m : begin] != ids[begin - m + q : begin + q])
        if len(other):
            begin += int(other[-1]) + 1 - m
            break
        begin, step = begin - m, 2 * step
    return begin, end + q


def runs_of(ids: np.ndarray, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period.

    Seeds are extended by ascending distance. One that lies, with its other end, within a stretch known to have
    a period that divides its distance tells nothing new: the whole stretch around it has that smaller period.
    """
    if len(ids) < max(2, least):
        return []
    place, distance, block = _seeds(ids, least)
    out = []
    while len(place):
        q = int(distance[0])
        begin, end = _extend(ids, int(place[0]), q, int(block[0]))
        if end - begin >= max(least, 2 * q):
            out.append((begin, end - begin, q))
            known = distance % q == 0
        else:
            known = distance == q
        known &= (place >= begin) & (place + distance + block <= end)
        place, distance, block = place[~known], distance[~known], block[~known]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges)[:n] == 0


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of all documents, by the checksum of the id, end in a loop over a stretch of them."""
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def periodic_runs(docs: DataFrame, least: int = 12, rewrite: Rewrite | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: its runs by start and period, and its text without their repeats.

    Words are parted by ASCII white space, and one blank joins those kept. ``rewrite`` is a function of id and words
    applied first. Null, empty and blank texts have no word, no run and an empty collapsed text. Ids may be null or
    repeat; each row is for itself, so nothing is shuffled. Other columns are not read.
    """
    if least < 2:
        raise ValueError("a run has two words at least")
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for raw, offsets, at in buffers(batch.column(1)):
                data, own = raw.tobytes(), batch.column(0).slice(at, len(offsets) - 1)
                counts, runs, texts = [], [], []
                for doc_id, a, b in zip(own.to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    words = data[a:b].split()
                    if rewrite is not None:
                        words = rewrite(doc_id, words)
                    numbers: dict[bytes, int] = {}
                    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
                    of_doc = runs_of(ids, least) if len(numbers) < len(words) else []
                    if of_doc:
                        words = [w for w, stays in zip(words, collapsed(len(words), of_doc).tolist(), strict=True) if stays]
                    counts.append(len(ids))
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in of_doc])
                    texts.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([own, pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """Per row of ``periodic_runs`` the number of its runs, the longest of them, and digests of all and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = found.withColumn("longest", longest)
    length, period = F.col("longest.length"), -F.col("longest.period")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(length * 1000 / period).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
