"""Whole Arrow text columns to word hashes, without a Python step per document.

A chunk of documents is one byte buffer. Words are maximal runs of bytes that
the ``fold`` table doesn't map to a separator. The hash of a word of up to eight
bytes is a bijection of its bytes; longer words are hashed by BLAKE2b. Two words with
one 64-bit hash can still be searched for, so whatever must be exact compares bytes
(``wordcache``) or numbers words by a dictionary (``word_numbers``). Buffers are
handled about ``CHUNK`` bytes at a time, a longer document by itself, so memory
follows the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_MASK = (1 << 64) - 1
_LANE = 8  # bytes that a 64-bit hash tells apart with certainty


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with full avalanche."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def seeds(n: int, start: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit words."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(start)) * np.uint64(0x9E3779B97F4A7C15))


def fold_words() -> np.ndarray:
    """A-Z to a-z; the six ASCII white-space bytes are separators (0)."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[[9, 10, 11, 12, 13, 32]] = 0
    t[0] = 255  # a NUL byte belongs to its word; UTF-8 has no byte 255
    return t


def fold_letters() -> np.ndarray:
    """As fold_words, and every ASCII byte but letters and digits separates."""
    t = fold_words()
    t[[i for i in range(128) if not chr(i).isalnum()]] = 0
    return t


class Words(NamedTuple):
    hashes: np.ndarray  # uint64, of every word in order
    first: np.ndarray  # int64, documents + 1: where each document's words begin
    starts: np.ndarray  # int64, byte position of each word
    ends: np.ndarray  # int64, byte after each word


def buffers(column: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, number of the first row) of chunks of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + chunk, "right")) - 1)
        yield raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at
        at = to


def spans(raw: np.ndarray, offsets: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end, and the folded bytes. No word crosses into the next document."""
    n = len(raw)
    low = fold[raw]
    solid = low != 0
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:n]
    close = solid
    close[:-1] &= begin[1:] | ~solid[1:]
    return np.flatnonzero(begin), np.flatnonzero(close) + 1, low


def hash_spans(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each word low[starts:ends]; words hold no zero byte."""
    sizes = ends - starts
    out = np.empty(len(starts), np.uint64)
    short = sizes <= _LANE
    place = np.arange(_LANE)
    lanes = np.concatenate([low, np.zeros(_LANE, np.uint8)])[starts[short][:, None] + place]
    lanes[place >= sizes[short][:, None]] = 0
    out[short] = mix(lanes.view("<u8").reshape(-1) + seeds(1, 0))
    if not short.all():
        data = low.tobytes()
        marks = b"".join(blake2b(data[a:b], digest_size=8).digest() for a, b in zip(starts[~short].tolist(), ends[~short].tolist(), strict=True))
        out[~short] = np.frombuffer(marks, "<u8")
    return out


def words(raw: np.ndarray, offsets: np.ndarray, fold: np.ndarray) -> Words:
    if not len(raw):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none)
    starts, ends, low = spans(raw, offsets, fold)
    return Words(hash_spans(low, starts, ends), np.searchsorted(starts, offsets), starts, ends)


def word_hash(word: str, fold: np.ndarray) -> int:
    """The hash that ``words`` gives this word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(words(raw, np.array([0, len(raw)]), fold).hashes[0])


def word_numbers(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    """Each word's number, where each text's words begin, and how many there are: equal words, and no others, have one number.

    Words are parted by ASCII white space; A-Z count as a-z.
    """
    numbers: dict[bytes, int] = {}
    found, first = [], [0]
    for text in texts:
        found += [numbers.setdefault(w, len(numbers)) for w in text.lower().split()]
        first.append(len(found))
    return np.array(found, np.int64), np.array(first), len(numbers)


def shingle_numbers(ids: np.ndarray, n_words: int, size: int) -> np.ndarray:
    """A number for each window of ``size`` words, the same for the same words only."""
    n = max(0, len(ids) - size + 1)
    out, most = ids[:n], n_words
    for i in range(1, size):
        if most * n_words >= 1 << 62:
            out = np.unique(out, return_inverse=True)[1].reshape(-1)
            most = int(out.max(initial=0)) + 1
        out = out * n_words + ids[i : i + n]
        most *= n_words
    return out


def distinct_windows(codes: np.ndarray, first: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(text, places of its distinct shingles, one place each) of the texts that have words; a text of fewer words than ``size`` has its first place."""
    for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b - a >= size:
            own = codes[a : b - size + 1]
            order = np.argsort(own)
            own = own[order]
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            yield d, order[keep] + a
        elif b > a:
            yield d, np.array([a])


def shingle_sets(w: Words, size: int, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, end to end, and their offsets; shingles are told apart by their words.

    A text of fewer words than ``size`` has its whole sequence as its one shingle; one without words has none.
    """
    h = w.hashes
    ids, first, n_words = word_numbers(texts)
    weights = seeds(size, 1000) | np.uint64(1)
    n = max(0, len(h) - size + 1)
    rolled = np.full(n, size, np.uint64)
    for i in range(size):
        rolled += h[i : i + n] * weights[i]
    rolled = mix(rolled)
    parts, counts = [], np.zeros(len(first), np.int64)
    for d, places in distinct_windows(shingle_numbers(ids, n_words, size), first, size):
        a, b = int(first[d]), int(first[d + 1])
        own = rolled[places] if b - a >= size else mix(np.array([int((h[a:b] * weights[: b - a]).sum()) + b - a & _MASK], np.uint64))
        parts.append(own)
        counts[d + 1] = len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum(counts)


def exact_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Each text's set of shingles as numbers that all these texts share."""
    ids, first, n_words = word_numbers(texts)
    out = [np.zeros(0, np.int64)] * len(texts)
    whole: dict[tuple, int] = {}  # sequences of fewer words are shingles of their own, below zero
    codes = shingle_numbers(ids, n_words, size)
    for d, places in distinct_windows(codes, first, size):
        a, b = int(first[d]), int(first[d + 1])
        out[d] = codes[places] if b - a >= size else np.array([-1 - whole.setdefault(tuple(ids[a:b].tolist()), len(whole))])
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i]+1, ... of each run, end to end."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    if not total:
        return out
    keep = lengths > 0
    s, n = starts[keep], lengths[keep]
    out[0] = s[0]
    out[np.cumsum(n)[:-1]] = s[1:] - s[:-1] - n[:-1] + 1
    return np.cumsum(out)
