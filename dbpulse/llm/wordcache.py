"""Token ids of whole texts from per-word ids, each distinct word encoded once per worker.

Right for tokenizers whose pre-tokenizer never joins characters across the
cuts; ``packing`` and ``pieces`` say why theirs qualifies. Words are looked up by
their 64-bit hashes in sorted arrays and compared by their bytes, so that a word with
another's hash is encoded by itself. A million words take some 50 MB, and a worker
keeps them from task to task. The tokenizers library gets two threads in
each worker, unless RAYON_NUM_THREADS says otherwise: tasks fill the cores already.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

import numpy as np

from .textvec import ragged

os.environ.setdefault("RAYON_NUM_THREADS", "2")
_workers: dict[tuple, object] = {}


def of_worker(key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once per Python worker."""
    if key not in _workers:
        _workers[key] = make()
    return _workers[key]


class _Sorted:
    """Sorted hashes with the number of each."""

    def __init__(self):
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The number of each, -1 where there is none."""
        if not len(self.hashes):
            return np.full(len(wanted), -1)
        at = np.searchsorted(self.hashes, wanted)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == wanted, self.numbers[at], -1)

    def add(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        hashes, numbers = np.concatenate([self.hashes, hashes]), np.concatenate([self.numbers, numbers])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.numbers = hashes[order], numbers[order]


def _equal(a: np.ndarray, a_at: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Which pairs of stretches of two byte buffers hold the same bytes."""
    same = a_size == b_size
    size = np.where(same, a_size, 0)
    other = np.flatnonzero(a[ragged(a_at, size)] != b[ragged(b_at, size)])
    if len(other):
        same[np.searchsorted(np.cumsum(size), other, "right")] = False
    return same


class WordCache:
    """Ids by word. Beyond ``most`` words the half that was used least goes, and the uses of the others count half."""

    def __init__(self, encode_many: Callable[[list[str]], Sequence[Sequence[int]]], most: int = 1_000_000, recent: int = 65_536):
        self._encode_many, self._most, self._recent_most = encode_many, most, recent
        self._old, self._recent = _Sorted(), _Sorted()
        self._start, self._length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._hash, self._uses = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self._ids = np.zeros(0, np.uint32)
        self._bytes, self._at, self._size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _shrink(self) -> None:
        order = np.lexsort((-np.arange(len(self._uses)), -self._uses))  # the most used, then the latest
        keep = np.sort(order[: self._most // 2])
        self._ids = self._ids[ragged(self._start[keep], self._length[keep])]
        self._bytes = self._bytes[ragged(self._at[keep], self._size[keep])]
        self._size = self._size[keep]
        self._at = np.cumsum(self._size) - self._size
        self._length, self._hash, self._uses = self._length[keep], self._hash[keep], self._uses[keep] // 2
        self._start = np.cumsum(self._length) - self._length
        self._old, self._recent = _Sorted(), _Sorted()
        self._old.add(self._hash, np.arange(len(keep)))

    def encode(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, low: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words raw[starts:ends] in order, and the number of ids of each word.

        ``low`` are the bytes that tell words apart and that ``hashes`` are of, where these aren't the raw ones.
        """
        if len(self._start) > self._most:
            self._shrink()
        low, sizes = raw if low is None else low, ends - starts
        unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        number = self._old.find(unique)
        new = np.flatnonzero(number < 0)
        number[new] = self._recent.find(unique[new])
        met = np.flatnonzero(number >= 0)
        forged = np.zeros(len(unique), bool)  # has the hash of another word that is kept
        forged[met] = ~_equal(low, starts[first[met]], sizes[first[met]], self._bytes, self._at[number[met]], self._size[number[met]])
        new = new[number[new] < 0]
        if len(new):
            number[new] = self._learn(raw, low, starts[first[new]], ends[first[new]], unique[new])
        self._uses[number] += 1
        number = number[back]
        lengths = self._length[number]
        alone = np.flatnonzero(forged[back] | ~_equal(low, starts, sizes, low, starts[first[back]], sizes[first[back]]))
        if not len(alone):
            return self._ids[ragged(self._start[number], lengths)], lengths
        data = raw.tobytes()
        own = dict(zip(alone.tolist(), self._encode_many([data[starts[i] : ends[i]].decode() for i in alone]), strict=True))
        ids = [np.array(own[i], np.uint32) if i in own else self._ids[self._start[k] : self._start[k] + self._length[k]] for i, k in enumerate(number.tolist())]
        return np.concatenate(ids), np.array([len(x) for x in ids], np.int64)

    def _learn(self, raw: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        data = raw.tobytes()
        words = [data[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        found = [ids for at in range(0, len(words), 4_000) for ids in self._encode_many(words[at : at + 4_000])]
        lengths = np.array([len(ids) for ids in found], np.int64)
        numbers = len(self._start) + np.arange(len(words))
        self._start = np.concatenate([self._start, len(self._ids) + np.cumsum(lengths) - lengths])
        self._length = np.concatenate([self._length, lengths])
        self._at = np.concatenate([self._at, len(self._bytes) + np.cumsum(ends - starts) - (ends - starts)])
        self._size = np.concatenate([self._size, ends - starts])
        self._bytes = np.concatenate([self._bytes, low[ragged(starts, ends - starts)]])
        self._hash, self._uses = np.concatenate([self._hash, hashes]), np.concatenate([self._uses, np.zeros(len(words), np.int32)])
        self._ids = np.concatenate([self._ids, np.fromiter((i for ids in found for i in ids), np.uint32, int(lengths.sum()))])
        self._recent.add(hashes, numbers)
        if len(self._recent.hashes) > self._recent_most:
            self._old.add(self._recent.hashes, self._recent.numbers)
            self._recent = _Sorted()
        return numbers
