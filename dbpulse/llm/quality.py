"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector for all grades and
ordered thresholds. x holds shares of hashed words, of hashed word shapes (runs
of letters, capitals and digits folded, punctuation kept) and of words that
repeat the one before. The weights are fitted on a bounded sample of labelled
rows; scoring reads every text once, whole, and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship
from .labelled import training_rows
from .textvec import Words, buffers, fold_words, words

WORD_DIMS, SHAPE_DIMS = 1 << 13, 1 << 12
DIMS = WORD_DIMS + SHAPE_DIMS + 1  # the last: share of words equal to the one before
WORD_SCALE, SHAPE_SCALE = 2.0, 8.0


@dataclass(frozen=True)
class QualityParams:
    max_rows: int = 6000  # labelled rows that the fit reads at most
    rounds: int = 250
    l2: float = 2e-4
    tail_grade: int = 1  # selection asks for this grade or a higher one
    keep_at: float = 0.5


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than the grades

    def above(self, latent: np.ndarray) -> np.ndarray:
        """(rows, grades - 1): P(grade > k) for each threshold k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - latent[:, None], -500, 500)))


def rating() -> Column:
    """The three grades that the label columns give: 0 unusable, 1 usable but toxic, 2 good. Null without a quality label."""
    return F.when(F.col("quality") <= 0, 0).when((F.col("quality") > 0) & (F.coalesce(F.col("toxic"), F.lit(0)) > 0), 1).when(F.col("quality") > 0, 2)


def _shape_fold() -> np.ndarray:
    t = fold_words()
    t[65:91] = 65
    t[97:123] = 97
    t[48:58] = 57
    t[128:] = 97
    return t


def _features(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """For each block: feature numbers in order, where each document's begin, its number of words, and the scale."""
    plain = words(raw, offsets, fold_words())
    kind = _shape_fold()[raw]
    keep = np.ones(len(raw), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[offsets[:-1][offsets[:-1] < len(raw)]] = True
    at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    identity = np.arange(256, dtype=np.uint8)
    shapes = words(kind[keep], at[offsets], identity)
    again = np.zeros(len(plain.hashes), bool)
    again[1:] = plain.hashes[1:] == plain.hashes[:-1]
    again[plain.first[:-1][plain.first[:-1] < len(again)]] = False
    where = np.zeros(len(again) + 1, np.int64)
    np.cumsum(again, out=where[1:])
    counts = np.diff(plain.first)

    def block(w: Words, dims: int, start: int) -> np.ndarray:
        return (w.hashes & np.uint64(dims - 1)).astype(np.int64) + start

    return [
        (block(plain, WORD_DIMS, 0), plain.first, counts, WORD_SCALE),
        (block(shapes, SHAPE_DIMS, WORD_DIMS), shapes.first, np.diff(shapes.first), SHAPE_SCALE),
        (np.full(int(where[-1]), DIMS - 1, np.int64), where[plain.first], counts, SHAPE_SCALE),
    ]


def latent(raw: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """w.x of each document of a chunk; 0 for one without words."""
    out = np.zeros(len(offsets) - 1)
    for numbers, first, counts, scale in _features(raw, offsets):
        some = np.flatnonzero(first[1:] > first[:-1])
        if len(some):  # each document's own sum, so that its last bits don't depend on its neighbours
            out[some] += scale * np.add.reduceat(weights[numbers], first[:-1][some]) / np.maximum(counts[some], 1)
    return out


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grades = batch.column(0)
        for raw, offsets, at in buffers(batch.column(1)):
            blocks = _features(raw, offsets)
            idx, val = [], []
            for d in range(len(offsets) - 1):
                parts = [(*np.unique(n[f[d] : f[d + 1]], return_counts=True), s / max(1, c[d])) for n, f, c, s in blocks]
                idx.append(np.concatenate([p[0] for p in parts]).astype(np.int32).tobytes())
                val.append(np.concatenate([p[1] * p[2] for p in parts]).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([grades.slice(at, len(idx)), pa.array(idx, pa.binary()), pa.array(val, pa.binary())], names=["grade", "idx", "val"])


def fit(docs: DataFrame, labels: DataFrame, grade: Column | None = None, params: QualityParams = QualityParams()) -> OrdinalModel:
    """Fits weights and thresholds on labelled rows that are not held out.

    Without labelled rows the weights are 0 and the thresholds evenly spread, and every tail probability is at least one half.
    """
    ship(docs.sparkSession)
    rows, _ = training_rows(docs, labels, rating() if grade is None else grade, params.max_rows)
    found = rows.select("grade", "text").mapInArrow(_sparse, "grade int, idx binary, val binary").collect()
    found.sort(key=lambda r: (r.grade, r.idx, r.val))  # the order of arrival must not show in the weights
    return fit_ordinal([(r.grade, np.frombuffer(r.idx, np.int32), np.frombuffer(r.val, np.float32)) for r in found], DIMS, params)


def fit_ordinal(rows: list[tuple[int, np.ndarray, np.ndarray]], dims: int, params: QualityParams = QualityParams()) -> OrdinalModel:
    """Gradient descent with adaptive moments on the cumulative-link likelihood; rows are (grade, feature numbers, values)."""
    levels = max([2, *(g + 1 for g, _, _ in rows)])
    if not rows:
        return OrdinalModel(np.zeros(dims), np.arange(levels - 1) - float(levels - 2))
    y = np.array([g for g, _, _ in rows])
    sizes = np.array([len(i) for _, i, _ in rows])
    idx = np.concatenate([i for _, i, _ in rows])
    val = np.concatenate([v for _, _, v in rows]).astype(float)
    row = np.repeat(np.arange(len(rows)), sizes)
    share = np.cumsum(np.bincount(y, minlength=levels) + 1.0)[:-1] / (len(y) + levels)
    start = np.log(share / (1 - share))
    # thresholds: the first, then the logarithms of the gaps, so that they stay in order
    p = np.concatenate([np.zeros(dims), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, params.rounds + 1):
        w, cuts = p[:dims], _cuts(p[dims:])
        s = np.bincount(row, w[idx] * val, minlength=len(y))
        edges = np.concatenate([[-40.0], cuts, [40.0]])
        hi, lo = _sigmoid(edges[y + 1] - s), _sigmoid(edges[y] - s)
        like = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = hi * (1 - hi) / like, lo * (1 - lo) / like
        d_s = (d_hi - d_lo) / len(y)
        g_w = np.bincount(idx, val * d_s[row], minlength=dims) + params.l2 * w / 10
        g_cut = np.zeros(levels + 1)
        np.add.at(g_cut, y + 1, -d_hi / len(y))
        np.add.at(g_cut, y, d_lo / len(y))
        g_cut = g_cut[1:-1]
        tail = np.cumsum(g_cut[::-1])[::-1]
        g = np.concatenate([g_w, tail[:1], tail[1:] * np.exp(p[dims + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return OrdinalModel(p[:dims], _cuts(p[dims:]))


def _cuts(p: np.ndarray) -> np.ndarray:
    return np.concatenate([p[:1], p[0] + np.cumsum(np.exp(np.clip(p[1:], -20, 20)))])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def score(docs: DataFrame, model: OrdinalModel, params: QualityParams = QualityParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_grade, tail_probability, keep) of every row.

    A null or empty text has no features and gets what the thresholds alone say. Ids may be null or repeat;
    rows are scored one by one. Other columns are not read.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, offsets, at in buffers(batch.column(1)):
                above = held.value.above(latent(raw, offsets, held.value.weights))
                tail = above[:, params.tail_grade - 1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(tail)), pa.array(above.sum(axis=1)), pa.array(tail), pa.array(tail >= params.keep_at)],
                    names=["doc_id", "expected_grade", "tail_probability", "keep"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, keep boolean")


def keep_good(docs: DataFrame, model: OrdinalModel, params: QualityParams = QualityParams(), text_col: str = "text") -> DataFrame:
    """The rows whose tail probability reaches ``keep_at``, with all their columns."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    number = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, offsets, at in buffers(batch.column(number)):
                tail = held.value.above(latent(raw, offsets, held.value.weights))[:, params.tail_grade - 1]
                yield batch.slice(at, len(tail)).filter(pa.array(tail >= params.keep_at))

    return docs.mapInArrow(run, docs.schema)
