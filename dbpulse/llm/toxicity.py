"""Toxicity by nearest labelled examples.

A document is its TF-IDF vector over every word of the examples. Document
frequencies are counted over all documents; a word's weight is its inverse
document frequency times its relevance, the posterior chance that toxic and clean examples
differ in holding it, so words that only mark a language or a theme weigh little
and none is dropped. A document's score comes from the exact k nearest examples,
toxic and clean alike, by cosine. They are found in an inverted index whose posting
lists are cut into blocks of examples with the largest weight of each: the most
promising blocks are opened first, and of the others only those that can still
reach the k-th best. Votes weighted by distance are calibrated on the examples
themselves, each scored without itself and what has just its vector. In scoring every
example has its vote, so a copy of an example is judged as that was labelled. Labelled
rows that copy one another are one example, or every word of a toxic text that was
copied often would look toxic and its copies would be all the neighbours there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, ship
from .labelled import held_out, training_rows
from .textvec import Words, buffers, fold_letters, hash_spans, ragged, spans, words


OTHER = 1 - 1e-9  # a larger cosine is the document itself or its copy


@dataclass(frozen=True)
class ToxicParams:
    max_examples: int = 2048  # of each label: the labelled rows that the fit reads at most
    floor: float = 0.02  # relevance of a word that tells nothing
    copies: float = 0.8  # plain TF-IDF cosine from which examples copy one another
    neighbours: int = 15
    block: int = 64
    cutoff: float = 0.7
    bins: int = 20  # of the calibration table


class BlockMaxIndex:
    """Exact top-k by inner product over sparse vectors, with per-block maxima.

    Terms that many vectors hold are columns of a matrix; the others have posting lists. An entry is one term's
    postings within one block of vectors, with their largest weight. Products count to 12 decimal places.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int, often: float = 1 / 16):
        # neighbours in the order share their strongest term, which keeps the block maxima tight
        lead = [int(i[np.argmax(v)]) if len(i) else terms for i, v in vectors]
        self.order = np.array(sorted(range(len(vectors)), key=lambda n: (lead[n], n)), dtype=np.int64)
        self.where = np.argsort(self.order)  # place of each vector
        self.block, self.n, self.blocks = block, len(vectors), -(-max(1, len(vectors)) // block)
        idx = np.concatenate([np.zeros(0, np.int64), *(vectors[n][0] for n in self.order)]).astype(np.int64)
        weight = np.concatenate([np.zeros(0), *(vectors[n][1] for n in self.order)])
        place = np.repeat(np.arange(self.n), [len(vectors[n][0]) for n in self.order])
        common = np.flatnonzero(np.bincount(idx, minlength=terms) > often * self.n)
        self.column = np.full(terms, -1, np.int32)  # of a common term in the matrix
        self.column[common] = np.arange(len(common))
        own = self.column[idx]
        self.matrix = np.zeros((len(common), self.n))
        self.matrix[own[own >= 0], place[own >= 0]] = weight[own >= 0]
        idx, weight, place = idx[own < 0], weight[own < 0], place[own < 0]
        by_term = np.lexsort((place, idx))
        self.place, self.weight = place[by_term].astype(np.int32), weight[by_term]
        entry, begin = np.unique(idx[by_term] * self.blocks + self.place // block, return_index=True)
        self.begin = np.append(begin, len(idx))  # of each entry's postings
        self.block_of = (entry % self.blocks).astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, begin) if len(begin) else np.zeros(0)
        self.first = np.searchsorted(entry, np.arange(terms + 1) * self.blocks)  # of each term's entries

    def common_part(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """(queries, vectors): what the common terms give to each product."""
        q = np.zeros((len(queries), len(self.matrix)))
        for row, (idx, val) in zip(q, queries, strict=True):
            at = self.column[idx]
            row[at[at >= 0]] = val[at >= 0]
        return q @ self.matrix

    def products(self, idx: np.ndarray, val: np.ndarray, common: np.ndarray) -> np.ndarray:
        """The product with every vector, by number."""
        lo, hi = self.begin[self.first[idx]], self.begin[self.first[idx + 1]]
        at = ragged(lo, hi - lo)
        product = np.bincount(self.place[at], np.repeat(val, hi - lo) * self.weight[at], minlength=self.n) + common
        return np.round(product, 12)[self.where]

    def top(self, idx: np.ndarray, val: np.ndarray, k: int, without: int = -1, common: np.ndarray | None = None, most: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """The k largest positive products up to ``most`` and their vectors' numbers, but for the one left out: largest first, ties to the smaller number."""
        out = self.where[[without]] if without >= 0 else []
        common = self.common_part([(idx, val)])[0] if common is None else common
        lengths = self.first[idx + 1] - self.first[idx]
        entries, q = ragged(self.first[idx], lengths), np.repeat(val, lengths)
        owner = self.block_of[entries]
        bound = np.bincount(owner, q * self.most[entries], minlength=self.blocks)
        if self.n:
            bound = bound + np.maximum.reduceat(common, np.arange(0, self.n, self.block))
        lead = np.argsort(-bound, kind="stable")[: -(-k // self.block) + 1]
        now = np.zeros(self.blocks, bool)
        now[lead] = True
        best_n, best_s = self._open(now, entries, q, owner, common, k, out, most)
        late = ~now & (bound >= (best_s[-1] - 1e-11 if len(best_s) == k else 1e-13))
        if late.any():
            more_n, more_s = self._open(late, entries, q, owner, common, k, out, most)
            best_n, best_s = np.concatenate([best_n, more_n]), np.concatenate([best_s, more_s])
            rank = np.lexsort((best_n, -best_s))[:k]
            best_n, best_s = best_n[rank], best_s[rank]
        return best_n, best_s

    def _open(self, blocks: np.ndarray, entries: np.ndarray, q: np.ndarray, owner: np.ndarray, common: np.ndarray, k: int, out, most: float) -> tuple[np.ndarray, np.ndarray]:
        """The k best of the vectors in the blocks chosen."""
        which = blocks[owner]
        chosen = entries[which]
        lengths = self.begin[chosen + 1] - self.begin[chosen]
        at = ragged(self.begin[chosen], lengths)
        product = np.bincount(self.place[at], np.repeat(q[which], lengths) * self.weight[at], minlength=self.n)
        product = np.where(np.repeat(blocks, self.block)[: self.n], np.round(product + common, 12), 0.0)
        product[out] = 0
        hit = np.flatnonzero((product > 0) & (product <= most))
        if len(hit) > 4 * k:  # the k largest and what ties with them
            hit = hit[product[hit] >= np.partition(product[hit], len(hit) - k)[len(hit) - k]]
        numbers, product = self.order[hit], product[hit]
        rank = np.lexsort((numbers, -product))[:k]
        return numbers[rank], product[rank]


@dataclass
class ToxicModel:
    terms: list[str]
    hashes: np.ndarray  # of the terms, ascending
    weights: np.ndarray  # of the terms: inverse document frequency times relevance
    ids: np.ndarray  # of the examples
    toxic: np.ndarray  # share of toxic rows among those that an example stands for
    index: BlockMaxIndex
    prior: float  # rate of toxic rows, for documents without a known word
    params: ToxicParams
    calibration: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def vote(self, near: np.ndarray, cosine: np.ndarray) -> float:
        """Share of toxic among the nearest; a neighbour at a right angle has no vote."""
        weight = distance_weight(cosine)
        return float((weight * self.toxic[near]).sum() / weight.sum()) if len(near) else 0.0

    def calibrated(self, vote: float) -> float:
        bins = len(self.calibration)
        return float(np.interp(vote, (np.arange(bins) + 0.5) / bins, self.calibration))


def distance_weight(cosine: np.ndarray) -> np.ndarray:
    return (1.05 - np.minimum(cosine, 1.0)) ** -2.0 - 1.05**-2.0


def relevance(c1: np.ndarray, c0: np.ndarray, n1: int, n0: int, floor: float) -> np.ndarray:
    """Posterior chance that the share of texts holding a term differs by label, from ``floor`` up.

    The evidence is half the likelihood-ratio statistic G2; the prior is one relevant term among all.
    """
    if not n1 or not n0:
        return np.full(len(c1), floor)
    share = (c1 + c0) / (n1 + n0)
    part = lambda seen, expected: np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-300)), 0.0)
    half = part(c1, n1 * share) + part(c0, n0 * share) + part(n1 - c1, n1 * (1 - share)) + part(n0 - c0, n0 * (1 - share))
    return floor + (1 - floor) / (1 + np.exp(np.clip(np.log(max(1, len(c1))) - half, -50, 50)))


def copied_from(vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, p: ToxicParams) -> np.ndarray:
    """For each vector the first one that it copies: its own number, or what the first earlier one like it copies."""
    index, first = BlockMaxIndex(vectors, terms, p.block), np.arange(len(vectors))
    for at in range(0, len(vectors), 128):
        group = vectors[at : at + 128]
        for n, ((idx, val), common) in enumerate(zip(group, index.common_part(group), strict=True), at):
            if len(idx) and len(like := np.flatnonzero(index.products(idx, val, common)[:n] >= p.copies)):
                first[n] = first[like[0]]
    return first


def term_counts(w: Words, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, term numbers ascending, counts) of the documents that hold a known term."""
    if not len(hashes) or not len(w.hashes):
        return
    at = np.searchsorted(hashes, w.hashes)
    at[at == len(hashes)] = 0
    hit = np.flatnonzero(hashes[at] == w.hashes)
    if not len(hit):
        return
    doc = np.searchsorted(w.first, hit, "right") - 1
    pair, counts = np.unique(doc * len(hashes) + at[hit], return_counts=True)
    rows, cuts = np.unique(pair // len(hashes), return_index=True)
    for row, lo, hi in zip(rows.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(pair)], strict=True):
        yield row, pair[lo:hi] % len(hashes), counts[lo:hi]


def _vector(idx: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers and weights of length 1; both empty for a document without terms."""
    if not len(idx):
        return idx, np.zeros(0)
    v = (1 + np.log(counts)) * weights[idx]
    return idx, v / np.sqrt((v * v).sum())


def _example_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each example's distinct words: their hashes ascending, counts, and the words themselves between blanks."""
    fold = fold_letters()
    for batch in batches:
        for raw, offsets, at in buffers(batch.column(2)):
            starts, ends, low = spans(raw, offsets, fold) if len(raw) else (np.zeros(0, np.int64),) * 2 + (raw,)
            hashes = hash_spans(low, starts, ends) if len(raw) else np.zeros(0, np.uint64)
            first, data = np.searchsorted(starts, offsets), low.tobytes()
            out = []
            for a, b in zip(first[:-1], first[1:], strict=True):
                own, where, counts = np.unique(hashes[a:b], return_index=True, return_counts=True)
                where += a
                out.append((own.tobytes(), counts.astype(np.int32).tobytes(), b" ".join(data[i:j] for i, j in zip(starts[where].tolist(), ends[where].tolist(), strict=True))))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(out)), batch.column(1).slice(at, len(out)), *(pa.array([x[c] for x in out], pa.binary()) for c in range(3))], names=["doc_id", "grade", "hashes", "counts", "words"])


def _document_counts(hashes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows, fold = np.zeros(len(hashes) + 1, np.int64), 0, fold_letters()
        for batch in batches:
            rows += batch.num_rows
            for raw, offsets, _ in buffers(batch.column(0)):
                for _, idx, _ in term_counts(words(raw, offsets, fold), hashes):
                    total[idx] += 1
        total[-1] = rows
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["term", "n"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: Column | None = None, params: ToxicParams = ToxicParams()) -> ToxicModel:
    """Takes examples from labelled rows that aren't held out; counts their words over all documents.

    Equal texts are one row, by their smallest id and, where their labels differ, clean. Rows that copy an earlier
    one are one example with it, toxic by the share of its rows. Without examples there are no terms and every score is 0.5.
    """
    p = params
    ship(docs.sparkSession)
    label = (F.col("toxic") if label is None else label).cast("int")
    picked, total = training_rows(docs, labels, F.when(label.isNotNull(), (label > 0).cast("int")), p.max_examples, each=True)
    examples = picked.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.min("grade").alias("grade"))
    found = examples.select("doc_id", "grade", "text").mapInArrow(_example_words, "doc_id long, grade int, hashes binary, counts binary, words binary").toArrow().sort_by("doc_id")
    toxic = found["grade"].to_numpy().astype(float)
    n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
    every, counts = (np.frombuffer(b"".join(found[c].to_pylist()), t) for c, t in (("hashes", np.uint64), ("counts", np.int32)))
    sizes = np.array([len(x) // 8 for x in found["hashes"].to_pylist()], np.int64)
    hashes, where, number = np.unique(every, return_index=True, return_inverse=True)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    terms = [""] * len(hashes)
    for n in np.unique(np.searchsorted(cuts, where, "right") - 1):  # the words of one example at a time
        own, strings = np.flatnonzero((where >= cuts[n]) & (where < cuts[n + 1])), found["words"][int(n)].as_py().split(b" ")
        for t in own.tolist():
            terms[t] = strings[where[t] - cuts[n]].decode()
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_document_counts(hashes), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(len(hashes) + 1)
    seen[counted["term"].to_numpy()] = counted["n"].to_numpy()
    idf = np.log((seen[-1] + 1) / (seen[:-1] + 1)) + 1
    first = copied_from([_vector(number[a:b], counts[a:b], idf) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], len(hashes), p)

    def holders(grade: int) -> tuple[np.ndarray, int]:
        """How many examples with rows of this grade hold each term, and how many there are."""
        of_grade = np.repeat(toxic == grade, sizes)
        pairs = np.unique(number[of_grade] * max(1, len(first)) + np.repeat(first, sizes)[of_grade])
        return np.bincount(pairs // max(1, len(first)), minlength=len(hashes)).astype(float), len(np.unique(first[toxic == grade]))

    (c1, k1), (c0, k0) = holders(1), holders(0)
    weights = idf * relevance(c1, c0, k1, k0, p.floor)
    own = np.flatnonzero(first == np.arange(len(first)))
    vectors = [_vector(number[cuts[n] : cuts[n + 1]], counts[cuts[n] : cuts[n + 1]], weights) for n in own]
    share = (np.bincount(first, toxic, len(first)) / np.maximum(1, np.bincount(first, minlength=len(first))))[own]
    # how many labelled rows one of each label stands for
    rate1, rate0 = total.get(1, 0) / max(1, n1), total.get(0, 0) / max(1, n0)
    prior = (rate1 * n1 + 0.5) / (rate1 * n1 + rate0 * n0 + 1)
    model = ToxicModel(terms, hashes, weights, found["doc_id"].to_numpy()[own], share, BlockMaxIndex(vectors, len(hashes), p.block), float(prior), p)
    model.calibration = _calibrate(model, vectors, rate1, rate0, p.bins)
    return model


def _calibrate(model: ToxicModel, vectors: list[tuple[np.ndarray, np.ndarray]], rate1: float, rate0: float, bins: int) -> np.ndarray:
    """Label rate by vote, ascending; each bin starts as two examples at its middle."""
    hits, seen = (np.arange(bins) + 0.5) / bins * 2, np.full(bins, 2.0)
    for n, (idx, val) in enumerate(vectors):
        if len(idx):
            b = min(bins - 1, int(model.vote(*model.index.top(idx, val, model.params.neighbours, without=n, most=OTHER)) * bins))
            hits[b] += rate1 * model.toxic[n]
            seen[b] += rate1 * model.toxic[n] + rate0 * (1 - model.toxic[n])
    blocks: list[list[float]] = []
    for h, s in zip(hits, seen, strict=True):
        blocks.append([h, s, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] > blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.concatenate([np.full(int(k), h / s) for h, s, k in blocks])


def _scores(model: ToxicModel, raw: np.ndarray, offsets: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, dict[int, tuple]]:
    out, why = np.full(len(offsets) - 1, model.prior), {}
    rows = term_counts(words(raw, offsets, fold), model.hashes)
    while group := list(islice(rows, 128)):
        vectors = [_vector(idx, counts, model.weights) for _, idx, counts in group]
        for (row, _, _), (idx, val), common in zip(group, vectors, model.index.common_part(vectors), strict=True):
            near, cosine = model.index.top(idx, val, model.params.neighbours, common=common)
            out[row] = model.calibrated(model.vote(near, cosine))
            why[row] = (near[:3], idx[np.argsort(-val, kind="stable")[:3]])
    return out, why


def score(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence_ids, evidence_terms) of every row.

    Null and empty texts, and texts without a word of any example, get the rate of toxic rows among the labelled.
    Evidence is the three nearest examples and the three words that weigh most. Ids may be null (never held out)
    or repeat. Other columns are not read.
    """
    ship(docs.sparkSession)
    held, cutoff = docs.sparkSession.sparkContext.broadcast(model), model.params.cutoff

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = fold_letters()
        for batch in batches:
            for raw, offsets, at in buffers(batch.column(1)):
                model = held.value
                got, why = _scores(model, raw, offsets, fold)
                both = [(model.ids[why[i][0]].tolist(), [model.terms[t] for t in why[i][1]]) if i in why else ([], []) for i in range(len(got))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(got)), pa.array(got), pa.array((got >= cutoff).astype(np.int32)), pa.array([b[0] for b in both], pa.list_(pa.int64())), pa.array([b[1] for b in both], pa.list_(pa.string()))],
                    names=["doc_id", "score", "predicted", "evidence_ids", "evidence_terms"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, score double, predicted int, evidence_ids array<long>, evidence_terms array<string>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence_ids", "evidence_terms")


def keep_clean(docs: DataFrame, model: ToxicModel, text_col: str = "text") -> DataFrame:
    """The rows that score below the cutoff, with all their columns."""
    ship(docs.sparkSession)
    held, cutoff = docs.sparkSession.sparkContext.broadcast(model), model.params.cutoff
    number = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = fold_letters()
        for batch in batches:
            for raw, offsets, at in buffers(batch.column(number)):
                got, _ = _scores(held.value, raw, offsets, fold)
                yield batch.slice(at, len(got)).filter(pa.array(got < cutoff))

    return docs.mapInArrow(run, docs.schema)
