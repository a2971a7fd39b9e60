"""The whole quality query against a plain version: words, shapes and repetition by string functions, the fit row by row."""

import re
import zlib

import numpy as np

from dbpulse.llm import quality, queries, textvec
from dbpulse.llm.common import table

SF = "/root/testdata/sf0.001"
SPACES = " \t\n\v\f\r"


def words(text):
    return [w for w in re.split(f"[{SPACES}]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]


def shape(text):
    """Capitals, letters and digits by class, anything beyond ASCII a letter, runs of a class once."""
    kinds = ["A" if "A" <= c <= "Z" else "9" if "0" <= c <= "9" else "a" if "a" <= c <= "z" or ord(c) > 127 else " " if c in SPACES else c for c in text]
    return [w for w in "".join(k for i, k in enumerate(kinds) if i == 0 or k != kinds[i - 1]).split(" ") if w]


def features(text):
    """{feature number: value}; hashes are those of the operator, one word at a time."""
    out = {}

    def add(items, dims, start, scale, fold):
        for w in items:
            k = start + textvec.word_hash(w, fold) % dims
            out[k] = out.get(k, 0.0) + scale / len(items)

    plain, shapes = words(text), shape(text)
    identity = np.arange(256, dtype=np.uint8)
    add(plain, quality.WORD_DIMS, 0, quality.WORD_SCALE, textvec.fold_words())
    add(shapes, quality.SHAPE_DIMS, quality.WORD_DIMS, quality.SHAPE_SCALE, identity)
    again = sum(a == b for a, b in zip(plain, plain[1:], strict=False))
    if again:
        out[quality.DIMS - 1] = again * quality.SHAPE_SCALE / len(plain)
    return out


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    rows = []
    for r in table(spark, SF, "labels").collect():
        if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            found = features(docs[r.doc_id])
            idx = np.array(sorted(found), np.int32)
            rows.append((0 if r.quality <= 0 else 1 if (r.toxic or 0) > 0 else 2, idx, np.array([found[i] for i in idx.tolist()], np.float32)))
    rows.sort(key=lambda x: (x[0], x[1].tobytes(), x[2].tobytes()))
    model = quality.fit_ordinal(rows, quality.DIMS)
    got = {r.doc_id: r for r in queries.op1_quality(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        latent = sum(model.weights[k] * v for k, v in features(text).items())
        above = [1 / (1 + np.exp(t - latent)) for t in model.thresholds]
        assert abs(got[i].expected_grade - sum(above)) < 1e-4 and abs(got[i].tail_probability - above[0]) < 1e-4
        assert got[i].keep == (got[i].tail_probability >= 0.5)


def test_a_score_does_not_depend_on_its_neighbours():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["a", "Bc", "d1", "é", "x-y"], rng.integers(0, 40))) for _ in range(50)]
    weights = rng.normal(size=quality.DIMS)

    def latent(some):
        raw = [t.encode() for t in some]
        return quality.latent(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), weights)

    assert latent(texts).tolist() == [latent([t])[0] for t in texts]
