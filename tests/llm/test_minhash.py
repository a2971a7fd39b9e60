"""Near-duplicates against all pairs by brute force, and the edges."""

import random

import numpy as np
import pytest

from compare import oracle_rows, query_rows
from dbpulse.llm import minhash, queries, textvec
from dbpulse.llm.oracles import OP2_SQL


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows}
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                label[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(400)]
    rows, texts = [], []
    for _ in range(60):
        texts.append([rng.choice(vocab) for _ in range(rng.randint(1, 120))])
    base = [rng.choice(vocab) for _ in range(150)]
    for _ in range(90):  # a large group whose members are often just below or above the similarity
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(len(copy))] = rng.choice(vocab)
        texts.append(copy)
    texts += texts[:20] + [[], ["a"], ["a"], ["a", "b"], ["A", "B"]]
    for i, t in enumerate(texts):
        rows.append((i * 3 + 1, " ".join(t)))
    return rows


@pytest.mark.parametrize(("size", "percent", "block"), [(3, 85, 512), (3, 85, 16), (5, 80, 512)])
def test_equals_brute_force(spark, size, percent, block):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(df, minhash.MinMaxParams(shingle=size, percent=percent, block=block)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, size, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_query_equals_oracle(spark, sf):
    assert query_rows(queries.op2_minhash(spark, sf)) == oracle_rows(OP2_SQL, sf)


def test_edges(spark, docs_with_edges):
    df, _ = docs_with_edges
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, queries.OP2).collect())
    assert [g[0] for g in got] == [0, 1, 2, 3, 4, 5, 5, 7]
    assert got[0] == (0, 8, 0, True) and got[1] == (1, 8, 0, False)
    assert got[2:5] == [(2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 1 << 62, (2, 3000)).astype(np.uint64)
    both = np.concatenate([a[:2000], b[:500]])
    sets = np.concatenate([np.sort(a), np.sort(both)])
    sig = minhash.signatures(sets, np.array([0, 3000, 5500]), 400)
    want = 2000 / 3500
    assert abs((sig[:, 0] == sig[:, 1]).mean() - want) < 0.06


def test_words_are_ascii_white_space_runs():
    text = "A b c\x0bd\x1ce  É"
    raw = np.frombuffer(text.encode(), np.uint8)
    w = textvec.words(raw, np.array([0, len(raw)]), textvec.fold_words())
    assert [raw[a:b].tobytes() for a, b in zip(w.starts, w.ends)] == text.encode().split()
    assert w.hashes[0] == textvec.word_hash("a", textvec.fold_words())


@pytest.mark.parametrize(("leaders", "percent"), [(1, 80), (3, 85), (16, 90)])
def test_large_groups_lose_no_link(spark, leaders, percent):
    """Copies of two texts that share a passage, and a chain from one to the other: groups far beyond a block."""
    rng = random.Random(leaders)
    vocab = [f"v{i}" for i in range(3000)]
    one, two = ([rng.choice(vocab) for _ in range(120)] for _ in range(2))
    texts = []
    for base in (one, two):
        for _ in range(70):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(copy)
    texts += [one[:k] + two[k:] for k in range(0, 121, 2)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(df, minhash.MinMaxParams(shingle=3, percent=percent, block=16, leaders=leaders)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 3, percent)


def test_bands_follow_the_similarity():
    assert queries.OP2.bands == 24 and minhash.MinMaxParams().bands == 38 and minhash.MinMaxParams(percent=100).bands == 1
    for p in (queries.OP2, minhash.MinMaxParams()):
        assert (1 - (p.percent / 100) ** (2 * p.perms_per_band)) ** p.bands <= p.miss


def test_components_with_hubs_equal_brute_force(spark):
    from dbpulse.llm import components

    rng = random.Random(4)
    pairs = [(500, i) for i in range(100, 160)] + [(i, i + 7) for i in range(1000, 1200, 3)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(100, 1000), (7, 7), (None, 3)]
    label = {}

    def find(i):
        while label.setdefault(i, i) != i:
            i = label[i]
        return i

    for a, b in pairs:
        if a is not None and a != b:
            p, q = sorted((find(a), find(b)))
            label[q] = p
    got = components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {i: find(i) for i in label} and len(got) == len(label)


def morse(n):
    """The Thue-Morse word of 2**n letters and its complement: any polynomial modulo a power of two gives both one hash from some n on."""
    bits = "".join(str(i.bit_count() % 2) for i in range(1 << n))
    return bits.translate({48: "a", 49: "b"}), bits.translate({48: "b", 49: "a"})


@pytest.mark.parametrize("letters", [10, 12])
def test_words_made_to_collide_are_told_apart(spark, letters):
    a, b = morse(letters)
    rows = [(1, f"one {a} two"), (2, f"one {b} two"), (3, a), (4, b), (5, f"ONE {a} two")]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), queries.OP2).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    raw = np.frombuffer(f"{a} {b}".encode(), np.uint8)
    hashes = textvec.words(raw, np.array([0, len(raw)]), textvec.fold_words()).hashes
    assert hashes[0] != hashes[1]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 9])
def test_sets_hold_words_whatever_their_hashes(size, monkeypatch):
    """With one hash for all words, shingles are still told apart by their words."""
    rng = random.Random(size)
    texts = [" ".join(rng.choice(["a", "b", "A", "cc", "ddd é"]) for _ in range(rng.randint(0, 30))) for _ in range(80)]
    raw = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    w = textvec.words(np.frombuffer(raw, np.uint8), offsets, textvec.fold_words())
    want = [shingles(t, size) for t in texts]
    for hashes in (w.hashes, np.zeros_like(w.hashes)):
        _, cuts = textvec.shingle_sets(w._replace(hashes=hashes), size, [t.encode() for t in texts])
        assert np.diff(cuts).tolist() == [len(s) for s in want]
    sets = [set(s.tolist()) for s in textvec.exact_sets([t.encode() for t in texts], size)]
    for x, p in zip(sets, want, strict=True):
        for y, q in zip(sets, want, strict=True):
            assert len(x & y) == len(p & q)
    monkeypatch.setattr(textvec, "word_numbers", lambda t, f=textvec.word_numbers: (*f(t)[:2], 1 << 40))  # too many words for one number
    sets = [set(s.tolist()) for s in textvec.exact_sets([t.encode() for t in texts], size)]
    assert [len(s) for s in sets] == [len(s) for s in want]
