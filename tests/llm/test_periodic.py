"""Periodic runs against the definition by brute force, and the edges."""

import hashlib
import random
from zlib import crc32

import numpy as np
import pytest

from dbpulse.llm import periodic, queries
from dbpulse.llm.common import table


def brute(words, least=12):
    """Every maximal stretch of each period, and of those with equal ends only the smallest period."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                length = j + q - i
                if not any(all(words[x] == words[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def row(doc_id, text):
    """The contract, word by word."""
    words = (text or "").encode().split()
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id, len(runs), *best, best[1] * 1000 // best[2] if runs else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in drop)),
    )


def test_every_period_has_a_block_that_fits():
    for n, least in ((5000, 12), (40, 12), (300, 4), (300, 2), (999, 31)):
        sizes = periodic.scales(n, least)
        assert [q for _, low, high in sizes for q in range(low, high + 1)] == list(range(1, n // 2 + 1))
        assert all(2 * b - 1 <= max(q, least - q) for b, low, high in sizes for q in range(low, high + 1))


@pytest.mark.parametrize("least", [2, 4, 12, 25])
def test_equals_brute_force(least):
    rng = random.Random(least)
    for case in range(250):
        k = rng.choice([1, 2, 3, 5, 30])
        words = [rng.randrange(k) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):  # repeats with any period, whole or broken off
            p = rng.randint(1, 20)
            base = [rng.randrange(k + 3) for _ in range(p)]
            at = rng.randint(0, len(words))
            words[at:at] = (base * 9)[: rng.randint(p, 7 * p)]
        assert periodic.runs_of(np.array(words, np.int64), least) == brute(words, least), (case, words)


def test_words_that_repeat_in_many_ways():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a  # Fibonacci words have as many runs as a word may
    for words in (b, [0] * 300, [0, 1] * 150, [0] * 100 + [1] * 100, ([0] * 7 + [1]) * 40):
        assert periodic.runs_of(np.array(words), 12) == brute(words)
    assert periodic.runs_of(np.zeros(60_000, np.int64)) == [(0, 60_000, 1)]
    runs = periodic.runs_of(np.arange(90_000) % 29_000)
    assert runs == [(0, 90_000, 29_000)]


def test_query_equals_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    got = {r.doc_id: tuple(r) for r in queries.op13_periodic_runs(spark, sf).collect()}
    short = [r for r in docs.collect() if len((r.text or "").split()) <= 900]
    assert len(got) == docs.count() and len(short) > 100
    for r in short:
        assert got[r.doc_id] == row(r.doc_id, r.text)


def test_edges(spark, docs_with_edges):
    df, _ = docs_with_edges
    got = periodic.digests(periodic.periodic_runs(df, rewrite=periodic.looped)).collect()
    plain = {r.doc_id: r.text for r in df.collect()}
    assert len(got) == df.count()
    for r in got:
        if r.doc_id != 5:
            assert tuple(r) == row(r.doc_id, plain[r.doc_id])
    text = " ".join(["x y  z"] * 5) + "\n" + "\t".join(["q"] * 12)
    one = periodic.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(x) for x in one.runs] == [(0, 15, 3), (15, 12, 1)] and one.collapsed == "x y z q" and one.n_words == 27
    assert periodic.periodic_runs(df.limit(0)).count() == 0
