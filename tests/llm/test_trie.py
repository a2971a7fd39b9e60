"""The prefix trie against plain Python and SQL, over any number of parts, and the edges."""

import hashlib
import random

import pytest

from compare import oracle_rows, query_rows
from dbpulse.llm import queries, trie
from dbpulse.llm.oracles import OP11_SQL


def plain(convs):
    """The definition, from {conv_id: [(role, text), ...]}."""
    nodes = {}
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            nodes.setdefault(tuple(convs[c][:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        under = {p: m for p, m in nodes.items() if p[: len(path)] == path}
        ends = ",".join(str(c) for c in members if len(convs[c]) == len(path))
        leaves = [p for p in under if not any(len(q) == len(p) + 1 and q[:-1] == p for q in under)]
        saved = sum((len(m) - 1) * len(p[-1][1].encode()) for p, m in under.items() if p)
        out.append((
            members[0], len(path), nodes[path[:-1]][0] if path else None, len(members), sum(len(p) == len(path) + 1 for p in under),
            len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def frame(spark, convs):
    rows = [(c, i, role, text) for c, turns in convs.items() for i, (role, text) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def nodes_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("per_part", [1, 2, 7, 256])
def test_equals_plain_version(spark, monkeypatch, per_part):
    monkeypatch.setattr(trie, "PER_PART", per_part)
    rng = random.Random(5)
    convs = {}
    for c in rng.sample(range(400), 70):
        if convs and rng.random() < 0.5:  # continues, repeats or breaks off another
            other = convs[rng.choice(list(convs))]
            convs[c] = other[: rng.randint(1, len(other))] + [("u", f"t{rng.randrange(3)}é") for _ in range(rng.randint(0, 3))]
        else:
            convs[c] = [("u" if i % 2 else "a", "x" * rng.randrange(4)) for i in range(rng.randint(1, 6))]
    convs[1000] = convs[1001] = [("u", "deep")] * 40
    convs[1002] = [("u", "deep")] * 25
    assert nodes_of(trie.prefix_trie(trie.sequences(frame(spark, convs)))) == plain(convs)


def test_query_equals_oracle(spark, sf):
    assert query_rows(queries.op11_prefix_trie(spark, sf)) == oracle_rows(OP11_SQL, sf)


def test_openings_are_shared(spark):
    convs = {c: [("u", f"{c}:{i}") for i in range(n)] for c, n in ((10, 9), (11, 3), (12, 9), (13, 1), (21, 2), (7, 6), (5, 2))}
    got = {r.conv_id: len(r.turns) for r in trie.with_shared_openings(trie.sequences(frame(spark, convs))).collect()}
    from zlib import crc32

    h = {c: crc32(str(c).encode()) % 9 for c in convs}
    base = {c: len(convs.get(c - c % 5, [])) for c in convs}
    assert got == {c: min(h[c], base[c]) + max(0, len(convs[c]) - h[c]) for c in convs}


def test_shared_turns():
    rng = random.Random(1)
    for _ in range(300):
        a, b = (b"".join(bytes([rng.randrange(2)]) * trie.UNIT for _ in range(rng.randint(0, 9))) for _ in "ab")
        want = next((i for i in range(99) if a[i * trie.UNIT : (i + 1) * trie.UNIT] != b[i * trie.UNIT : (i + 1) * trie.UNIT] or len(a) <= i * trie.UNIT), 99)
        assert trie.shared_turns(a, b) == want
    key = bytes(trie.UNIT * 5000)
    assert trie.shared_turns(key, key[: trie.UNIT * 4321]) == 4321


def test_edges(spark):
    rows = [
        (1, None, "u", "first", 9), (1, 3, None, "b", 9), (1, 3, "u", None, 9), (2, None, "u", "first", None), (None, 0, "u", "lost", 1),
        (3, 0, None, None, None), (4, 0, "", "", None), (5, 1, "u", "long " * 50_000, None), (5, 1, "u", "long " * 50_000, None), (-5, 0, "u", "first", None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth long").withColumnRenamed("depth", "n_convs")
    got = nodes_of(trie.prefix_trie(trie.sequences(df)))
    convs = {1: [("u", "first"), *sorted([("", "b"), ("u", "")], key=lambda t: hashlib.sha256(f"{len(t[0])}:{t[0]}{t[1]}".encode()).hexdigest())], 2: [("u", "first")], 3: [("", "")], 4: [("", "")], 5: [("u", "long " * 50_000)] * 2, -5: [("u", "first")]}
    assert got == plain(convs)
    assert trie.prefix_trie(trie.with_shared_openings(trie.sequences(df.limit(0)))).count() == 0
    alone = trie.prefix_trie(spark.createDataFrame([(3, [])], "conv_id long, turns array<string>")).collect()
    assert [tuple(r) for r in alone] == [(3, 0, None, 1, 0, 1, 0, hashlib.sha256(b"3").hexdigest())]
