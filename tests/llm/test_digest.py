"""Fingerprints against plain Python, with colliding digests and the edges."""

import hashlib
import unicodedata

import pytest

from dbpulse.llm import digest, queries
from dbpulse.llm.common import table


def form(text):
    low = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return " ".join(low.split())


def expected(rows):
    """By id: characters, digest of the edited text, likenesses, and the group; from rows by ascending id."""
    out, groups = {}, {}
    for i, t in rows:
        groups.setdefault(form(t), i)
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), float(form(t) == form(edited)), float(form(t) == form(after)), groups[form(t)])
    return out


def test_query_equals_plain_version(spark, sf):
    rows = sorted((r.doc_id, r.text) for r in table(spark, sf, "documents").collect())
    got = queries.op12_fingerprints(spark, sf).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next, r.group_id) for r in got} == expected(rows)
    marks, texts = {r.doc_id: r.fingerprint for r in got}, dict(rows)
    assert len(got) == len(rows) and len(set(marks.values())) == len({form(t) for t in texts.values()})
    assert len({(marks[i], form(t)) for i, t in rows}) == len(set(marks.values()))


@pytest.mark.parametrize("per_part", [1, 3, 4096])
def test_parts_join_up(spark, monkeypatch, per_part):
    monkeypatch.setattr(digest, "PER_PART", per_part)
    rows = [(i * 7 - 20, "Ab  cd ef" * (i % 4) + "ß" * (i % 3)) for i in range(40)] + [(900, None), (901, ""), (902, "x"), (903, "X")]
    df = spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(5)
    got = digest.with_edits(df).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next, r.group_id) for r in got} == expected(rows)


@pytest.mark.parametrize("bits", [4, 8, 128])
def test_colliding_digests_are_told_apart(spark, bits):
    rows = [(i, f"Text number {i % 60}" if i % 3 else f"  tExt number\t{i % 60} ") for i in range(200)]
    got = digest.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), bits=bits).collect()
    assert len({r.fingerprint for r in got}) == 60
    assert all(r.group_id == r.doc_id % 60 for r in got)
    assert len({(r.fingerprint, r.group_id) for r in got}) == 60


def test_canonical_forms():
    same = ["Straße  ﬁx", "STRASSE fix", " strasse \nFIX ", "ſtraße fix"]
    assert len({digest.canonical(t) for t in same}) == 1
    assert digest.canonical("é") == digest.canonical("É") and digest.canonical(" \t") == b""
    assert digest.canonical("a b") != digest.canonical("ab")


def test_edges(spark, docs_with_edges):
    df, _ = docs_with_edges
    got = sorted(digest.with_edits(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [r.doc_id for r in got] == [0, 1, 2, 3, 4, 5, 5, 7, None]
    assert got[0].near_next == 1 and got[0].fingerprint == got[1].fingerprint and got[1].group_id == 0
    assert got[2].fingerprint == got[3].fingerprint == got[4].fingerprint and got[4].n_chars == 4
    assert got[5].near_next + got[6].near_next == 1  # the first of two equal rows is followed by its copy
    assert got[8].n_chars == 5 and got[8].edited_sha256 is None and got[8].group_id is None and got[8].fingerprint
    one = digest.with_edits(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1 and one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert digest.with_edits(df.limit(0)).count() == 0 and digest.fingerprints(df.limit(0)).count() == 0
