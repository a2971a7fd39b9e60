"""Packing, SentencePiece, WARC and sharding: round trips and brute force."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import oracle_rows, query_rows
from dbpulse.llm import packing, pieces, queries, sharding, warc
from dbpulse.llm.common import table, tokenizer_path
from dbpulse.llm.oracles import OP6_SQL


def check_packed(rows, texts, capacity=4096):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = []
    for doc, text in texts:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(doc, k, a, len(ids[a : a + capacity]), zlib.crc32(ids[a : a + capacity].tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
    none_last = lambda r: (r[0] is None, *[x or 0 for x in r])
    assert sorted((tuple(r)[:5] for r in rows), key=none_last) == sorted(want, key=none_last)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r.length for r in rows) // capacity)


def test_packing_of_the_query(spark, sf):
    docs = table(spark, sf, "documents")
    used, least = check_packed(queries.op9_packing(spark, sf).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert used <= least + 1


def test_packing_edges(spark, docs_with_edges):
    df, _ = docs_with_edges
    rows = packing.packed(df).collect()
    check_packed(rows, [(r.doc_id, r.text) for r in df.collect()])
    assert packing.packed(df.limit(0)).count() == 0


@pytest.mark.parametrize("word", ["don't.", "x<|endoftext|>y", "...", "a.", "é.", "1,", "Á.", "İ,", "a\x00b", "a\x01b", "'s.", " x "])
def test_words_are_encoded_like_texts(word):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    t, e = Tokenizer.from_file(path), packing.TextEncoder(path)
    text = f"{word} start {word}\n {word}"
    raw = np.frombuffer(text.encode(), np.uint8)
    [ids] = e.encode(raw, np.array([0, len(raw)]))
    assert ids.tolist() == t.encode(text, add_special_tokens=False).ids


def test_local_search_empties_bins():
    # best fit leaves three bins here; exchanges find two
    lengths = np.array([6, 5, 5, 4])
    p = packing.PackParams(capacity=10)
    bins = [[0], [1], [2, 3]]
    out = packing.local_search(bins, lengths, 10, 1.0)
    assert len(out) == 2 and sorted(n for b in out for n in b) == [0, 1, 2, 3]
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 4096, 400)
    start = [[i] for i in range(400)]
    fill = lambda bs: sum(int(sizes[b].sum()) ** 2 for b in bs)
    done = packing.local_search([list(b) for b in start], sizes, 4096, 0.98)
    assert fill(done) > fill(start) and len(done) < 400 and max(int(sizes[b].sum()) for b in done) <= 4096
    assert sorted(n for b in packing.pack(sizes, packing.PackParams()) for n in b) == list(range(400)) and p.capacity == 10


def test_pieces_equal_the_original_library(spark, sf):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    original = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [r.text for r in table(spark, sf, "documents").collect()]
    backend = pieces.Backend(path)
    backend.verify(path)
    for text, ids in zip(texts, backend.encode(texts)):
        assert ids.tolist() == original.encode(text) and backend.decode(ids) == text
        assert backend.tokenizer.encode(backend.marked(text)).ids == ids.tolist()


def test_pieces_query(spark, sf):
    import sentencepiece

    original = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got = queries.op10_sentencepiece(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = np.array(original.encode(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_crc32, r.round_trip) == (len(ids), zlib.crc32(ids.tobytes()), True)
        assert r.decoded_crc32 == zlib.crc32(texts[r.doc_id].encode())


def test_pieces_edges(spark, docs_with_edges):
    df, _ = docs_with_edges
    rows = pieces.encode(df)
    back = pieces.decode(rows)
    want = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.collect())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in back.collect()) == want
    assert pieces.encode(df.limit(0)).count() == 0 and pieces.digests(df).count() == df.count()


def test_unigram_models_are_rebuilt():
    # a small unigram model, written as its protobuf
    def field(n, wire, data):
        head = bytes([n << 3 | wire])
        return head + (bytes([len(data)]) + data if wire == 2 else data)

    def piece(text, score, kind=1):
        body = field(1, 2, text.encode()) + field(2, 5, np.float32(score).tobytes()) + field(3, 0, bytes([kind]))
        return field(1, 2, body)

    made = b"".join([piece("<unk>", 0, 2), piece("▁", -3), piece("▁a", -2), piece("b", -4), piece("ab", -3), piece("▁ab", -2.5)])
    model = pieces.parse(made + field(2, 2, field(3, 0, b"\x01")) + field(3, 2, field(3, 0, b"\x01") + field(4, 0, b"\x00")))
    assert model.kind == pieces.UNIGRAM_MODEL and model.unknown == 0 and len(model.pieces) == 6 and not model.squeeze


PAGES = [(1, "http://a", "same"), (2, "http://b", "same"), (3, None, None), (4, "http://d", ""), (5, "http://e\r\nx", "é" * 50_000), (6, "http://f", "é" * 50_000), (None, "http://g", "same"), (7, "http://h", "a\r\n\r\nWARC/1.1\r\n0\r\n\r\n"), (8, "u", "x"), (8, "u", "x")]


def test_warc_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "size": F.lit("x"), "kind": F.lit(2)})
    for p in (warc.WarcParams(), warc.WarcParams(segment_bytes=999, chunk_bytes=100, file_bytes=2000)):
        got = warc.archived(df, p).collect()
        assert all(r.complete for r in got) and len(got) == len(PAGES)
        rows = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in got)
        assert rows == [(0, 4, "response", None), (1, 4, "response", None), (2, 4, "revisit", 1), (3, 0, "response", None), (4, 0, "revisit", 3), (5, 100_000, "response", None), (6, 100_000, "revisit", 5), (7, 20, "response", None), (8, 1, "response", None), (8, 1, "response", None)]
        digest = {r.page_id: r.payload_digest for r in got}
        assert digest[5] == warc.base32_sha1(("é" * 50_000).encode()) == digest[6]
    assert warc.archived(df.limit(0)).count() == 0


def test_warc_query_equals_oracle(spark, sf):
    columns, rows = query_rows(queries.op6_warc(spark, sf))
    assert (columns, rows) == oracle_rows(OP6_SQL, sf)


def test_broken_segments_are_told(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "x" * 5000), (2, "u", "y" * 5000)], "page_id long, url string, html string")
    records = warc.read(warc.write(df, f"file://{tmp_path}/warc", warc.WarcParams(segment_bytes=1000))).cache()
    assert records.where("kind = 'continuation'").count() == 10
    whole = {r.page_id: r.complete for r in warc.pages(records).collect()}
    assert whole == {1: True, 2: True}
    lost = {r.page_id: (r.complete, r.payload_bytes) for r in warc.pages(records.where("not (page_id = 1 and segment = 3)")).collect()}
    assert lost == {1: (False, None), 2: (True, 5000)}
    records.unpersist()
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")


@pytest.mark.parametrize(("bits", "dims"), [(1, 2), (3, 2), (2, 3), (4, 3), (2, 4)])
def test_hilbert_steps_are_neighbours(bits, dims):
    places = sharding.hilbert_order(bits, dims)
    cells = [None] * len(places)
    for number, place in enumerate(places):
        cells[place] = [(number >> bits * (dims - 1 - j)) & (1 << bits) - 1 for j in range(dims)]
    assert all(sum(abs(a - b) for a, b in zip(x, y)) == 1 for x, y in zip(cells, cells[1:]))


def test_shards_equal_a_plain_sort(spark):
    import hashlib

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = queries.op7_sharding(spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    order = sorted(got, key=lambda r: (r.curve, hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.doc_id))
    n = len(order)
    sizes = {}
    for at, r in enumerate(order):
        assert r.shard == at * 24 // n and r.slot == sizes.get(r.shard, 0)
        sizes[r.shard] = r.slot + 1
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 24


def test_shards_prune(spark):
    got = queries.op7_sharding(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id")
    per_shard = got.groupBy("shard").agg(F.countDistinct("lang").alias("n")).agg(F.avg("n")).first()[0]
    assert per_shard < 2.5


def test_shard_edges(spark, docs_with_edges):
    df, _ = docs_with_edges
    rows = sharding.shard(df).collect()
    assert len(rows) == df.count() and len({(r.shard, r.slot) for r in rows}) == len(rows)
    assert sharding.shard(df.limit(0)).count() == 0
    same = df.where("doc_id = 0").crossJoin(spark.range(1000)).drop("id")
    sizes = sharding.shard(same).groupBy("shard").count().agg(F.min("count"), F.max("count")).first()
    assert sizes[1] - sizes[0] <= 1
    plan = sharding.shard(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_word_cache_forgets_the_least_used():
    from dbpulse.llm import textvec, wordcache

    asked = []
    cache = wordcache.WordCache(lambda words: asked.extend(words) or [[ord(c) for c in w] for w in words], most=100, recent=16)
    for n in range(30):
        text = " ".join(["often", "usual", *(f"once{n}x{i}" for i in range(20))])
        raw = np.frombuffer(text.encode(), np.uint8)
        w = textvec.words(raw, np.array([0, len(raw)]), textvec.fold_words())
        ids, lengths = cache.encode(raw, w.starts, w.ends, w.hashes)
        assert "".join(map(chr, ids)) == text.replace(" ", "") and lengths.tolist() == [len(x) for x in text.split()]
    assert asked.count("often") == asked.count("usual") == 1 and len(cache._start) <= 142


def proto(number, wire, data):
    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    return varint(number << 3 | wire) + (varint(len(data)) + data if wire == 2 else data)


def test_unigram_models_encode_like_the_original_library():
    import sentencepiece

    rng = np.random.default_rng(2)
    letters = [c for c in "abcdeé日"] + ["▁"]
    words = {"".join(rng.choice(list("abcde"), rng.integers(2, 5))) for _ in range(60)} | {"▁" + "".join(rng.choice(list("abc"), rng.integers(1, 4))) for _ in range(40)}
    scored = [(w, -float(rng.integers(8, 36)) / 4) for w in letters + sorted(words)]  # sums are exact, so that ties are ties in both libraries
    for fallback in (False, True):
        pieces_ = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + ([(f"<0x{b:02X}>", -20.0, 6) for b in range(256)] if fallback else []) + [(w, s, 1) for w, s in scored]
        body = b"".join(proto(1, 2, proto(1, 2, w.encode()) + proto(2, 5, np.float32(s).tobytes()) + proto(3, 0, bytes([k]))) for w, s, k in pieces_)
        trainer = proto(3, 0, b"\x01") + (proto(35, 0, b"\x01") if fallback else b"")
        model = body + proto(2, 2, trainer) + proto(3, 2, proto(3, 0, b"\x01") + proto(4, 0, b"\x00"))
        original = sentencepiece.SentencePieceProcessor(model_proto=model)
        backend = pieces.Backend(model)
        assert backend.model.kind == pieces.UNIGRAM_MODEL
        texts = [" ".join("".join(rng.choice(list("abcdeé日"), rng.integers(1, 9))) for _ in range(rng.integers(1, 12))) for _ in range(200)] + ["", " a", "b  c", "xyz a", "日本 x"]
        for text, ids in zip(texts, backend.encode(texts), strict=True):
            assert ids.tolist() == original.encode(text), text
            assert backend.decode(ids) == original.decode(original.encode(text)), text
        backend.verify(model, texts)


def test_tokenizers_that_do_not_go_by_words_are_refused():
    from dbpulse.llm.common import tokenizer_path as where

    with pytest.raises(ValueError, match="word by word"):
        packing.TextEncoder(where("byte_bpe_50k.json")).verify()


def test_local_search_sees_every_member():
    # the one exchange that empties a bin needs pieces far down both lists
    lengths = np.array([1] * 200 + [9] + [1] * 150 + [60])
    bins = [list(range(200)) + [200], list(range(201, 351)) + [351]]
    out = packing.local_search([list(b) for b in bins], lengths, 300, 1.0)
    assert sorted(n for b in out for n in b) == list(range(352)) and max(int(lengths[b].sum()) for b in out) == 300


def test_equal_rows_are_dealt_over_groups(spark):
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    rows = packing.packed(df, packing.PackParams(capacity=64, group=200)).collect()
    tokens = sum(r.length for r in rows)
    bins = {r.sequence_id for r in rows}
    assert len(rows) == 4000 and len(bins) <= -(-tokens // 64) * 1.1 + 1


def test_the_curve_is_that_of_the_metadata(spark):
    """The query's curve recomputed from the rows: levels of each dimension, then the cell's place."""
    import math

    level = lambda name: 0 if name is None else 1 + zlib.crc32(name.encode()) % 15
    places = sharding.hilbert_order(4, 3)
    got = {r.doc_id: r.curve for r in queries.op7_sharding(spark, "/root/testdata/sf0.01").collect()}
    for r in table(spark, "/root/testdata/sf0.01", "documents").collect():
        size = min(15, max(0, math.floor(math.log2(len(r.text.encode()) + 8) * 1.5 - 8)))
        assert got[r.doc_id] == places[level(r.lang) << 8 | size << 4 | level(r.source)]
    assert sorted(places) == list(range(1 << 12))


@pytest.mark.parametrize("letters", [10, 12])
def test_words_made_to_collide_keep_their_ids(spark, letters):
    from test_minhash import morse
    from tokenizers import Tokenizer

    a, b = morse(letters)
    rows = [(1, f"say {a} now"), (2, f"say {b} now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = {i: zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, x in rows}
    assert {r.doc_id: r.ids_crc32 for r in packing.packed(df).collect()} == want
    got = {r.doc_id: r for r in pieces.digests(df).collect()}
    assert got[1].ids_crc32 != got[2].ids_crc32 and got[1].round_trip and got[2].round_trip


def test_words_of_one_hash_are_compared_by_their_bytes():
    from dbpulse.llm import wordcache

    rng = np.random.default_rng(2)
    cache = wordcache.WordCache(lambda words: [[ord(c) for c in w] for w in words], most=40, recent=7)
    for _ in range(60):
        words = ["".join(rng.choice(list("abc"), rng.integers(1, 5))) for _ in range(30)]
        raw = np.frombuffer("".join(words).encode(), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        starts = ends - [len(w) for w in words]
        hashes = np.array([len(w) % 2 + 2 * (w[0] == "a") for w in words], np.uint64)  # four hashes for 120 words
        ids, lengths = cache.encode(raw, starts, ends, hashes)
        assert bytes(ids.astype(np.uint8)) == raw.tobytes() and lengths.tolist() == [len(w) for w in words]


def test_archives_refer_to_records_that_exist(spark, tmp_path):
    import gzip
    from pathlib import Path

    pages = [(i, f"http://x.example/{i}", f"<p>{i % 7}</p>" * 40) for i in range(50)] + [(100, None, None), (101, None, ""), (3, "http://x.example/other", "another payload"), (60, "http://x.example/60", "another payload")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    warc.write(df, f"file://{tmp_path}/warc", warc.WarcParams(segment_bytes=500)).collect()
    ids, refers = [], {}
    for path in Path(tmp_path, "warc").glob("*.warc.gz"):
        records = list(warc.parse_records(gzip.open(path)))
        assert records[0][0]["warc-type"] == "warcinfo" and records[0][0]["warc-filename"] == path.name
        for fields, _ in records:
            ids.append(fields["warc-record-id"])
            if fields["warc-type"] == "revisit":
                refers[fields["warc-record-id"]] = (fields["warc-refers-to"], fields.get("warc-refers-to-target-uri"), fields["warc-refers-to-date"])
    assert len(ids) == len(set(ids)) and len(refers) == 50 - 7 + 1 + 1
    assert all(to in ids for to, _, _ in refers.values())
    assert {uri for _, uri, _ in refers.values()} == {f"http://x.example/{i}" for i in range(7)} | {None, "http://x.example/other"}


def test_archives_shuffle_no_payload(spark, sf):
    seen = []
    real = warc.cut
    try:
        warc.cut = lambda df, what: seen.append((what, df._jdf.queryExecution().executedPlan().toString())) or real(df, what)
        warc.write(table(spark, sf, "pages"), warc.fresh_path(spark, "warc"))
    finally:
        warc.cut = real
    assert [w for w, _ in seen] == ["digests", "firsts", "relations", "manifest"]
    assert not [line for _, plan in seen for line in plan.splitlines() if "Exchange" in line and "html" in line]
