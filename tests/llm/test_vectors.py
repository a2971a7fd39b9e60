"""Neighbour search and near-duplicate vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import oracle_rows, query_rows
from dbpulse.llm import neighbours, queries, tiles
from dbpulse.llm.oracles import OP8_SQL

SF = "/root/testdata/sf0.01"
BAD = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] + [1.0] * 15), (904, [float("inf")] + [1.0] * 15), (905, [None] + [1.0] * 15)]


def made(spark, n=700, copies=150):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 16)).astype(np.float32)
    x[300:330] = x[300] + rng.normal(size=(30, 16)).astype(np.float32) * 0.05
    x[n - copies :] = x[7]
    rows = [(i + 1000, v.tolist()) for i, v in enumerate(x)] + BAD + [(None, [1.0] * 16)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"rep": F.lit("clash"), "v": F.lit(1), "query": F.lit(2), "n": F.lit(3)})


def test_recall_and_order(spark):
    x, df = made(spark)
    got = neighbours.nearest(df, F.col("vec_id") % 5 == 0).collect()
    ids = np.arange(len(x)) + 1000
    by_query = {}
    for r in got:
        by_query.setdefault(r.query_id, []).append(r)
    assert set(by_query) == set(ids[ids % 5 == 0].tolist())
    hit = total = 0
    for q, rows in by_query.items():
        score = x.astype(float) @ x[q - 1000].astype(float)
        score[q - 1000] = -np.inf
        want = ids[np.lexsort((ids, -score))[:20]]
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21))
        assert np.allclose([r.score for r in rows], score[[r.vec_id - 1000 for r in rows]], rtol=0, atol=1e-12)
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        hit += len(set(want.tolist()) & {r.vec_id for r in rows})
        total += 20
    assert hit / total >= 0.95


def test_recall_of_the_query(spark):
    from dbpulse.llm.common import table

    rows = table(spark, SF, "embeddings").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    got = queries.op5_neighbours(spark, SF).collect()
    hit = 0
    for q in ids[ids % 20 == 0]:
        score = x @ x[ids == q][0]
        score[ids == q] = -np.inf
        hit += len(set(ids[np.lexsort((ids, -score))[:20]].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert hit / (20 * (ids % 20 == 0).sum()) >= 0.9


def test_few_candidates_and_none(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (21, [0.5, 0.5]), (40, [0.5, 0.5])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r)[:4] for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(20, 1, 21, 0.5), (20, 2, 40, 0.5), (40, 1, 20, 0.5), (40, 2, 21, 0.5)]
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0


def test_adc_is_the_product_with_decoded_vectors():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 10))
    index = neighbours.train(x, 500, neighbours.IvfParams(sub_dims=2))
    own = neighbours._nearest(x, index.coarse)
    codes = index.encode(x, own)
    for c in np.unique(own)[:3]:
        rows = np.flatnonzero(own == c)
        decoded = index.coarse[c] + np.stack([index.books[m][codes[rows, m]] for m in range(5)], axis=1).reshape(len(rows), -1)
        assert np.allclose(neighbours.adc(index, int(c), x[:7], codes[rows]), x[:7] @ decoded.T, atol=1e-5)


def brute(x, ids, threshold=0.95):
    u = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    label = ids.copy()
    while True:
        new = np.minimum(label, np.where(near, label[None, :], 1 << 60).min(axis=1))
        if (new == label).all():
            return near.sum(axis=1), label
        label = new


def test_links_equal_brute_force(spark):
    x, df = made(spark)
    ids = np.arange(len(x)) + 1000
    links, component = brute(x.astype(float), ids)
    for p in (tiles.TileParams(), tiles.TileParams(block=64, pivots=5)):
        got = {r.vec_id: r for r in tiles.near_vectors(df, p).collect()}
        assert len(got) == len(x) + len(BAD)
        assert [got[i].n_links for i in ids.tolist()] == links.tolist()
        assert [got[i].component_id for i in ids.tolist()] == component.tolist()
        assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, _ in BAD)


def test_links_equal_oracle(spark, sf):
    assert query_rows(queries.op8_near_vectors(spark, sf)) == oracle_rows(OP8_SQL, sf)


def test_bound_is_rigorous():
    rng = np.random.default_rng(2)
    u, v = tiles.unit(rng.normal(size=(200, 33))), tiles.unit(rng.normal(size=(200, 33)))
    upper = tiles._bounded(*tiles.quantised(u), True) @ tiles._bounded(*tiles.quantised(v), False).T
    assert (upper >= u @ v.T - 1e-5).all()


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in tiles.near_vectors(df).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert tiles.near_vectors(df.limit(0)).count() == 0


def test_open_pairs_and_pruned_blocks_equal_brute_force(spark):
    """Clusters whose cosines lie about the threshold, cells large enough to be ruled out, and lengths that no pivot has."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 16)) * 3
    x = np.concatenate([c + rng.normal(size=(60, 16)) * s for c, s in zip(centres, np.linspace(0.15, 1.2, 12), strict=True)])
    x = np.concatenate([x, x[:40] * 2.5, np.tile(x[50], (30, 1)) * rng.uniform(0.5, 2, (30, 1))]).astype(np.float32)
    ids = np.arange(len(x)) * 3 + 5
    links, component = brute(x.astype(float), ids)
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)] + [(i, [1.0, float(i % 7)]) for i in range(10**6, 10**6 + 70)] + [(5, x[3].tolist()), (5, x[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for p in (tiles.TileParams(), tiles.TileParams(block=40, pivots=12), tiles.TileParams(block=16, pivots=2, rows=7)):
        got = tiles.near_vectors(df, p).collect()
        assert len(got) == len(rows)
        by_id = {r.vec_id: r for r in got if 5 < r.vec_id < 10**6}
        same = lambda r: r.n_links - 2 * (component[0] == r.component_id and r.vec_id in linked)
        u = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(axis=1, keepdims=True))
        linked = set(ids[u @ u[3] >= 0.95].tolist())
        assert [same(by_id[i]) for i in ids[1:].tolist()] == links[1:].tolist()
        assert [by_id[i].component_id for i in ids[1:].tolist()] == component[1:].tolist()
        assert all(r.n_links == 9 and r.component_id == 10**6 + (r.vec_id - 10**6) % 7 for r in got if r.vec_id >= 10**6 and r.vec_id % 7 == 0)


def test_verdicts_of_pairs_are_rigorous():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(1, 24))
    u = tiles.unit(base + rng.normal(size=(300, 24)) * 0.23)
    exact = u @ u.T
    seen, surely = np.zeros((300, 300), bool), np.zeros((300, 300), bool)
    x = tiles.quantised(u)
    assert x.q.dtype == np.int8
    for r, c, sure in tiles.tile_pairs(x, x, True, tiles.TileParams(rows=64)):
        seen[r, c] = True
        surely[r[sure], c[sure]] = True
    above = np.triu(exact >= 0.95, 1)
    assert (seen | ~above).all() and (above | ~surely).all()
    assert surely.sum() > 0 and (seen & ~surely).sum() < seen.sum()


def test_exact_search_equals_brute_force(spark):
    """Every candidate of every query, whatever the lists; ties at the last rank, lengths apart, repeated ids."""
    rng = np.random.default_rng(6)
    x = rng.integers(-2, 3, (400, 6)).astype(np.float32)  # few values: many exact ties
    x[~x.any(axis=1)] = 1
    short = rng.normal(size=(30, 3)).astype(np.float32)
    rows = [(i * 10, v.tolist()) for i, v in enumerate(x)] + [(10_000 + i * 10, v.tolist()) for i, v in enumerate(short)]
    rows += [(40, x[4].tolist()), (50, [9.0, 9.0, 9.0])]  # id 50 counts by its shorter vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors = {i: v for i, v in rows} | {40: x[4].tolist(), 50: [9.0, 9.0, 9.0]}
    p = neighbours.IvfParams(exact=True, part=64)
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, p).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in vectors if i % 20 == 0}
    for q, found in got.items():
        score = sorted((-float(np.dot(np.array(v, float), np.array(vectors[q], float))), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
        assert [(i, s) for _, i, s in sorted(found)] == [(i, pytest.approx(-s)) for s, i in score[:20]]


@pytest.mark.parametrize("sample", [300, 16_384])
def test_recall_is_measured_on_all_vectors_and_the_search_widened(spark, sample):
    """However small a part of the table training saw, the measured recall is that of the whole table."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got, told = {}, set()
    for r in neighbours.nearest(df, F.col("vec_id") % 40 == 0, neighbours.IvfParams(sample=sample, probes=64)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
        told.add(r.sample_recall)
    hit = 0
    for q in range(0, 6000, 40):
        score = x @ x[q]
        score[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-score)[:20].tolist()))
    [recall] = told
    assert recall >= 0.955 and abs(hit / (150 * 20) - recall) < 0.04


def test_recall_on_more_vectors(spark):
    rng = np.random.default_rng(11)
    x = (rng.normal(size=(12_000, 24)) * rng.lognormal(sigma=0.5, size=(12_000, 1))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    wide = x.astype(float)
    hit = 0
    for q in range(0, 12_000, 100):
        score = wide @ wide[q]
        score[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-score)[:20].tolist()))
    assert hit / (120 * 20) >= 0.93


def recalls(spark, x, params=neighbours.IvfParams()):
    """The share of each query's true neighbours that are found, and the recall that is told; every twentieth row is a query."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got, told = {}, set()
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, params).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
        told.add(r.sample_recall)
    wide, out = x.astype(float), []
    for q in range(0, len(x), 20):
        score = wide @ wide[q]
        score[q] = -np.inf
        out.append(len(got.get(q, set()) & set(np.argsort(-score, kind="stable")[:20].tolist())) / 20)
    return np.array(out), told.pop()


def test_recall_of_queries_unlike_the_other_rows(spark):
    """The rows that ask lie where hardly any others do, so most rows tell nothing of how many lists these need."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(50, 32))[rng.integers(0, 50, 6000)] + 0.05 * rng.normal(size=(6000, 32))
    x[::20] = rng.normal(size=(300, 32))
    found, told = recalls(spark, x.astype(np.float32))
    assert found.mean() >= 0.97 and abs(found.mean() - told) < 0.02


@pytest.mark.parametrize("scale", [1e25, 1e-25])
def test_recall_of_very_large_and_very_small_components(spark, scale):
    found, _ = recalls(spark, (np.random.default_rng(3).normal(size=(2000, 16)) * scale).astype(np.float32))
    assert found.mean() >= 0.97


def test_near_copies_leave_no_more_candidates_than_other_vectors(spark, monkeypatch):
    """Of a large group of near copies a scan hands on a query's k nearest, found exactly, however little tells them apart."""
    from dataclasses import replace

    import pyarrow as pa

    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16))
    x[:1500] = x[0] + 1e-4 * rng.normal(size=(1500, 16))
    index = neighbours.train(x, 3000, neighbours.IvfParams())
    index = replace(index, probe=len(index.coarse))
    own = neighbours._nearest(x, index.coarse)
    codes = index.encode(x, own)
    gain, along, off, rounding = index.gains(x, own, codes)
    decoded = index.coarse[own] + gain[:, None] * index.decoded(codes, 16)
    ways = x[:40] / np.linalg.norm(x[:40], axis=1, keepdims=True)
    toward = (ways @ index.ways().T)[:, own]
    across = np.sqrt(np.maximum(0, 1 - toward**2) + 1e-14)
    assert (np.abs(ways @ (x - decoded).T - toward * along) <= across * off + rounding).all()
    vectors = pa.table({"rep": np.arange(3000), "list": own, "codes": neighbours.packed(codes), "gain": gain, "along": along, "off": off, "rounding": rounding, "v": neighbours.packed(x)})
    queries = pa.table({"query_rep": np.arange(0, 3000, 20), "floor": np.full(150, -np.inf), "home": own[::20], "q": neighbours.packed(x[::20])})
    scored, real = [], neighbours.products
    monkeypatch.setattr(neighbours, "products", lambda a, b, row, col: scored.append(len(row)) or real(a, b, row, col))
    got = neighbours.scanned_part(index, vectors, queries, np.float64, 1.0, 21).to_pylist()
    assert len(got) == 150 * 21 and sum(scored) < 150 * 1500 / 4
    for q in range(0, 3000, 20):
        assert {r["rep"] for r in got if r["query_rep"] == q} == set(np.argsort(-(x @ x[q]))[:21].tolist())
    found, _ = recalls(spark, x.astype(np.float32))
    assert found[:75].mean() >= 0.97 and found[75:].mean() >= 0.97
