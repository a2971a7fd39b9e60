"""The whole toxicity query against a plain version: every word, every example, no index."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from dbpulse.llm import queries, toxicity
from dbpulse.llm.common import table

SF = "/root/testdata/sf0.001"


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return "".join(" " if ord(c) < 128 and not c.isalnum() else c for c in low).split(" ")


def bag(text):
    return Counter(w for w in tokens(text) if w)


def plain(docs, labels, floor=0.02, k=15, bins=20):
    """{doc_id: score} of all rows by the definitions alone; docs are (doc_id, text), labels (doc_id, toxic)."""
    bags = [(i, bag(t)) for i, t in docs]
    grade = {}
    for i, y in labels:
        if i is not None and y is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            grade[i] = min(grade.get(i, 1), int(y > 0))
    by_text, of_id = {}, {}
    for i, t in docs:
        if i in grade:
            of_id[i] = min(of_id.get(i, t or ""), t or "")
    for i, t in sorted(of_id.items()):
        first, y = by_text.get(t, (i, 1))
        by_text[t] = (first, min(y, grade[i]))
    examples = sorted((i, bag(t), y) for t, (i, y) in by_text.items())
    total, rows = Counter(grade.values()), Counter(y for _, _, y in examples)
    df = Counter(w for _, b in bags for w in b)
    idf = {w: math.log((len(bags) + 1) / (df[w] + 1)) + 1 for _, b, _ in examples for w in b}

    def unit(b, weights):
        v = {w: (1 + math.log(c)) * weights[w] for w, c in b.items() if w in weights}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    def product(v, u):
        return round(sum(x * u.get(w, 0.0) for w, x in v.items()), 12)

    rough, first = [unit(b, idf) for _, b, _ in examples], []
    for m, v in enumerate(rough):  # an example copies what the first earlier one like it copies
        first.append(next((first[o] for o in range(m) if v and product(v, rough[o]) >= 0.8), m))
    held = defaultdict(lambda: (set(), set()))
    for (_, b, y), f in zip(examples, first, strict=True):
        for w in b:
            held[w][y].add(f)
    n = {y: len({f for (_, _, g), f in zip(examples, first, strict=True) if g == y}) for y in (0, 1)}

    def weight(w):
        c0, c1 = map(len, held[w])
        share = (c0 + c1) / (n[0] + n[1])
        seen = [(c1, n[1] * share), (c0, n[0] * share), (n[1] - c1, n[1] * (1 - share)), (n[0] - c0, n[0] * (1 - share))]
        half = sum(o * math.log(o / e) for o, e in seen if o)
        posterior = 1 / (1 + math.exp(min(50, max(-50, math.log(len(held)) - half))))
        return idf[w] * (floor + (1 - floor) * posterior)

    weights = {w: weight(w) for w in held}

    vector = lambda b: unit(b, weights)
    alone = {m: [y for (_, _, y), f in zip(examples, first, strict=True) if f == m] for m in sorted(set(first))}
    texts = [(m, vector(examples[m][1]), sum(ys) / len(ys)) for m, ys in alone.items()]

    def vote(v, without=None):
        near = sorted((-product(v, u), m, share) for m, u, share in texts if m != without)
        pull = [((1.05 - min(1.0, -c)) ** -2 - 1.05**-2, share) for c, _, share in [x for x in near if 0 < -x[0] <= (2 if without is None else 1 - 1e-9)][:k]]
        return sum(p * y for p, y in pull) / sum(p for p, _ in pull) if pull else 0.0

    hits, seen = [(b + 0.5) / bins * 2 for b in range(bins)], [2.0] * bins
    stands = {y: total[y] / rows[y] for y in rows}
    for m, v, share in texts:
        if v:
            b = min(bins - 1, int(vote(v, m) * bins))
            hits[b] += stands.get(1, 0) * share
            seen[b] += stands.get(1, 0) * share + stands.get(0, 0) * (1 - share)
    # least-squares ascending fit by its min-max formula
    rate = [max(min(sum(hits[a:c]) / sum(seen[a:c]) for c in range(b + 1, bins + 1)) for a in range(b + 1)) for b in range(bins)]
    prior = (sum(stands[y] * y for _, _, y in examples) + 0.5) / (sum(stands[y] for _, _, y in examples) + 1)
    middles = (np.arange(bins) + 0.5) / bins
    return [(i, float(np.interp(vote(v), middles, rate)) if (v := vector(b)) else prior) for i, b in bags]


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    labels = [tuple(r) for r in table(spark, SF, "labels").select("doc_id", "toxic").collect()]
    want = dict(plain(docs, labels))
    got = {r.doc_id: r for r in queries.op4_toxicity(spark, SF).collect()}
    assert got.keys() == want.keys() and len(got) == len(docs)
    assert all(abs(got[i].score - want[i]) < 1e-9 and got[i].predicted == int(got[i].score >= 0.7) for i in want)
    assert len({round(x, 2) for x in want.values()}) > 2


def test_ties_repeats_and_clashing_labels_equal_brute_force(spark):
    texts = ["foul word here", "foul word here", "plain word here", "plain word here", "foul", "", None, "x" * 5000 + " foul", "plain " * 3000, "unseen only"]
    rows = [(i, texts[i % len(texts)]) for i in range(120)] + [(3, "repeated id, foul"), (None, "foul word")]
    labels = [(i, int("foul" in (t or ""))) for i, t in rows if i is not None and i % 7] + [(0, 1), (0, 0), (10, 0), (None, 1), (20, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    score = lambda df: sorted(((r.doc_id, r.score) for r in toxicity.score(df, toxicity.fit(df, marks)).collect()), key=str)
    got, want = score(docs), sorted(plain(rows, labels), key=str)
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([s for _, s in got], [s for _, s in want], atol=1e-9)
    assert score(docs.orderBy(F.desc("text")).repartition(5)) == got


def test_held_out_recall_and_clean_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op4_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").select("held_out", "lang", "toxic", "predicted").collect()
    found = defaultdict(list)
    for r in rows:
        if r.held_out:
            found[r.lang if r.toxic else "clean"].append(r.predicted)
    least = {"en": 0.9, "fr": 0.9, "de": 0.8, "es": 0.75}  # of 82, 30, 20 and 12 documents
    assert all(np.mean(found[lang]) >= share for lang, share in least.items()) and len(found) == 5
    assert np.mean([p for lang in least for p in found[lang]]) >= 0.9 and np.mean(found["clean"]) <= 0.01
    learnt = [r.predicted for r in rows if r.toxic == 1 and not r.held_out]
    assert np.mean(learnt) > 0.99


def test_a_copy_of_an_example_has_its_vote(spark):
    texts = [("you are an idiot of the worst kind", 1), ("what a worthless and disgusting moron", 1), ("the meeting takes place on monday at ten", 0), ("please find the report in the usual folder", 0)]
    learnt = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 == 1]
    rows = [(ids[n], t, y) for ids in (learnt, held) for n, (t, y) in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    for r in toxicity.score(df.select("doc_id", "text"), model).join(df.select("doc_id", "toxic"), "doc_id").collect():
        assert r.predicted == r.toxic and r.evidence_ids and r.evidence_terms
        assert (r.score >= 0.7) == (r.toxic == 1)


def test_copies_of_a_toxic_text_do_not_make_its_words_toxic(spark):
    rng = np.random.default_rng(3)
    word = lambda: "w" + str(rng.integers(0, 3000))
    toxic_text = ["foulword", *(word() for _ in range(80))]
    rows = []
    for i in range(900):
        words = [word() for _ in range(40)]
        if i < 200:  # near copies of one toxic text
            words = list(toxic_text)
            words[1 + int(rng.integers(0, 80))] = word()
        elif i < 300:
            words[int(rng.integers(0, 40))] = "foulword"
        elif i >= 800:  # clean, with words of the copied text
            words[:6] = toxic_text[10:16]
        rows.append((i, " ".join(words), int(i < 300)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.where("doc_id < 800").select("doc_id", "toxic"))
    got = {r.doc_id: r.predicted for r in toxicity.score(df.select("doc_id", "text"), model).collect()}
    assert all(got[i] == 1 for i in range(300)) and not any(got[i] for i in range(300, 800))
    assert sum(got[i] for i in range(800, 900)) <= 5  # among so few words some tell the labels apart by chance
    weight = dict(zip(model.terms, model.weights, strict=True))
    assert weight["foulword"] > 10 * max(weight[w] for w in toxic_text[1:] if w in weight)
