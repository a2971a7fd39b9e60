"""Quality, toxicity and licences: held-out accuracy, exactness of the parts, and the edges."""

import numpy as np
from pyspark.sql import functions as F

from dbpulse.llm import labelled, licences, quality, queries, toxicity
from dbpulse.llm.common import table

SF = "/root/testdata/sf0.01"


def test_ordinal_fit_orders_four_grades():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(600):
        level = rng.random()
        grade = int(level * 4)
        rows.append((grade, np.array([0, 1], np.int32), np.array([level * 3, rng.random()], np.float32)))
    m = quality.fit_ordinal(rows, 2)
    assert (np.diff(m.thresholds) > 0).all() and len(m.thresholds) == 3
    latent = np.array([(m.weights[i] * v).sum() for _, i, v in rows])
    above = m.above(latent)
    assert (np.diff(above, axis=1) <= 1e-12).all()
    expected = above.sum(axis=1)
    grades = np.array([g for g, _, _ in rows])
    assert np.corrcoef(expected, grades)[0, 1] > 0.9


def test_quality_on_held_out_rows(spark):
    scored = queries.op1_quality(spark, SF).join(table(spark, SF, "labels"), "doc_id").where(labelled.held_out(F.col("doc_id")))
    right, n = scored.agg(F.avg((F.col("keep") == (F.col("quality") == 1)).cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.98
    assert queries.op1_quality(spark, SF).count() == 1000


def test_quality_edges(spark, docs_with_edges):
    df, _ = docs_with_edges
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 0), (5, None, 1), (None, 1, 1), (0, 1, None)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels)
    assert quality.score(df, model).count() == df.count() and quality.score(df.limit(0), model).count() == 0
    empty = quality.fit(df, labels.limit(0))
    assert all(r.tail_probability >= 0.5 for r in quality.score(df, empty).collect())
    kept = quality.keep_good(df, empty)
    assert kept.columns == df.columns and kept.count() == df.count()


def test_block_max_index_is_exact():
    rng = np.random.default_rng(5)
    vectors = []
    for _ in range(700):
        idx = np.sort(rng.choice(40, rng.integers(1, 6), replace=False))
        val = rng.choice([0.25, 0.5, 0.5, 1.0], len(idx))
        vectors.append((idx, val / np.sqrt((val * val).sum())))
    index = toxicity.BlockMaxIndex(vectors, 40, 16)
    dense = np.zeros((700, 40))
    for n, (i, v) in enumerate(vectors):
        dense[n, i] = v
    for n in range(0, 700, 7):
        idx, val = vectors[n]
        scores = np.array([(dense[m, idx] * val).sum() for m in range(700)])
        scores[n] = -1
        want = [m for m in np.lexsort((np.arange(700), -np.round(scores, 12))) if scores[m] > 1e-12][:15]
        got, cosine = index.top(idx, val, 15, without=n)
        assert np.allclose(np.sort(cosine), np.sort(scores[want]))
        sure = scores[want] > scores[want][-1] + 1e-9
        assert set(np.array(want)[sure]) <= set(got.tolist())


def test_toxicity_on_planted_words(spark):
    bad = r"(?i)\b(idiot|moron|worthless|scum|clown|disgusting|trash|loser|pathetic|stupid)\b"
    scored = queries.op4_toxicity(spark, SF).join(table(spark, SF, "documents"), "doc_id").join(table(spark, SF, "labels").select("doc_id", "toxic"), "doc_id", "left")
    planted = F.col("text").rlike(bad)
    assert scored.where((F.col("predicted") == 0) & planted).count() == 0
    assert scored.where((F.col("predicted") == 1) & ~planted & (F.coalesce("toxic", F.lit(0)) == 0)).count() == 0  # other languages' words are labelled
    assert scored.where("score < 0 or score > 1 or predicted <> int(score >= 0.7)").count() == 0
    assert scored.where("predicted = 1 and (size(evidence_ids) = 0 or size(evidence_terms) = 0)").count() == 0
    held = scored.select("doc_id", "held_out").collect()
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in held)


def test_toxicity_keeps_a_rare_vocabulary(spark):
    long = "x" * 70  # a toxic word of more than 64 bytes
    words = lambda i: "achlicher" if i % 250 == 0 else long if i % 250 == 10 else "idiot"
    rows = [(i, f"some plain text {i} {words(i) if i % 10 == 0 else 'more'}", 1, int(i % 10 == 0)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "quality", "toxic"))
    assert {"achlicher", long, "idiot"} <= set(model.terms)
    wrong = toxicity.score(df.select("doc_id", "text"), model).where((F.col("doc_id") % 10 == 0) != (F.col("predicted") == 1))
    assert wrong.count() == 0


def test_toxicity_edges(spark, docs_with_edges):
    df, _ = docs_with_edges
    labels = spark.createDataFrame([(0, 1, 1), (3, 0, 0), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    for rows in (labels, labels.limit(0)):
        model = toxicity.fit(df, rows)
        assert toxicity.score(df, model).where("score is not null").count() == df.count()
        assert toxicity.score(df.limit(0), model).count() == 0
        assert toxicity.keep_clean(df, model).columns == df.columns


def test_scores_do_not_depend_on_metadata(spark):
    docs = table(spark, SF, "documents")
    model = toxicity.fit(docs, table(spark, SF, "labels"))
    moved = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("y"), "n_chars": F.lit(0)})
    assert toxicity.score(docs, model).exceptAll(toxicity.score(moved, model)).count() == 0


def test_licences_found(spark):
    notices = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "Proprietary": "All rights reserved."}
    docs = table(spark, SF, "documents")
    found = {r.doc_id: r.licence for r in queries.op3_licences(spark, SF).collect()}
    assert len(found) == docs.count()
    for r in docs.select("doc_id", "text").collect():
        own = {k for k, v in notices.items() if v in r.text.split("\n")}
        assert (found[r.doc_id] in own) if own else found[r.doc_id] == licences.UNKNOWN


def test_wrapped_licences(spark):
    import textwrap

    whole = {f: max(t, key=len) for f, t in licences.TEMPLATES.items()}
    gpl, bsd = whole["GPL-3.0"], whole["BSD"]
    rows, wanted = [], {}
    for width in (20, 70, 75, 80):
        for f, t in whole.items():
            wanted[len(rows)] = f
            rows.append("\n".join(["First line.", "", *("# " + x for x in textwrap.wrap(t, width)), "", "last line"]))
    many = ["one", *textwrap.wrap(gpl, 75), "some words between", *textwrap.wrap(bsd, 75), "All rights reserved."]
    rows += ["\n".join(many), "All the rooms\nof the house have rights\nthat are reserved for guests", "Licensed under\n\nthe Apache License"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan(df, licences.fit()).collect()}
    assert {i: got[i].licence for i in wanted} == wanted
    assert all(got[i].similarity == 1 and got[i].families == [f] for i, f in wanted.items())
    assert all(got[i].notices == 1 for i, f in wanted.items() if f in ("MIT", "GPL-3.0", "BSD"))
    n = len(wanted)
    assert got[n].families == ["BSD", "GPL-3.0", "Proprietary"] and got[n].notices == 3
    assert got[n + 1].licence == got[n + 2].licence == licences.UNKNOWN


def test_licence_lookalikes_and_edges(spark, docs_with_edges):
    df, _ = docs_with_edges
    model = licences.fit()
    rows = [(i, f"Some text before.\n{t}\nand after") for i, t in enumerate(licences.LOOKALIKES)] + [(100, "x\n  ALL RIGHTS   reserved \n"), (101, "Licensed under CC BY-SA 4.0."), (102, None), (102, "All rights reserved."), (None, "All rights reserved.")]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].licence == licences.UNKNOWN for i in range(len(licences.LOOKALIKES)))
    assert by_id[100].licence == "Proprietary" and by_id[100].paragraph == 1 and by_id[101].licence == "CC-BY-SA-4.0"
    assert by_id[102].licence == "Proprietary" and by_id[None].licence == "Proprietary"
    assert licences.scan(df, model).count() == df.count() and licences.scan(df.limit(0), model).count() == 0


def test_licence_scan_has_no_python(spark):
    docs = table(spark, SF, "documents")
    plan = queries.op3_licences(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas")) and docs.columns
