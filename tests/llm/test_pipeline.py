"""The pipeline against a plain Python version of its stages, from the fitted models on."""

import numpy as np
import pytest

from dbpulse.llm import minhash, packing, pipeline, quality, textvec, toxicity
from dbpulse.llm.common import table, tokenizer_path

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_plain_version(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = quality.fit(docs, labels)

    def latent(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        return quality.latent(raw, np.array([0, len(raw)]), model.weights)

    rows = [(i, t) for i, t in rows if model.above(latent(t))[0, 0] >= 0.5]
    good = docs.sparkSession.createDataFrame(rows, "doc_id long, text string")
    toxic = toxicity.fit(good, labels)

    def score(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        return toxicity._scores(toxic, raw, np.array([0, len(raw)]), textvec.fold_letters())[0][0]

    rows = [(i, t) for i, t in rows if score(t) < 0.7]
    from test_minhash import brute

    label = brute(rows, 5, 80)
    rows = [(i, t) for i, t in rows if label[i][1] == i]
    from test_texts import check_packed

    got = corpus_pipeline.run(spark, SF).collect()
    used, least = check_packed(got, rows)
    assert used <= least + 1 and len({r.doc_id for r in got}) == len(rows)


def test_stages_keep_columns_and_edges(spark, docs_with_edges):
    df, _ = docs_with_edges
    for stage in (pipeline.good_quality, pipeline.not_toxic, pipeline.one_of_each):
        out = stage(spark, df, SF)
        assert out.columns == df.columns
        assert stage(spark, df.limit(0), SF).count() == 0
    kept = [r.doc_id for r in pipeline.one_of_each(spark, df.select("doc_id", "text"), SF).collect()]
    assert 1 not in kept and 0 in kept and None in kept
    assert minhash.MinMaxParams().shingle == 5 and packing.PackParams().capacity == 4096 and tokenizer_path("x")


def test_one_row_of_a_group_stays(spark):
    text = "one and the same text of more than five words"
    other = "quite another text, and long enough as well, under a repeated id"
    rows = [(5, text, "b"), (5, text, "a"), (6, text, "a"), (None, text, "a"), (None, text, "a"), (8, other, "x"), (8, other, "x"), (8, text.upper(), "x"), (9, None, "x"), (9, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(map(tuple, pipeline.one_of_each(spark, df, SF).collect()), key=str)
    # 8 shares a text with 5, which is smaller, so all of its rows go with it
    assert got == sorted([(5, text, "a"), (None, text, "a"), (None, text, "a"), (9, None, "x")], key=str)
    same = spark.createDataFrame([(1, text, "b")] * 3, "doc_id long, text string, source string")
    assert [tuple(r) for r in pipeline.one_of_each(spark, same, SF).collect()] == [(1, text, "b")]
