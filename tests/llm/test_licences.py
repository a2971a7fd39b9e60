"""The licence scan against a plain version that scores every run of lines; repeated ids and short templates."""

import math
import textwrap

import numpy as np

from dbpulse.llm import licences, queries
from dbpulse.llm.common import table

SF = "/root/testdata/sf0.001"


def plain(text, model, p=licences.LicenceParams()):
    """(licence, similarity, paragraph, notices, families) by the definitions alone."""
    lines = [licences.tokens(x) for x in (text or "").split("\n")]
    at = {g: i for i, g in enumerate(model.grams)}
    good = []
    for a in range(len(lines)):
        inner = 0
        for b in range(a, len(lines)):
            if (b > a + 1 and (inner := inner + len(lines[b - 1])) > model.reach) or not lines[b]:
                break
            words = [w for line in lines[a : b + 1] for w in line]
            grams = licences.grams_of(words)
            z = (model.bias + model.weights[[at[g] for g in grams if g in at]].sum(axis=0)) / model.temperature
            c = int(np.argmax(z))
            probability = 1 / np.exp(z - z.max()).sum()
            best, enough = 0.0, False
            for t in model.templates:
                if c < len(model.families) and t.family == model.families[c]:
                    pairs = {g for g in t.grams if " " in g}
                    if t.marks - grams or t.others & grams:
                        continue
                    if a == b or len(grams & pairs) >= t.share * len(pairs):
                        best = max(best, len(grams & t.grams) / len(t.grams))
                        enough |= len(grams & t.grams) / len(t.grams) >= t.share
            if enough and probability >= p.least_probability:
                first = min(i for i in range(a, b + 1) if set(lines[i]) & set(model.keys))  # there is always one
                good.append((first, a, b, (best, a - b, round(float(probability), 12), -a, b, c)))
    notices, now = [], None
    for _, a, b, rank in sorted(good):
        if now is None or a > now[4]:
            notices += [now] if now else []
            now = rank
        else:
            now = max(now, rank)
    notices += [now] if now else []
    if not notices:
        return licences.UNKNOWN, None, None, 0, []
    top = max(notices)
    return model.families[top[5]], top[0], -top[3], len(notices), sorted({model.families[r[5]] for r in notices})


def same(got, want):
    close = got.similarity == want[1] or math.isclose(got.similarity, want[1], abs_tol=1e-12)
    return close and (got.licence, got.paragraph, got.notices, got.families) == (want[0], *want[2:])


def test_query_equals_brute_force(spark):
    docs = table(spark, SF, "documents")
    model = licences.fit()
    got = {r.doc_id: r for r in queries.op3_licences(spark, SF).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows) and sum(r.licence != licences.UNKNOWN for r in got.values()) > 3
    for r in rows:
        assert same(got[r.doc_id], plain(r.text, model))


def test_wrapped_and_adjoining_notices_equal_brute_force(spark):
    whole = [t for ts in licences.TEMPLATES.values() for t in ts]
    texts = ["\n".join(textwrap.wrap(t, w)) for t in whole for w in (15, 60)]
    texts += ["\n".join([*textwrap.wrap(a, 33), *textwrap.wrap(b, 41)]) for a, b in zip(whole, whole[5:], strict=False)]
    texts += ["All rights reserved.\n" * 40, "license\n" * 90, "a\n\n\nlicensed under\nthe mit\n\nlicense", "\n".join(licences.LOOKALIKES), "", None, " \n "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = licences.fit()
    got = {r.doc_id: r for r in licences.scan(df, model).collect()}
    for i, t in enumerate(texts):
        assert same(got[i], plain(t, model)), t
    rows = licences.classify(df, model).collect()
    assert rows and all(0 <= r.similarity <= 1 and 0 < r.probability <= 1 + 1e-12 and r.paragraph <= r["last"] for r in rows)


def test_rows_that_share_an_id_do_not_add_up(spark):
    parts = ["Licensed under the rules of the city", "You may not use this file", "A single rights reserved for the club", "Released under the MIT License."]
    rows = [(i, t) for i, t in enumerate(parts) for _ in range(3)] + [(9, parts[0]), (9, parts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = licences.scan(df, licences.fit()).collect()
    assert len(got) == len(rows)
    assert all(r.licence == licences.UNKNOWN and r.similarity is None for r in got if r.doc_id < 3)
    assert all(r.licence == "MIT" and r.similarity == 1 and r.notices == 1 for r in got if r.doc_id == 3)
    assert sorted(r.licence for r in got if r.doc_id == 9) == ["MIT", licences.UNKNOWN]


AFTER = {"GPL-3.0": ", or (at your option) any later version.", "GPL-2.0": ", or (at your option) any later version.", "LGPL-2.1": ", or (at your option) any later version.", "AGPL-3.0": ", or (at your option) any later version."}
SIBLINGS = [
    *[(f, next(t for t in licences.TEMPLATES[f] if t.startswith("This program") or t.startswith("This library")) + AFTER[f]) for f in AFTER],
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice.\n\n2. Redistributions in binary form must reproduce the above copyright notice."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-2.0", "This work is licensed under a Creative Commons Attribution 2.0 Generic License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("unknown", "This work is not licensed under the MIT License."),
    ("unknown", "This work is no longer released under the MIT License."),
    ("unknown", "This work is licensed under a Creative Commons Attribution-ShareAlike 2.5 Generic License."),
    ("unknown", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License."),
    ("unknown", "This work is licensed under the GNU General Public License."),
    ("unknown", "This work is licensed under the GNU General Public License, version 1."),
    ("unknown", "Licensed under the Apache License, Version 1.1."),
    ("unknown", "SPDX-License-Identifier: GPL-1.0-only"),
]


def test_siblings_and_denials_are_told_apart(spark):
    rows = [(i, "\n".join(line for part in text.split("\n") for line in (textwrap.wrap(part, width) or [""]))) for width in (72, 10_000) for i, (_, text) in enumerate(SIBLINGS)]
    model = licences.fit()
    for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect():
        assert r.licence == SIBLINGS[r.doc_id][0] and r.families == ([] if r.licence == "unknown" else [r.licence]), SIBLINGS[r.doc_id]
    whole = [(i, t, f) for i, (f, t) in enumerate((f, t) for f, ts in licences.TEMPLATES.items() for t in ts)]
    found = {r.doc_id: r.licence for r in licences.scan(spark.createDataFrame(whole, "doc_id long, text string, family string"), model).collect()}
    assert found == {i: f for i, _, f in whole}
    assert model.calibration_error < 0.05


def test_rows_without_an_id_are_scanned(spark):
    got = licences.scan(spark.createDataFrame([(None, "Released under the MIT License."), (None, "nothing")], "doc_id long, text string"), licences.fit()).collect()
    assert sorted(r.licence for r in got) == ["MIT", "unknown"]
