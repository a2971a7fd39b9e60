"""Licence scan: a trained paragraph classifier, with DataFrame functions only on the scan.

Paragraphs are lines, and joins of adjacent lines, as notices are wrapped; each is
a set of word 1- and 2-grams. A sparse multinomial logistic regression over the
templates' n-grams gives each paragraph a licence family or ``unknown``; the
unknown class is trained on sentences that only sound like licences, denials, and
notices of licences that aren't known here, and probabilities are calibrated by a
temperature fitted on rows held out of training. A prediction counts as confirmed when
the paragraph contains enough of one of the family's templates, and more of a short
one; joined lines must also hold as large a share of its 2-grams, so that words strewn
over a long passage are no notice. What tells a licence from its siblings, such as
"affero", "sharealike" or a version, must be in the paragraph just as in the template,
and nothing may deny the licence.

No template can be confirmed without its anchor, one of a few rare words. Texts without any
are settled by a substring test, and of the others only runs of lines that hold
one are scored. Every row is scanned by itself in array functions, against
literals of at most a few hundred n-grams: nothing is shuffled or broadcast.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import reduce
from operator import or_
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"

# Usual notices of each licence family.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "LGPL-3.0": [
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    # what both BSD licences begin with; only further clauses would tell which
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-3.0": ["Licensed under CC BY 3.0.", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."],
    "CC-BY-2.0": ["Licensed under CC BY 2.0.", "This work is licensed under a Creative Commons Attribution 2.0 Generic License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-SA-3.0": ["Licensed under CC BY-SA 3.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "CC0-1.0": [
        "Released into the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "Proprietary": [
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.",
    ],
}
# Words and pairs that tell licences of one group apart. A notice must hold those that its template holds, and no others.
MARKS: dict[str, tuple[str, list[str]]] = {
    "GNU": (r"A?L?GPL-", ["affero", "lesser", "library general", "agpl", "lgpl", "gpl", "gpl 1", "gpl 2", "gpl 3", "lgpl 2", "lgpl 3", "agpl 1", "agpl 3", "version 1", "version 2", "version 3", "2 1"]),
    "CC": (r"CC", ["1 0", "2 0", "2 1", "2 5", "3 0", "4 0", "sharealike", "share alike", "sa", "noncommercial", "non commercial", "nc", "noderivatives", "noderivs", "no derivatives", "no derivs", "nd", "sampling"]),
    "BSD": (r"BSD", ["0 clause", "1 clause", "2 clause", "3 clause", "4 clause"]),
    "Apache": (r"Apache-", ["1 0", "1 1", "2 0"]),
    "Mozilla": (r"MPL-", ["1 0", "1 1", "2 0"]),
    "Eclipse": (r"EPL-", ["1 0", "2 0"]),
}
# Pairs by which a sentence says that a licence doesn't hold.
DENIALS = ["not licensed", "not released", "not under", "not covered", "not available", "not distributed", "never licensed", "never released", "longer licensed", "longer released", "longer under", "longer available", "nor licensed", "nor released"]
# Sentences with licence words that grant nothing.
LOOKALIKES = [
    "You need a driving license to rent a car in this city.",
    "The pilot flew an Apache helicopter over the hills.",
    "She studied at MIT before she moved to the public sector.",
    "All human rights apply to every person in the world.",
    "The rooms are reserved for all members of the club.",
    "Version 2.0 of the report is the one to read.",
    "Without permission nobody may enter this part of the building.",
    "The software is free of charge for the first month.",
    "A general public meeting is held under the old bridge.",
    "The copyright office opens at nine and the license desk at ten.",
    "This work is part of a series on common tools and creative writing.",
    "The following conditions are usual in winter.",
    "Released under pressure, the report named no author.",
    "The license plate was found under the car.",
]


# Words of which every template holds one, rare in other texts. A notice must hold the first of them that its template holds.
ANCHORS = ["mit", "hereby", "apache", "gnu", "gpl", "agpl", "lgpl", "redistribution", "bsd", "isc", "mozilla", "mpl", "eclipse", "epl", "creative", "cc0", "cc", "waived", "unencumbered", "unlicense", "reserved"]


@dataclass(frozen=True)
class LicenceParams:
    strewn: int = 1200  # rows of a few n-grams from anywhere that train the unknown class
    keep_rate: float = 0.85  # of a template's words in each of its training variants
    variants: int = 12
    l1: float = 3e-4
    rounds: int = 400
    least_similarity: float = 0.6  # of a template's n-grams found in the paragraph, to confirm
    short_words: int = 10  # a template of fewer words asks for more
    short_similarity: float = 0.75
    least_probability: float = 0.5


class Template(NamedTuple):
    family: str
    grams: frozenset
    words: int
    share: float  # of its n-grams that confirm it
    marks: frozenset = frozenset()  # that it must hold
    others: frozenset = frozenset()  # that it must not hold


@dataclass(frozen=True)
class LicenceModel:
    families: list[str]  # unknown is the last class
    grams: list[str]
    weights: np.ndarray  # (grams, classes), mostly 0
    bias: np.ndarray
    temperature: float
    templates: list[Template]
    calibration_error: float  # mean gap between probability and share of right answers, by tenths, on rows held out
    keys: list[str]  # words of which every confirmed paragraph holds one

    @property
    def reach(self) -> int:
        """Words between the first and the last line of a join at most: twice those of the longest template."""
        return 2 * max(t.words for t in self.templates)


def tokens(text: str) -> list[str]:
    low = text.lower()
    return "".join(c if c.isascii() and c.isalnum() else " " for c in low).split()


def grams_of(words: list[str]) -> frozenset:
    return frozenset(words) | frozenset(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))


def _words(line: Column) -> Column:
    """The words of a line in lower case."""
    return F.filter(F.split(line, "[^a-z0-9]+", -1), lambda w: w != "")


def _known(words: Column, vocabulary: Column) -> Column:
    """The distinct n-grams of a word array that the vocabulary has."""
    after = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    # the last word has none after it and joins to itself, which the intersection takes once
    return F.array_intersect(F.concat(words, F.zip_with(words, after, lambda a, b: F.concat_ws(" ", a, b))), vocabulary)


def _texts(values) -> str:
    """SQL for an array of texts that hold only a-z, 0-9 and blanks."""
    return f"array({', '.join(repr(v) for v in values)})" if values else "cast(array() as array<string>)"


def template(family: str, text: str, p: LicenceParams) -> Template:
    words = tokens(text)
    grams = grams_of(words)
    of_group = frozenset(m for like, marks in MARKS.values() if re.match(like, family) for m in marks)
    share = p.short_similarity if len(words) < p.short_words else p.least_similarity
    anchor = frozenset({next(w for w in ANCHORS if w in grams)})
    return Template(family, grams, len(words), share, of_group & grams | anchor, of_group - grams | frozenset(DENIALS))


def fit(params: LicenceParams = LicenceParams()) -> LicenceModel:
    """Trains on variants of the templates; the unknown class on what only looks like them.

    That is lookalike sentences, templates with a denial, templates whose marks are those of a licence that isn't known here,
    and n-grams strewn at random. No document is read, so a text is judged alike in every corpus.
    """
    p = params
    rng = np.random.default_rng(11)
    families = list(TEMPLATES)
    unknown = len(families)
    templates = [template(f, text, p) for f in families for text in TEMPLATES[f]]
    vocabulary = sorted(set().union(*(t.grams for t in templates), DENIALS, *(marks for _, marks in MARKS.values())))
    rows: list[tuple[frozenset, int]] = []
    known = {t.marks for t in templates}
    for c, f in enumerate(families):
        for text in TEMPLATES[f]:
            words, t = tokens(text), template(f, text, p)
            rows.append((grams_of(words), c))
            for _ in range(p.variants):
                kept = [w for w in words if rng.random() < p.keep_rate or w in t.marks]
                rows.append((grams_of(kept), c))
            rows += [(t.grams | {d}, unknown) for d in DENIALS]
            anchor = t.marks & set(ANCHORS)
            rows += [(t.grams - t.marks | anchor | {m}, unknown) for m in sorted(t.others - set(DENIALS)) if anchor | {m} not in known]
    for text in LOOKALIKES:
        rows += [(grams_of(tokens(text)), unknown)] * p.variants
    for _ in range(p.strewn):
        rows.append((frozenset(rng.choice(vocabulary, rng.integers(1, 9), replace=False).tolist()), unknown))
    return _train(rows, vocabulary, families, templates, sorted(set(ANCHORS)), p)


def _train(rows: list, vocabulary: list[str], families: list[str], templates: list[Template], keys: list[str], p: LicenceParams) -> LicenceModel:
    """Proximal gradient steps with an L1 penalty; every fifth row, by a checksum, only fits the temperature."""
    at = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)))
    for i, (grams, _) in enumerate(rows):
        x[i, [at[g] for g in grams if g in at]] = 1
    y = np.array([c for _, c in rows])
    classes = len(families) + 1
    share = np.bincount(y, minlength=classes)
    weight = 1 / np.sqrt(share[y])
    held = np.array([zlib.crc32(f"{i}".encode()) % 5 == 0 for i in range(len(rows))])
    one = np.eye(classes)[y]
    w, b = np.zeros((len(vocabulary), classes)), np.zeros(classes)
    xt, yt, wt = x[~held], one[~held], (weight / weight[~held].sum())[~held][:, None]
    rate = 8.0
    v, vb = np.zeros_like(w), np.zeros_like(b)
    for step in range(p.rounds):
        gap = (_softmax(xt @ w + b) - yt) * wt
        v, vb = 0.9 * v + xt.T @ gap, 0.9 * vb + gap.sum(axis=0)
        w, b = w - rate * 0.1 * v, b - rate * 0.1 * vb
        w = np.sign(w) * np.maximum(np.abs(w) - rate * 0.1 * p.l1, 0)
    z, yh = x[held] @ w + b, y[held]
    grid = np.exp(np.linspace(-1.5, 1.5, 61))
    loss = [-(weight[held] * np.log(np.maximum(_softmax(z / t)[np.arange(len(yh)), yh], 1e-12))).sum() for t in grid]
    t = float(round(grid[int(np.argmin(loss))], 6)) if len(yh) else 1.0
    sure = _softmax(z / t)
    tenth, right = np.minimum(9, (sure.max(axis=1) * 10).astype(int)), sure.argmax(axis=1) == yh
    gaps = [abs((right[tenth == k] - sure.max(axis=1)[tenth == k]).sum()) for k in range(10)]
    return LicenceModel(families, vocabulary, np.round(w, 6), np.round(b, 6), t, templates, float(np.sum(gaps) / max(1, len(yh))), keys)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _runs(lines: str, marks: str, most: int) -> Column:
    """(mark, a, b) of each run of lines a to b whose first key line is ``mark``; lines count from 1.

    A line without words ends a run; between its first and last line it has at most ``most`` words.
    """

    def reached(part: Column) -> Column:
        """How many lines a run goes on, of those given in order away from the mark."""
        start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("n"), F.lit(True).alias("open"))

        def step(s: Column, line: Column) -> Column:
            on = s["open"] & (F.size(line) > 0) & (s["words"] <= most)
            return F.struct((s["words"] + F.when(on, F.size(line)).otherwise(0)).alias("words"), (s["n"] + on.cast("int")).alias("n"), on.alias("open"))

        return F.aggregate(part, start, step, lambda s: s["n"])

    def around(i: Column, k: Column) -> Column:
        lo = F.greatest(F.coalesce(F.get(marks, k - 1), F.lit(0)) + 1, i - most - 1)
        back = reached(F.reverse(F.slice(lines, lo, i - lo)))
        fore = reached(F.slice(lines, i + 1, F.lit(most + 1)))
        return F.struct(i.alias("i"), (i - back).alias("a"), (i + fore).alias("b"))

    def spread(x: Column) -> Column:
        each = lambda a: F.transform(F.sequence(x["i"], x["b"]), lambda b: F.struct(x["i"].alias("mark"), a.alias("a"), b.alias("b")))
        return F.flatten(F.transform(F.sequence(x["a"], x["i"]), each))

    def near(r: Column) -> Column:
        inner = F.slice(lines, r["a"] + 1, F.greatest(r["b"] - r["a"] - 1, F.lit(0)))
        return F.aggregate(inner, F.lit(0), lambda n, w: n + F.size(w)) <= most

    return F.filter(F.flatten(F.transform(F.transform(marks, around), spread)), near)


def _scored(docs: DataFrame, model: LicenceModel, p: LicenceParams, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, runs) of every row; runs are the scored paragraphs in the order of their key lines, null where there are none.

    Each select is a step that the next ones use more than once, so that it is worked out once.
    """
    vocabulary, keys = F.expr(_texts(model.grams)), F.expr(_texts(model.keys))
    low = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.col(text_col).cast("string")).alias("low"))
    whole = F.col("low").rlike(f"(?<![a-z0-9])(?:{'|'.join(model.keys)})(?![a-z0-9])")  # asked of what the cheaper tests let through
    likely = reduce(or_, [F.col("low").contains(k) for k in model.keys]) & whole
    lines = low.select("doc_id", F.when(likely, F.transform(F.split("low", "\n", -1), _words)).alias("lines"))
    is_key = lambda i: F.arrays_overlap(F.element_at("lines", i), keys)
    marked = lines.select("doc_id", "lines", F.filter(F.sequence(F.lit(1), F.size("lines")), is_key).alias("marks"))
    # an empty list of marks is a null one: most texts stop here
    marked = marked.select("doc_id", "lines", F.when(F.size("marks") > 0, F.col("marks")).alias("marks"))
    runs = marked.select("doc_id", "lines", _runs("lines", "marks", model.reach).alias("runs"))

    def with_grams(r: Column) -> Column:
        words = F.flatten(F.slice("lines", r["a"], r["b"] - r["a"] + 1))
        return F.struct(r["a"].alias("a"), r["b"].alias("b"), F.transform(F.array(words), lambda w: _known(w, vocabulary))[0].alias("grams"))

    grams = runs.select("doc_id", F.transform("runs", with_grams).alias("runs"))
    rows = [", ".join(f"{v!r}D" for v in (w / model.temperature).tolist()) for w in model.weights]
    weights = F.expr(f"map({', '.join(f'{g!r}, array({w})' for g, w in zip(model.grams, rows, strict=True))})")
    bias = F.expr(f"array({', '.join(f'{v!r}D' for v in (model.bias / model.temperature).tolist())})")

    def with_logits(r: Column) -> Column:
        z = F.aggregate(r["grams"], bias, lambda z, g: F.zip_with(z, F.element_at(weights, g), lambda x, y: x + y))
        return F.struct(r["a"].alias("a"), r["b"].alias("b"), r["grams"].alias("grams"), z.alias("z"), F.array_max(z).alias("top"))

    logits = grams.select("doc_id", F.transform("runs", with_logits).alias("runs"))

    def with_class(r: Column) -> Column:
        probability = 1 / F.aggregate(r["z"], F.lit(0.0), lambda s, v: s + F.exp(v - r["top"]))
        return F.struct(r["a"].alias("a"), r["b"].alias("b"), r["grams"].alias("grams"), F.array_position(r["z"], r["top"]).cast("int").alias("class"), probability.alias("probability"))

    classes = logits.select("doc_id", F.transform("runs", with_class).alias("runs"))
    templates = F.expr("array(" + ", ".join(f"named_struct('class', {model.families.index(t.family) + 1}, 'grams', {_texts(sorted(t.grams))}, 'pairs', {_texts(sorted(g for g in t.grams if ' ' in g))}, 'marks', {_texts(sorted(t.marks))}, 'others', {_texts(sorted(t.others))}, 'share', {t.share!r}D)" for t in model.templates) + ")")

    def with_templates(r: Column) -> Column:
        def one(t: Column) -> Column:
            alike = F.size(F.array_intersect(r["grams"], t["grams"])) / F.size(t["grams"])
            whole = (r["a"] == r["b"]) | (F.size(F.array_intersect(r["grams"], t["pairs"])) >= t["share"] * F.size(t["pairs"]))
            agrees = (F.size(F.array_intersect(r["grams"], t["others"])) == 0) & (F.size(F.array_except(t["marks"], r["grams"])) == 0)
            return F.struct(F.when(whole & agrees, alike).otherwise(0.0).alias("similarity"), t["share"].alias("share"))

        found = F.transform(F.filter(templates, lambda t: t["class"] == r["class"]), one)
        similarity = F.coalesce(F.array_max(F.transform(found, lambda x: x["similarity"])), F.lit(0.0))
        enough = F.exists(found, lambda x: x["similarity"] >= x["share"])
        return F.struct(r["a"].alias("a"), r["b"].alias("b"), r["class"].alias("class"), r["probability"].alias("probability"), similarity.alias("similarity"), (enough & (r["probability"] >= p.least_probability)).alias("confirmed"))

    return classes.select("doc_id", F.transform("runs", with_templates).alias("runs"))


def _names(model: LicenceModel) -> Column:
    return F.array(*[F.lit(f) for f in [*model.families, UNKNOWN]])


def classify(docs: DataFrame, model: LicenceModel, params: LicenceParams = LicenceParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, paragraph, last, family, probability, similarity, confirmed) of every paragraph that holds a key word.

    A paragraph is a line, or the lines from ``paragraph`` to ``last``, counted from 0. No other paragraph can be
    confirmed. Rows are scanned one by one, those without an id too.
    """
    each = _scored(docs, model, params, id_col, text_col).select("doc_id", F.explode("runs").alias("r"))
    return each.select("doc_id", (F.col("r.a") - 1).alias("paragraph"), (F.col("r.b") - 1).alias("last"), F.element_at(_names(model), F.col("r.class")).alias("family"), "r.probability", "r.similarity", "r.confirmed")


def scan(docs: DataFrame, model: LicenceModel, params: LicenceParams = LicenceParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, licence, probability, similarity, paragraph, notices, families) of every row.

    Confirmed paragraphs that overlap are one notice: the most similar stands for it, then that of fewer lines, of
    the larger probability (to 12 places), the first. The licence is that of the best notice in the same order, and paragraph its
    first line; it is ``unknown`` with nulls beside it where nothing is confirmed, as in null and empty texts.
    notices counts them. Rows are scanned one by one, so rows that share an id each have their own result, and those
    without one. Other columns are not read.
    """
    scored = _scored(docs, model, params, id_col, text_col)
    # in the order of comparison
    ranked = lambda r: F.struct(r["similarity"].alias("similarity"), (r["a"] - r["b"]).alias("fewer"), F.round(r["probability"], 12).alias("probability"), (1 - r["a"]).alias("minus"), (r["b"] - 1).alias("last"), r["class"].alias("class"))
    notice = "struct<similarity: double, fewer: int, probability: double, minus: int, last: int, class: int>"
    good = scored.select("doc_id", F.transform(F.filter("runs", lambda r: r["confirmed"]), ranked).cast(f"array<{notice}>").alias("good"))
    state = ("n", "best", "classes", "now")
    named = lambda *values: F.struct(*[v.alias(k) for k, v in zip(state, values, strict=True)])
    start = named(F.lit(0), F.lit(None).cast(notice), F.array().cast("array<int>"), F.lit(None).cast(notice))
    closed = lambda s: (F.greatest(s["best"], s["now"]), F.array_union(s["classes"], F.array(s["now"]["class"])))

    def step(s: Column, r: Column) -> Column:
        apart = s["now"].isNull() | (-r["minus"] > s["now"]["last"])
        return F.when(apart, named(s["n"] + 1, *closed(s), r)).otherwise(named(s["n"], s["best"], s["classes"], F.greatest(s["now"], r)))

    done = good.select("doc_id", F.aggregate("good", start, step, lambda s: F.struct(s["n"].alias("n"), closed(s)[0].alias("best"), closed(s)[1].alias("classes"))).alias("s"))
    names = _names(model)
    families = F.sort_array(F.transform(F.array_compact("s.classes"), lambda c: F.element_at(names, c)))
    best = F.col("s.best")
    return done.select(
        "doc_id",
        F.coalesce(F.element_at(names, best["class"]), F.lit(UNKNOWN)).alias("licence"),
        best["probability"].alias("probability"),
        best["similarity"].alias("similarity"),
        (-best["minus"]).alias("paragraph"),
        F.coalesce("s.n", F.lit(0)).alias("notices"),
        F.coalesce(families, F.array().cast("array<string>")).alias("families"),
    )
