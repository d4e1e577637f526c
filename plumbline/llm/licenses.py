"""License scans by a trained paragraph classifier.

A paragraph is a line with a word, or up to ``WRAP`` such lines in a row, as
notices are wrapped: where a line holds words of the templates and is no
confirmed notice by itself, the lines that follow are taken with it, and the
likeliest number of them. Sparse word n-grams (one to three words) of the
lower-cased paragraph feed a multinomial logistic regression over licence
families and ``unknown``. It is trained on the driver from sentences made of
the notice templates below and from a bounded sample of the corpus's own
paragraphs as ``unknown``; its probabilities are calibrated (temperature on a
held-out part, then a cut at which held-out unknowns pass with a share of
``false_rate`` at most). A prediction over the cut is confirmed by comparing
the paragraph with the family's templates.

The features are the templates' n-grams with a word that is no stop word. A
paragraph without any such word has no feature, and its probabilities are the
biases': it is unknown without further work.

Defined results
---------------
* A null or empty text has no paragraphs, hence no findings. A text of any length is read whole.
* ``All rights reserved.`` is a notice of the family ``proprietary``.
* Of equally likely families the first one, of equally likely wrapped notices the shortest.
* Repeated rows give repeated findings. A null doc_id is kept.
* Empty tables, a corpus without a licence or a corpus of notices only give what they hold.
* Only the named columns are read.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.base import documents, text_of

#: Families and the wording of their usual notices.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "This software is distributed under the Apache 2.0 license.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GNU GPL version 3.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Content is available under CC BY-SA 4.0.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Available under CC BY-NC-SA 4.0 for noncommercial use.",
    ],
    "CC0": ["This work is dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0", "Released into the public domain under CC0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "proprietary": ["All rights reserved.", "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited.", "Proprietary and confidential. All rights reserved."],
}
STOP = frozenset("a an and any are as at be by for from in is it its of on or that the this to under use with work you your not no may can will was has have we our terms use used file form forms content".split())
UNKNOWN = "unknown"
FAMILIES = (*TEMPLATES, UNKNOWN)
#: The bound on the corpus's paragraphs that training sees.
SAMPLE_PARAGRAPHS = 3000
#: The most lines over which a notice is wrapped.
WRAP = 8
WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def words_in(paragraph: str) -> list[str]:
    return WORD.findall(paragraph.lower())


def grams(words: list[str]) -> list[str]:
    """The n-grams of one to three words that have a word outside the stop list."""
    return [" ".join(g) for n in (1, 2, 3) for g in (words[i : i + n] for i in range(len(words) - n + 1)) if any(w not in STOP for w in g)]


def _examples(rng: random.Random, filler: list[str]) -> list[tuple[str, list[str]]]:
    """Noisy copies of every template: words dropped, swapped for filler, put between other words."""
    out = []
    for family, templates in TEMPLATES.items():
        for t in templates:
            base = words_in(t)
            for k in range(30):
                w = [x for x in base if k == 0 or rng.random() > 0.08]
                if k % 3 == 1:
                    w = [rng.choice(filler) if rng.random() < 0.05 else x for x in w]
                if k % 3 == 2:
                    w = rng.choices(filler, k=rng.randint(1, 15)) + w + rng.choices(filler, k=rng.randint(0, 15))
                out.append((family, w))
            for _ in range(6 if len(base) > 5 else 0):  # two of a notice's words alone are not a notice
                out.append((UNKNOWN, rng.sample(base, 2) + rng.choices(filler, k=rng.randint(5, 40))))
    return out


class Model:
    """Weights by n-gram, with the calibrated temperature and cut."""

    def __init__(self, weights: dict[str, np.ndarray], bias: np.ndarray, temperature: float, cut: float):
        self.weights, self.bias, self.temperature, self.cut = weights, bias, temperature, cut
        self.known = frozenset(g for g in weights if " " not in g)
        self.vocabulary = frozenset(w for g in weights for w in g.split(" "))
        self.templates = {f: [frozenset(grams(words_in(t))) for t in ts] for f, ts in TEMPLATES.items()}

    def features(self, words: list[str]) -> list[str]:
        """The different n-grams that have a weight, by place. Only runs of the templates' words are looked at."""
        vocabulary, weights, found = self.vocabulary, self.weights, {}
        two = one = None  # the words before, where they are the templates'
        for w in words:
            if w not in vocabulary:
                two = one = None
                continue
            for g in (w, one and f"{one} {w}", two and f"{two} {one} {w}"):
                if g in weights:
                    found[g] = None
            two, one = one, w
        return list(found)

    def probabilities(self, words: list[str]) -> np.ndarray:
        return self._softmax(self.features(words))

    def _softmax(self, features: list[str]) -> np.ndarray:
        z = self.bias.copy()
        for g in features:
            z += self.weights[g]
        z = z / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()

    def speaks(self, paragraph: str) -> bool:
        """Whether the paragraph holds a word of the templates that is no stop word."""
        return not self.known.isdisjoint(words_in(paragraph))

    def predict(self, paragraph: str) -> tuple[str, float, float]:
        """(family or unknown, probability, likeness to the family's nearest template)."""
        return self.judged(words_in(paragraph))

    def judged(self, words: list[str]) -> tuple[str, float, float]:
        """``predict`` of a paragraph that is cut into words."""
        if self.known.isdisjoint(words):
            return UNKNOWN, 1.0, 0.0
        features = self.features(words)
        p = self._softmax(features)
        k = int(p.argmax())
        if FAMILIES[k] == UNKNOWN or p[k] < self.cut:
            return UNKNOWN, float(p[-1]), 0.0
        mine = frozenset(features)  # a template's n-grams all have a weight
        return FAMILIES[k], float(p[k]), max(len(t & mine) / len(t) for t in self.templates[FAMILIES[k]])


def fit(paragraphs: list[str], *, rounds: int = 300, rate: float = 0.5, l2: float = 1e-4, false_rate: float = 0.001, seed: int = 7) -> Model:
    """Trains on noisy templates and on ``paragraphs`` as unknown; a fifth is held out for calibration.

    Paragraphs that hold a whole template are left out, as they are no unknowns.
    """
    rng = random.Random(seed)
    known = {f: [frozenset(grams(words_in(t))) for t in ts] for f, ts in TEMPLATES.items()}
    others = [w for p in paragraphs if (w := words_in(p)) and not any(len(t & (mine := set(grams(w)))) > 0.6 * len(t) for ts in known.values() for t in ts)]
    filler = sorted({x for w in others for x in w})[:5000] or ["lorem", "ipsum"]
    data = _examples(rng, filler) + [(UNKNOWN, w) for w in others]
    rng.shuffle(data)
    vocabulary = {g: i for i, g in enumerate(sorted({g for ts in TEMPLATES.values() for t in ts for g in grams(words_in(t))}))}
    # sparse rows: the features of example k are at[starts[k]:starts[k + 1]]; the last column is always on
    sets = [sorted({vocabulary[g] for g in grams(w) if g in vocabulary}) + [len(vocabulary)] for _, w in data]
    at, sizes = np.concatenate(sets), np.array([len(x) for x in sets])
    starts, of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sets)), sizes)
    y = np.array([FAMILIES.index(f) for f, _ in data])
    held = np.arange(len(data)) % 5 == 0
    w = np.zeros((len(vocabulary) + 1, len(FAMILIES)))
    want, learns = np.eye(len(FAMILIES))[y], (~held)[:, None] / (~held).sum()
    for _ in range(rounds):
        z = np.add.reduceat(w[at], starts)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = ((want - p / p.sum(axis=1, keepdims=True)) * learns)[of]
        up = np.stack([np.bincount(at, g[:, k], len(w)) for k in range(len(FAMILIES))], axis=1)
        up[:-1] -= l2 * w[:-1]
        w += rate * 20 * up
    b, w = w[-1], w[:-1]
    z = np.add.reduceat(np.vstack([w, b])[at], starts)[held]

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float(-(s[np.arange(len(s)), y[held]] - np.log(np.exp(s).sum(axis=1))).mean())

    temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss)
    s = np.exp(z / temperature - (z / temperature).max(axis=1, keepdims=True))
    s /= s.sum(axis=1, keepdims=True)
    false = np.sort(s[y[held] == len(FAMILIES) - 1, :-1].max(axis=1))[::-1]
    allowed = int(false_rate * len(false))
    cut = float(max(0.5, false[allowed] if allowed < len(false) else 0.5))
    return Model({g: w[i].astype(float) for g, i in vocabulary.items()}, b.astype(float), temperature, min(cut, 0.9))


def train(docs: DataFrame, *, text: str = "text", sample: int = SAMPLE_PARAGRAPHS, **how) -> Model:
    """A model whose unknowns are about ``sample`` different paragraphs of the corpus, whole, chosen by a hash.

    The paragraphs are counted first; those whose hash is below the share that
    is wanted are collected, which no hot paragraph or number of tasks changes.
    """
    p = docs.select(F.explode(F.split(text_of(text), "\n")).alias("p")).filter(F.length("p") > 0).select(F.xxhash64("p").alias("h"), "p")
    kinds = p.agg(F.approx_count_distinct("h", 0.02)).first()[0]
    below = int(min(1.0, sample / max(kinds, 1)) * (1 << 40))
    chosen = p.filter(F.pmod("h", F.lit(1 << 40)) < below).groupBy("h").agg(F.min("p").alias("p"))
    return fit([r["p"] for r in chosen.orderBy("h").collect()], **how)


def findings(model: Model, text: str, confirm: float, wrap: int = WRAP):
    """(first line, start, end, family, probability, likeness) of every predicted notice of one text."""
    lines = text.split("\n")
    starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])]).tolist()
    cut: dict[int, list[str]] = {}

    def words_of(k: int) -> list[str]:
        if k not in cut:
            cut[k] = words_in(lines[k])
        return cut[k]

    n = 0
    while n < len(lines):
        words, upto = words_of(n), n + 1
        family, p, like = model.judged(words)
        if not (family != UNKNOWN and like >= confirm) and not model.known.isdisjoint(words):
            for m in range(n + 2, min(n + wrap, len(lines)) + 1):
                if not lines[m - 1].strip():
                    break
                words = words + words_of(m - 1)
                wider = model.judged(words)
                if wider[0] != UNKNOWN and wider[2] >= confirm and (wider[2], wider[1]) > (like, p if family != UNKNOWN else 0.0):
                    (family, p, like), upto = wider, m
        if family != UNKNOWN:
            yield n, starts[n], starts[upto] - 1, family, p, like
        for k in range(n, upto):
            del cut[k]
        n = upto


def license_scan(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", confirm: float = 0.5) -> DataFrame:
    """(doc_id, paragraph, start, end, family, probability, likeness, confirmed) of every paragraph predicted to be a notice.

    ``paragraph`` counts the lines from 0 and is the notice's first one; start and end are code points.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        names = ["paragraph", "start", "end", "family", "probability", "likeness", "confirmed"]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.bool_()]
        for batch in batches:
            found, at = [], []
            for k, t in enumerate(batch.column(1)):
                for row in findings(model, t.as_py(), confirm):
                    at.append(k)
                    found.append((*row, row[-1] >= confirm))
            cols = list(zip(*found)) if found else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, x) for c, x in zip(cols, types)]], names=["doc_id", *names])

    return rows.mapInArrow(run, f"doc_id {kind}, paragraph int, start int, end int, family string, probability double, likeness double, confirmed boolean")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """The confirmed notices of all documents."""
    docs = documents(spark, sf_dir)
    return license_scan(docs, train(docs)).filter("confirmed")
