"""Licence notices in texts: a paragraph classifier, an unknown class, and a comparison with templates.

DataFrame operations only on the main path. Paragraphs are the lines of a text and, for notices that are wrapped, the blocks of
lines between empty ones (without a letter or digit, as are the bare marks of a comment). A paragraph is described by the word n-grams of the templates' vocabulary
that it holds; a logistic regression over the licence families, ``unknown`` (a licence, but none of these) and ``none`` gives
probabilities, which a temperature fitted on held-out variants makes honest. A family has to reach the calibrated probability,
else the paragraph is ``unknown``; and the prediction is confirmed if the paragraph holds most n-grams of one of the family's
templates.

The model is small (the templates, their variants, a bounded sample of ordinary paragraphs) and is trained on the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.llm.shared import stored, texts_of

NONE, UNKNOWN = "none", "unknown"
#: Opening or defining sentences of well-known licences, and usual one-line notices: fixed values.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT", "License: MIT", "Available under MIT.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License version 2 or later.", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later",
             "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only",
             "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "BSD": ["Licensed under the BSD 3-Clause License.", "Released under the 2-clause BSD license.", "Use of this source code is governed by a BSD-style license.", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "ISC": ["Licensed under the ISC License.", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": ["SPDX-License-Identifier: Unlicense", "This is free and unencumbered software released into the public domain.", "Released into the public domain under the Unlicense."],
    "CC0": ["Licensed under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-ND": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "Proprietary": ["All rights reserved.", "Copyright 2020 Example Corp. All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."],
}
#: Licences of no family above; the first half trains the unknown class, the second calibrates it. Fixed values.
OTHERS = ["Licensed under the Zlib License.", "Licensed under the Eclipse Public License, version 2.0.", "Released under the Artistic License.", "Licensed under the Microsoft Public License.",
          "This font is licensed under the SIL Open Font License, Version 1.1.", "Released under the WTFPL license.", "Licensed under the European Union Public Licence, version 1.2.", "You may use this work under the terms of the Academic Free License.",
          "Licensed under the Boost Software License, version 1.0.", "Released under the Common Development and Distribution License.", "Licensed under the Universal Permissive License.", "Licensed under the Open Database License.",
          "This data is licensed under the terms of the Open Government Licence v3.0.", "Released under the PostgreSQL License.", "Licensed under the Sleepycat License.", "Licensed under the terms of the Python Software Foundation License, version 2."]
#: Words that alone say nothing about a licence; an n-gram has to hold another one. Names and numbers that tell families apart
#: are none of them, even where they are words of a language (German "mit"): there the classifier decides. Fixed values.
COMMON = frozenset("""under only example http www org a above agreed all an and any are as at be by can charge conditions either following for form forms free from files file had has have if in including into is it law
    kind later limitation list may medium met must not obtain obtaining of on option or other out people person possible prohibited project provided purpose related
    required rights sell source strictly subject terms that the this to to use used using v version via was whose with without work works writing you your""".split())
#: Ordinary paragraphs that are sampled as none; characters a sampled one may have.
SAMPLE, SAMPLE_CHARS = 600, 2000
#: Share of a template's n-grams that confirms it; wanted precision of what is called a family.
CONFIRM, PRECISION = 0.8, 0.98
SPLIT = "[^\\p{L}\\p{N}]+"
#: Words that mark a comment at the start of a line; marks without letters are no words anyway.
COMMENT = "(?im)^[^\\p{L}\\p{N}\n]*(?:dnl|rem)(?=\\s|$)"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def telling(word: str) -> bool:
    return word not in COMMON


def grams_of(words: list[str], vocabulary=None) -> set[str]:
    """Word n-grams of one to three words that hold a telling word, of ``vocabulary`` only if one is given."""
    found = {" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1) if any(map(telling, words[i:i + n]))}
    return found if vocabulary is None else found & vocabulary


@dataclass
class LicenseModel:
    classes: list[str]
    vocabulary: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = (x @ self.weights + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _variants(text: str, rng, ordinary: list[str], n: int, needed: set[str]) -> list[list[str]]:
    """The words as they are, and n - 1 variants: a few words lost, but none of ``needed``; ordinary words around them."""
    words, out = words_of(text), []
    for i in range(n):
        kept = [w for w in words if i == 0 or w in needed or rng.random() > 0.12]
        around = [words_of(ordinary[rng.integers(len(ordinary))])[:8] if ordinary and i > 1 and rng.random() < 0.6 else [] for _ in range(2)]
        out.append([*around[0], *kept, *around[1]])
    return out


def train(ordinary: list[str], variants: int = 8, steps: int = 150, seed: int = 3) -> LicenseModel:
    """Multinomial logistic regression by Adam with a ridge; temperature and least probability from held-out variants.

    ``ordinary``: paragraphs that are no licences as far as known; those that hold a template's three-word run are left out.
    """
    rng, vocabulary = np.random.default_rng(seed), set()
    for text in [*(t for texts in TEMPLATES.values() for t in texts), *OTHERS[:len(OTHERS) // 2]]:
        vocabulary |= grams_of(words_of(text))
    of_family = {f: {w for t in texts for w in words_of(t)} for f, texts in TEMPLATES.items()}
    shared = {w for w in set().union(*of_family.values()) if sum(w in words for words in of_family.values()) > 2}
    needed = {f: words - shared for f, words in of_family.items()}  # what tells a family from most others
    threes = {g for g in vocabulary if g.count(" ") == 2}
    ordinary = [t for t in ordinary if not grams_of(words_of(t)) & threes]
    names = sorted(vocabulary)
    at = {g: i for i, g in enumerate(names)}
    classes = [*TEMPLATES, UNKNOWN, NONE]

    def rows(examples: list[tuple[list[str], str]]):
        x = np.zeros((len(examples), len(names)))
        for i, (words, _) in enumerate(examples):
            x[i, [at[g] for g in grams_of(words, vocabulary)]] = 1
        return x, np.array([classes.index(c) for _, c in examples])

    def examples(n: int, others: list[str], plain: list[str]):
        found = [(v, f) for f, texts in TEMPLATES.items() for t in texts for v in _variants(t, rng, ordinary, n, needed[f])]
        found += [(v, UNKNOWN) for t in others for v in _variants(t, rng, ordinary, 2 * n, set())]
        return rows([*found, *((words_of(t), NONE) for t in plain), *[([], NONE)] * (50 + len(found) // 20)])

    half = len(ordinary) // 2
    x, y = examples(variants, OTHERS[:len(OTHERS) // 2], ordinary[:half])
    x2, y2 = examples(4, OTHERS[len(OTHERS) // 2:], ordinary[half:])
    w, b = np.zeros((len(names), len(classes))), np.zeros(len(classes))
    m, v = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)]
    for step in range(1, steps + 1):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        for k, (value, slope) in enumerate(((w, x.T @ p / len(y) + 1e-4 * w), (b, p.mean(axis=0)))):
            m[k] = 0.9 * m[k] + 0.1 * slope
            v[k] = 0.999 * v[k] + 0.001 * slope ** 2
            value -= 0.05 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    model = LicenseModel(classes, names, w, b, 1.0, 0.5)
    known = y2 < len(TEMPLATES)

    def loss(t: float) -> float:
        model.temperature = t
        return float(-np.log(model.probabilities(x2)[known | (y2 == classes.index(NONE)), y2[known | (y2 == classes.index(NONE))]] + 1e-12).mean())

    model.temperature = min(np.geomspace(0.5, 5, 25), key=loss)
    p = model.probabilities(x2)
    best, top = p[:, :len(TEMPLATES)].argmax(axis=1), p[:, :len(TEMPLATES)].max(axis=1)
    for least in np.linspace(0.3, 0.95, 27):
        called = top >= least
        if called.any() and (best[called] == y2[called]).mean() >= PRECISION:
            break
    model.least = float(least)
    return model


def step(df: DataFrame, *kept: str, **columns) -> DataFrame:
    """The kept columns and more, each computed once: through a generator, which the optimizer does not look through."""
    return df.select(*(kept or "*"), F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def paragraphs(docs: DataFrame, where: str = ".") -> DataFrame:
    """doc_id, doc (a number of the row), paragraph (of the first line, from 0), lines, block and body of the lines with a letter or
    digit and of the blocks of two and more of them; block: the first line of the block. Only the texts and lines that match
    ``where``, a pattern without line ends, and the blocks of which a line does.

    The time for a text grows with its length, whatever its lines are.
    """
    texts = texts_of(docs).where(F.col("text").rlike(where)).withColumn("doc", F.monotonically_increasing_id())
    lined = step(texts, "doc_id", "doc", lines=F.split(F.regexp_replace("text", COMMENT, ""), "\n"))
    empty = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: ~F.element_at("lines", i).rlike("[\\p{L}\\p{N}]"))
    cut = step(lined, "doc_id", "doc", "lines", cuts=F.concat(F.array(F.lit(0)), empty, F.array(F.size("lines") + 1)), hits=F.transform("lines", lambda x: x.rlike(where)))

    def block(k):
        first, n = F.element_at("cuts", k), F.element_at("cuts", k + 1) - F.element_at("cuts", k) - 1
        row = lambda at, size, body: F.struct(at.alias("paragraph"), size.alias("lines"), first.alias("block"), body.alias("body"))
        own = F.slice("lines", first + 1, n)
        return F.concat(F.filter(F.transform(own, lambda x, i: row(first + i, F.lit(1), x)), lambda x, i: F.element_at("hits", first + i + 1)),
                        F.when((n > 1) & F.array_contains(F.slice("hits", first + 1, n), True), F.array(row(first, n, F.array_join(own, "\n")))).otherwise(F.array().cast("array<struct<paragraph:int,lines:int,block:int,body:string>>")))

    return cut.select("doc_id", "doc", F.inline(F.flatten(F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), block))))


def learn(docs: DataFrame, sample: int = SAMPLE) -> LicenseModel:
    """A model from the templates and a bounded sample of ordinary paragraphs: the first lines of the documents with the
    smallest hashes of their ids. Only the none class learns from it."""
    ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    lines = (texts_of(docs).join(F.broadcast(ids.distinct()), "doc_id")
             .select(F.substring(F.split("text", "\n")[0], 1, SAMPLE_CHARS).alias("line")).where("line != ''").limit(2 * sample))
    return train(sorted(r["line"] for r in lines.collect()))


def _tables(spark: SparkSession, model: LicenseModel) -> tuple[DataFrame, DataFrame]:
    """(gram, weights, templates that hold it) and (template, family, its number of grams): a few thousand small rows."""
    texts = [(f, t) for f, ts in TEMPLATES.items() for t in ts]
    held = [grams_of(words_of(t)) for _, t in texts]
    grams = [(g, [float(x) for x in model.weights[i]], [k for k, h in enumerate(held) if g in h]) for i, g in enumerate(model.vocabulary)]
    return (spark.createDataFrame(grams, "gram string, weights array<double>, templates array<int>"),
            spark.createDataFrame([(k, f, t, len(h)) for k, ((f, t), h) in enumerate(zip(texts, held, strict=True))], "template int, template_family string, template_text string, size int"))


def words_in(text: str) -> Column:
    """The words of a column, as ``words_of`` has them."""
    return F.filter(F.split(F.lower(text), SPLIT), lambda w: w != "")


def runs_at(found: list[str]) -> Column:
    """Of the column ``words`` the runs of one, two and three words that hold a word of ``found``, shorter ones first, else in their order."""
    places = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(found), i + 1)))

    def runs(n: int) -> Column:
        around = lambda i: F.sequence(F.greatest(i - (n - 1), F.lit(1)), F.least(i, F.size("words") - (n - 1)))
        starts = F.when(F.size("words") >= n, F.array_distinct(F.flatten(F.transform(places, around)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat_ws(" ", *(F.element_at("words", i + k) for k in range(n))))

    return F.concat(*map(runs, (1, 2, 3)))


def scan(docs: DataFrame, model: LicenseModel) -> DataFrame:
    """doc_id, paragraph, family, probability, predicted, template, containment, confirmed: the paragraphs that are licences.

    paragraph: the number of its line, of a block its first line. A block stands for its lines if a template confirms a family
    that none of its lines confirms (its unconfirmed lines are parts of it), or if it is a licence and none of its lines is.

    predicted: the most probable family, or unknown; family: the same if a template confirms it, else unknown. A null or
    empty text has no licence. Null ids and repeated rows are rows like others: a repeated row gives its paragraphs again.
    An empty table gives no rows. Paragraphs of any length are read whole; ties go to the first family or template in order.

    A paragraph with no n-gram of the vocabulary has the probabilities of the intercept, which are those of none; so only
    paragraphs with a telling word of the vocabulary are looked at further.
    """
    spark = docs.sparkSession
    grams, templates = _tables(spark, model)
    gate_words = sorted({w for g in model.vocabulary for w in g.split() if telling(w)})
    # by first letters: a word of the text meets few alternatives
    starts = "|".join(f"{first}(?:{'|'.join(w[1:] for w in same)})" for first, same in groupby(gate_words, lambda w: w[0]))
    gate = f"(?i)(?<![\\p{{L}}\\p{{N}}])(?:{starts})(?![\\p{{L}}\\p{{N}}])"
    bodies = paragraphs(docs, gate).withColumn("row", F.monotonically_increasing_id())
    place = ("doc_id", "doc", "paragraph", "lines", "block", "row")
    found = stored(step(bodies, *place, words=words_in("body")).select(*place, F.explode(F.array_distinct(runs_at(gate_words))).alias("gram"))
                   .join(F.broadcast(grams), "gram"), "licence-grams")
    k = len(model.classes)
    sums = found.groupBy(*place).agg(*(F.sum(F.col("weights")[i]).alias(f"z{i}") for i in range(k)))
    z = F.array(*((F.col(f"z{i}") + F.lit(float(model.bias[i]))) / F.lit(float(model.temperature)) for i in range(k)))
    family = F.array(*map(F.lit, model.classes))

    scored = step(sums.select(*place, z.alias("z")), most=F.array_max("z"))
    scored = step(scored, powers=F.transform("z", lambda x: F.exp(x - F.col("most"))))
    known = F.slice("powers", 1, k - 2)
    scored = step(scored, total=F.aggregate("powers", F.lit(0.0), lambda a, y: a + y), best=F.array_max(known), at=F.array_position(known, F.array_max(known)).cast("int"))
    scored = (scored.withColumn("licence", F.lit(1.0) - F.element_at("powers", -1) / F.col("total")).where("licence > 0.5")
              .select(*place, (F.col("best") / F.col("total")).alias("top"), F.element_at(family, F.col("at")).alias("likely"), "licence"))
    sure = F.col("top") >= model.least
    scored = scored.select(*place, F.when(sure, F.col("likely")).otherwise(UNKNOWN).alias("predicted"), F.when(sure, F.col("top")).otherwise(F.col("licence")).alias("probability"))
    shares = (found.select("row", F.explode("templates").alias("template")).groupBy("row", "template").agg(F.count("*").alias("n"))
              .join(F.broadcast(templates), "template").select("row", "template_family", "template_text", (F.col("n") / F.col("size")).alias("containment"), "template"))
    closest = shares.groupBy("row", "template_family").agg(F.max(F.struct("containment", (-F.col("template")).alias("order"), "template_text")).alias("best"))
    joined = scored.join(closest, (scored["row"] == closest["row"]) & (scored["predicted"] == closest["template_family"]), "left").drop(closest["row"])
    containment = F.coalesce(F.col("best.containment"), F.lit(0.0))
    confirmed = containment >= CONFIRM
    block, line = F.col("lines") > 1, F.col("lines") == 1
    here = Window.partitionBy("doc", "block")
    judged = (joined.withColumn("confirmed", confirmed).withColumn("told", F.collect_set(F.when(line & F.col("confirmed"), F.col("predicted"))).over(here))
              .withColumn("stands", block & F.col("confirmed") & ~F.array_contains("told", F.col("predicted")))
              .withColumn("block_stands", F.max("stands").over(here)).withColumn("has_lines", F.max(line).over(here)))
    kept = judged.where(F.when(block, F.col("stands") | ~F.col("confirmed") & ~F.col("has_lines")).otherwise(F.col("confirmed") | ~F.col("block_stands")))
    return kept.select("doc_id", "paragraph", F.when(F.col("confirmed"), F.col("predicted")).otherwise(UNKNOWN).alias("family"), F.round("probability", 6).alias("probability"),
                       "predicted", F.col("best.template_text").alias("template"), F.round(containment, 6).alias("containment"), "confirmed")


def license_scan(docs: DataFrame) -> DataFrame:
    """``scan`` by a model that is learnt from the templates and from ``docs``."""
    return scan(docs, learn(docs))
