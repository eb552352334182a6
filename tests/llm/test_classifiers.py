"""Language, quality and licences: held-out accuracy, and what is defined for odd rows."""

import zlib

import numpy as np
import pytest

from faultline.llm import language_id, license_scan, quality
from faultline.llm.queries import llm_queries
from faultline.llm.shared import table

SF = "/root/testdata/sf0.01"


def remainder(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


@pytest.fixture(scope="module")
def net(spark):
    return language_id.learn(table(spark, SF, "documents"))


@pytest.fixture(scope="module")
def ranking(spark):
    return quality.learn(table(spark, SF, "documents"), table(spark, SF, "labels"))


def test_language_on_held_out_texts(spark):
    truth = {r["doc_id"]: r["lang"] for r in table(spark, SF, "documents").select("doc_id", "lang").collect()}
    got = llm_queries()["op7_language_id"](spark, SF).collect()
    assert len(got) == len(truth)
    assert all(r["held_out"] == (remainder(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) >= 0.98


def test_language_of_odd_texts(docs_of, net):
    english = "the thing that is of and on with for the there another that "
    docs = docs_of([(1, None), (2, ""), (3, "123 !? \n"), (4, english * 5000), (None, english * 5), (6, english), (6, english), (7, "!" * 3000 + english * 3)])
    got = language_id.language_id(docs, net).collect()
    assert {(r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (1, 2, 3)} == {("und", 0.0)}
    assert {r["lang_pred"] for r in got if r["doc_id"] in (4, None, 6)} == {"en"} and len(got) == 8
    kept = language_id.keep_known_language(docs, net)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 4, 6, 6, 7]
    assert language_id.language_id(docs.where("false"), net).count() == 0


def test_language_uses_the_end_of_a_text(net):
    english, german = "the thing that is of and on with for the there ", "nicht der die und einer zu von den sich auch "
    short = language_id.predictions(net, [english * 20])[0]
    assert short[0] == "en"
    assert language_id.predictions(net, [english * 20 + german * 400])[0][0] == "de"


def test_language_without_any_labels(docs_of):
    docs = docs_of([(1, "some words"), (2, None)], langs=[None, None])
    net = language_id.learn(docs)
    assert {r["lang_pred"] for r in language_id.language_id(docs, net).collect()} == {"und"}


def test_samples_of_ids_on_many_rows(spark):
    """50 ids on 20,000 rows teach both languages and labels; no more rows than the bound are gathered."""
    from pyspark.sql import functions as F

    from faultline.llm.shared import one_text_each, smallest_hashes

    ids = spark.range(20_000).select((F.col("id") % 50).alias("doc_id"), F.when(F.col("id") % 50 < 2, "de").otherwise("en").alias("lang"),
                                     F.when(F.col("id") % 50 < 2, "nicht der die und").otherwise("the thing that is").alias("text"), (F.col("id") % 50 < 2).cast("int").alias("quality"))
    chosen = smallest_hashes(ids, "lang", 5)
    assert sorted(r["lang"] for r in chosen.collect()) == ["de"] * 2 + ["en"] * 5
    again = ids.withColumn("text", F.concat("text", (F.rand(1) * 100).cast("string")))
    assert one_text_each(again.drop("lang"), chosen, "lang").count() == 7
    assert language_id.learn(ids).languages == ["de", "en"]
    model = quality.learn(ids, ids.select("doc_id", "quality"), 5)
    assert np.abs(model.weights).max() > 0


def test_network_gradient():
    """By differences of the loss, parameter by parameter."""
    rng = np.random.default_rng(5)
    x, y = rng.integers(1, 30, (6, 40)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    net = language_id.ByteNet(["a", "b", "c"], rng.normal(size=(256, 3)), rng.normal(size=(6, 5)), rng.normal(size=5), rng.normal(size=(5, 3)), rng.normal(size=3))
    net.embed[0] = 0
    found = language_id.gradients(net, x, y)
    for name, g in found.items():
        values = getattr(net, name)
        for at in [tuple(i) for i in rng.integers(0, values.shape, (25, values.ndim))]:
            if name == "embed" and at[0] in (0, *range(30, 256)):
                continue
            kept, losses = values[at], []
            for step in (1e-6, -1e-6):
                values[at] = kept + step
                losses.append(-np.log(net.probabilities(x)[np.arange(6), y]).mean())
            values[at] = kept
            assert abs((losses[0] - losses[1]) / 2e-6 - g[at]) < 1e-5, (name, at)


def test_network_learns():
    """The trained network tells two byte patterns apart wherever they stand."""
    rng = np.random.default_rng(1)
    x = rng.integers(97, 110, (200, language_id.LENGTH)).astype(np.uint8)
    y = np.arange(200) % 2
    for i in range(200):
        at = rng.integers(0, language_id.LENGTH - 3)
        x[i, at:at + 3] = (120, 121, 122) if y[i] else (122, 121, 120)
    net = language_id.train(x, y, ["a", "b"], epochs=40)
    assert (net.probabilities(x).argmax(axis=1) == y).mean() > 0.95


def test_quality_on_held_out_documents(spark):
    truth = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    got = llm_queries()["op10_quality_classifier"](spark, SF).collect()
    assert all(r["held_out"] == (remainder(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) >= 0.97
    good, bad = ([r["score"] for r in held if truth[r["doc_id"]] == q] for q in (1, 0))
    assert np.mean(np.array(good)[:, None] > np.array(bad)[None]) >= 0.99


def test_quality_of_odd_texts(docs_of, ranking):
    docs = docs_of([(1, None), (2, ""), (3, " \n"), (None, "word"), (4, "The of and it is. " * 20_000), (4, "The of and it is. " * 20_000)])
    got = quality.quality(docs, ranking).collect()
    assert len(got) == 6 and len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1
    assert quality.keep_good(docs, ranking).columns == docs.columns
    assert quality.quality(docs.where("false"), ranking).count() == 0


def test_pairwise_learning():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(size=(300, 3)) + [1.5, 0, 0], rng.normal(size=(100, 3))
    model = quality.fit(good, bad)
    assert model.weights[0] > 5 * abs(model.weights[1]) and model.weights[0] > 5 * abs(model.weights[2])
    assert (model.score(good) >= 0.5).mean() > 0.65 and (model.score(bad) < 0.5).mean() > 0.65
    alone = quality.fit(good, np.zeros((0, 3)))
    assert set(alone.score(good)) == {0.5}


def test_licences(spark, docs_of):
    ordinary = [(100 + i, f"Some plain words number {i} stand here. " * 3) for i in range(60)]
    docs = docs_of([(1, "Intro words.\nReleased under the MIT License.\nMore."), (2, "All rights reserved."), (3, "Licensed under CC BY-NC 4.0."), (4, "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0"),
                    (5, "This work is licensed under the GNU General Public License, version 3."), (6, "Released under the Sleepycat License."), (7, None), (8, ""), (None, "All rights reserved."),
                    (9, "The software is free of charge for any person."), (10, "long " * 30_000 + " Released under the MIT License. " + "tail " * 30_000), (1, "Intro words.\nReleased under the MIT License.\nMore."), *ordinary])
    got = license_scan.license_scan(docs).collect()
    found = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["paragraph"], r["family"]) for r in got)
    assert found == [(-1, 0, "Proprietary"), (1, 1, "MIT"), (1, 1, "MIT"), (2, 0, "Proprietary"), (3, 0, "CC-BY-NC"), (4, 0, "Apache-2.0"), (5, 0, "GPL"), (6, 0, "unknown"), (10, 0, "MIT")]
    assert all(r["confirmed"] == (r["family"] != "unknown") and 0 < r["probability"] <= 1 for r in got)
    assert license_scan.license_scan(docs.where("false")).count() == 0


MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining
a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to
the following conditions:"""
APACHE_TEXT = """Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
implied. See the License for the specific language governing
permissions and limitations under the License."""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:

1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer."""


def test_wrapped_licences(spark, docs_of):
    ordinary = [(100 + i, f"Some plain words number {i} stand here. " * 3) for i in range(60)]
    marked = lambda mark, text: "".join(f"{mark} {x}".rstrip() + "\n" for x in text.split("\n"))
    texts = [(1, f"Title\n\n{MIT_TEXT}\n\nThe end"), (2, "/*\n" + marked(" *", APACHE_TEXT) + " */\nint x;"), (3, BSD_TEXT), (4, marked("#", MIT_TEXT)), (5, marked("dnl", BSD_TEXT))]
    got = license_scan.license_scan(docs_of([*texts, *ordinary])).collect()
    assert sorted((r["doc_id"], r["paragraph"], r["family"]) for r in got) == [(1, 2, "MIT"), (2, 1, "Apache-2.0"), (3, 0, "BSD"), (3, 4, "BSD"), (4, 0, "MIT"), (5, 0, "BSD"), (5, 4, "BSD")]


def test_short_notices_that_name_mit(spark, docs_of):
    ordinary = [(100 + i, ("Some plain words number {} stand here. " if i % 2 else "Der Hund geht mit der Katze {} und mit dem Kind. ").format(i) * 3) for i in range(120)]
    docs = docs_of([(1, "Available under MIT"), (2, "License: MIT"), (3, "License: Zlib"), (4, "Wir gehen mit dem Hund in den Wald."), *ordinary])
    got = {r["doc_id"]: r for r in license_scan.license_scan(docs).collect()}
    assert {i: r["family"] for i, r in got.items() if i != 3} == {1: "MIT", 2: "MIT"}
    assert 3 not in got or got[3]["family"] == "unknown"


def grams_found(monkeypatch, docs, model):
    """The n-grams that ``scan`` stores, before they are stored."""
    class Caught(Exception):
        pass

    def catch(df, name):
        raise Caught(df)

    with monkeypatch.context() as m, pytest.raises(Caught) as caught:
        m.setattr(license_scan, "stored", catch)
        license_scan.scan(docs, model)
    return caught.value.args[0]


def rows_generated(plan) -> int:
    """The rows that the generators of an executed plan have made."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return rows_generated(plan.executedPlan())
    if plan.nodeName().endswith("QueryStage"):
        return rows_generated(plan.plan())
    own = plan.metrics().apply("numOutputRows").value() if plan.nodeName() == "Generate" else 0
    return own + sum(rows_generated(plan.children().apply(i)) for i in range(plan.children().size()))


def test_licence_words_alone_make_n_grams(spark, docs_of, monkeypatch):
    model = license_scan.train([f"Some plain words number {i} stand here." for i in range(60)])
    long = " ".join(f"plain{i}" for i in range(3_000))
    found = grams_found(monkeypatch, docs_of([(1, f"{long} license {long}")]), model)
    assert [r["gram"] for r in found.collect()] == ["license"]
    assert 0 < rows_generated(found._jdf.queryExecution().executedPlan()) < 100  # not the 9,000 different runs of the text


def test_n_grams_of_licences_in_plain_python(spark, docs_of, corpus, monkeypatch):
    model = license_scan.train([f"Some plain words number {i} stand here." for i in range(60)])
    vocabulary = set(model.vocabulary)
    texts = [(i, t) for i, t, _ in corpus] + [(20_000, "MIT"), (20_001, "the MIT"), (20_002, "MIT license"), (20_003, "under the\nMIT\nlicense, or\nno\n\nlicense"), (20_004, "mit MIT mit Mit License"), (20_005, "-- GNU\n#\n# general\n# public"),
                                              (20_006, "permitted1 summit admit MITs"), (20_007, "2 2020 20 CC-BY 4.0"), (20_008, "plain\nwords\nno notice\n"), (None, "All rights reserved."), (20_009, MIT_TEXT), (20_010, BSD_TEXT), (20_009, MIT_TEXT)]
    got = sorted(map(str, ((r["doc_id"], r["paragraph"], r["lines"], r["gram"]) for r in grams_found(monkeypatch, docs_of(texts), model).collect())))

    wanted = []
    for i, text in texts:
        lines = (text or "").split("\n")
        cuts = [-1, *(k for k, x in enumerate(lines) if not license_scan.words_of(x)), len(lines)]
        for first, end in zip(cuts, cuts[1:]):
            rows = [(k, 1, lines[k]) for k in range(first + 1, end)] + [(first + 1, end - first - 1, "\n".join(lines[first + 1:end]))] * (end - first > 2)
            wanted += [str((i, at, n, gram)) for at, n, body in rows for gram in license_scan.grams_of(license_scan.words_of(body), vocabulary)]
    assert got == sorted(wanted) and len(got) > 300


def test_licences_of_the_corpus(spark):
    wanted = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "CC-BY-NC": "Licensed under CC BY-NC 4.0.",
              "GPL": "This work is licensed under the GNU General Public License, version 3.", "Proprietary": "All rights reserved."}
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").select("doc_id", "text").collect()}
    result = llm_queries()["op1_license_scan"](spark, SF)
    plan = result._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    got = {(r["doc_id"], r["family"]) for r in result.collect()}
    assert got == {(i, f) for i, t in texts.items() for f, line in wanted.items() if line in t}
