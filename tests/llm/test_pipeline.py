"""The pipeline as a whole against its stages by brute force, and the registration of all queries."""

import zlib

import numpy as np

import corpus_pipeline
from faultline.llm import language_id, quality, simhash
from faultline.llm.queries import llm_oracle_sql, llm_queries
from faultline.llm.shared import table

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = set(llm_queries())
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 14)} | {"pipeline"}
    assert set(llm_oracle_sql()) <= names and len(corpus_pipeline.STAGES) == 5


def test_stages_and_result(spark):
    docs = table(spark, SF, "documents")
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    ranking = quality.learn(docs, table(spark, SF, "labels"))
    rows = [r for r, s in zip(rows, quality.scores(ranking, [t for _, t in rows]), strict=True) if s >= 0.5]
    good = corpus_pipeline.good_quality(spark, docs, SF)
    assert sorted(r["doc_id"] for r in good.collect()) == sorted(i for i, _ in rows) and good.columns == docs.columns
    net = language_id.learn(good)
    rows = [r for r, (lang, _) in zip(rows, language_id.predictions(net, [t for _, t in rows]), strict=True) if lang != "und"]
    best = {}
    for i, t in rows:
        key = "".join(c for c in t if c not in " \t\n\x0b\x0c\r")
        best[key] = min(best.get(key, (0, 1 << 60, "")), (-len(t), i, t))
    rows = sorted((i, t) for _, i, t in best.values())
    fps, parent = np.array([simhash.fingerprint(t) for _, t in rows], np.uint64), list(range(len(rows)))
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4):
            a, b = i, int(j)
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            parent[max(a, b)] = min(a, b)
    kept = {rows[i][0] for i in range(len(rows)) if parent[i] == i}
    result = llm_queries()["pipeline"](spark, SF).collect()
    assert {r["doc_id"] for r in result} == kept
    assert all(r["ids_crc32"] <= zlib.crc32(b"") + (1 << 32) for r in result)


def test_no_documents(spark, tmp_path):
    for name in ("documents", "labels"):
        table(spark, SF, name).where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_stage_rejects_by_its_predictions(docs_of):
    """Half of each window in one language and half in the other is neither; rows with a label that were not trained on set the bound."""
    rng = np.random.default_rng(5)
    words = {"en": "the thing that is of and on with for there another than".split(), "de": "nicht der die und einer zu von den sich auch werden noch".split()}
    rows = [(i, " ".join(rng.choice(words[lang], 40)), lang) for i, lang in enumerate(("en", "de") * 1800)]
    odd = [(9_000 + i, " ".join(rng.choice(words["en"] + words["de"], 40)), None) for i in range(40)] + [(9_500, "12 ?!", None), (9_501, None, None)]
    docs = docs_of([(i, t) for i, t, _ in rows + odd], langs=[lang for *_, lang in rows + odd])
    net = language_id.learn(docs)
    least = language_id.least_score(docs, net)
    assert 0.9 < least < 1
    kept = [r["doc_id"] for r in corpus_pipeline.known_language(docs.sparkSession, docs, SF).collect()]
    scores = language_id.predictions(net, [t or "" for _, t, _ in rows + odd])
    assert sorted(kept) == [i for (i, *_), (lang, score) in zip(rows + odd, scores, strict=True) if lang != "und" and score >= least]
    assert sum(i < 9_000 for i in kept) >= 0.99 * len(rows) and sum(i >= 9_000 for i in kept) <= 20
    assert language_id.least_score(docs.where("doc_id < 400"), net) == 0
