"""Spelling variants against brute force: all words one edit away, looked up in a dictionary."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from faultline.llm import spelling
from faultline.llm.queries import op13_spelling_variants
from faultline.llm.shared import stored


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def plain_variants(words):
    letters = sorted({c for w in words for c in w})
    out, form = [], {}
    near_of = {}
    for w in words:
        near = {w[:i] + w[i + 1:] for i in range(len(w))} | {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in letters}
        near |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near_of[w] = [x for x in near if x in words and x != w]
        best = min(near_of[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near_of[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def as_rows(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_words_of_the_corpus(docs_of, corpus):
    rows = [(i, t) for i, t, _ in corpus] + [(None, "Nothingness nothingness ×÷×÷×÷× ÀÉÎÕÜÿß ÀÉÎÕÜÿß ALLCAPS allcaps"), (3, "nothingness " * 40), (3, "nothingness " * 40)]
    got = dict(tuple(r) for r in spelling.word_counts(docs_of(rows).repartition(3)).select("word", "n").collect())
    assert got == plain_words(rows) and len(got) > 100


def test_variants_as_brute_force(spark):
    """Few letters, so that runs of equal ones, ties and long chains of forms occur; ranges of words far smaller than their shared beginnings."""
    rng = random.Random(3)
    words = {"".join(rng.choices("aabé", k=rng.randrange(7, 11))): rng.choice([2, 2, 3, 20, 30, 300, 4000, 50_000]) for _ in range(3000)}
    words |= {"z" * 3000: 9, "z" * 2999 + "y": 90, "z" * 2999: 900, "abstand": 2, "abstandx": 20, "abstandxy": 200, "abstandxyz": 2000, "abstandxyzz": 20_000}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(7)
    assert as_rows(spelling.variants(df)) == plain_variants(words)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    try:
        assert as_rows(spelling.variants(df)) == plain_variants(words)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_node_numbers(spark):
    """Equal beginnings have equal numbers, others different ones, whatever the ranges."""
    rng = random.Random(4)
    words = sorted({"".join(rng.choices("ab", k=rng.randrange(1, 9))) for _ in range(300)})
    df = stored(spark.createDataFrame([(w, k) for k, w in enumerate(words)], "word string, number long"), "words")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        for text, turned in ((F.col("word"), False), (F.reverse("word"), True)):
            seen = {}
            for r in spelling.trie_nodes(df, text).collect():
                word = words[r["number"]][::-1] if turned else words[r["number"]]
                assert len(r["nodes"]) == len(word) + 1
                for i, node in enumerate(r["nodes"]):
                    assert seen.setdefault(word[:i], node) == node
            assert len(set(seen.values())) == len(seen)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_no_words(docs_of):
    assert spelling.spelling_variants(docs_of([(1, None), (None, ""), (2, "short words only")])).count() == 0
    assert spelling.spelling_variants(docs_of([(1, "x")]).where("false")).count() == 0


def test_query_on_the_table(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    assert as_rows(op13_spelling_variants(spark, sf)) == plain_variants(plain_words(rows))
