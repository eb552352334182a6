"""Similar documents against all pairs."""

import random
import re

import numpy as np
import pytest

from faultline.llm import jaccard
from faultline.llm.word_hash import texts_words
from tests.llm.test_copies import components_of


def plain_set(text, size=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    return frozenset(" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def plain(rows, size=3, percent=90):
    """(id, n, component) of (id, text) rows, by all pairs of distinct sets."""
    sets = [plain_set(t, size) for _, t in rows]
    distinct = sorted({s for s in sets if s}, key=sorted)
    pairs = [(a, b) for a in range(len(distinct)) for b in range(a) if 100 * len(distinct[a] & distinct[b]) >= percent * len(distinct[a] | distinct[b])]
    root = components_of(range(len(distinct)), pairs)
    group = {s: root[k] for k, s in enumerate(distinct)}
    smallest = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            smallest[group[s]] = min(i, smallest.get(group[s], i))
    return sorted(((i, len(s), smallest.get(group[s]) if s else i) for (i, _), s in zip(rows, sets)), key=repr)


def as_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice("abcdefghij") * 3
    return words


def family(rng, n, length, edits):
    """Copies of one text with a few edits each, copies of copies, and borderline ones."""
    out = [[f"w{rng.randrange(400)}" for _ in range(length)]]
    while len(out) < n:
        out.append(edited(rng, rng.choice(out[:3]), rng.randrange(edits + 1)))
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("block, most_sets", [(1024, 512), (8, 10)])
def test_as_all_pairs(docs_of, corpus, block, most_sets):
    """With small blocks, long lists and large clusters take the ways that the tables' largest groups take."""
    rng = random.Random(8)
    texts = family(rng, 60, 90, 4) + family(rng, 40, 200, 9) + family(rng, 25, 12, 1) + [t for _, t, _ in corpus[::3]]
    texts += ["one two", "One  two", "one", "ONE", None, "", " \n ", "a b c d e f g h i j k", "a b c d e f g h i j k l"] + [texts[0]] * 30
    passage = " ".join(f"shared{k}" for k in range(60))
    texts += [" ".join(f"own{i}x{k}" for k in range(rng.randrange(40))) + " " + passage for i in range(40)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[0]), (None, "nobody else says this"), (5, texts[0]), (5, texts[0]), (None, None)]
    got = as_rows(jaccard.similar_documents(docs_of(rows).repartition(5), block=block, most_sets=most_sets))
    assert got == plain(rows)
    assert len({r[2] for r in got}) < len(got) - 90


def test_every_pair_of_similar_sets_meets():
    """Prefixes, the length, positional and suffix filters lose no similar pair at the first gram that two prefixes share."""
    rng = np.random.default_rng(2)
    for percent in (90, 70):
        for _ in range(400):
            n = int(rng.integers(1, 120))
            a = rng.choice(1 << 62, n, replace=False).astype(np.uint64) << np.uint64(2)
            drop, add = rng.integers(0, 1 + n // 6, 2)
            b = np.concatenate([a[int(drop):], rng.choice(1 << 62, int(add)).astype(np.uint64)])
            if len(b) == 0 or 100 * (n - drop) < percent * (n + add) or (drop == 0 and add == 0):
                continue
            rows, prefixes = [], []
            for key, s in ((1, a), (2, b)):
                ordered = np.sort(s)
                prefixes.append(ordered[:jaccard.prefix_length(len(s), percent)])
                rows.append((key, len(s), *(np.bincount((s >> np.uint64(60)).astype(int), minlength=16) & 255).astype(np.uint8).view(np.int64)))
            assert jaccard.linkable(min(len(a), len(b)), percent)
            common = np.intersect1d(*prefixes)
            assert len(common)
            at = [int(np.flatnonzero(p == common[0])[0]) for p in prefixes]
            table = np.array([[k, n, place, s0, s1] for (k, n, s0, s1), place in zip(rows, at)], np.int64)
            assert jaccard._filtered(table, 0, np.array([1]), percent)[0]


def test_grams(corpus):
    for _, text, _ in corpus[::4]:
        assert len(jaccard.grams(text or "")) == len(plain_set(text))
    assert set(jaccard.grams("a b c d").tolist()) > set(jaccard.grams("b  C d").tolist()) and jaccard.grams("a b").tolist() != jaccard.grams("b a").tolist()


def test_long_words_and_texts():
    """Texts are hashed piece by piece, as if at once."""
    rng = random.Random(1)
    long = " \n".join("".join(rng.choices("abcdé", k=rng.randrange(1, 9))) for _ in range(40_000))
    texts = [long, "x" * 200_000, "a " + "y" * 150_000 + " b\tc", "", " ", "end " * 3]
    for text, words in zip(texts, texts_words(texts)):
        one_by_one = [next(texts_words([w]))[0] for w in text.split()[:300]]
        assert len(words) == len(text.split()) and words[:300].tolist() == one_by_one


def test_postings_by_brute_force(docs_of):
    """Of each set those grams of its prefix that others hold too, rare ones first, in blocks of any size."""
    from collections import Counter

    rng = random.Random(9)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(60)], k=rng.randrange(0, 90))) for _ in range(120)] + ["one two three four five six seven eight nine ten eleven twelve"] * 2
    texts += [" ".join(f"own{i}x{k}" for k in range(40)) for i in range(20)]
    sets = {jaccard.set_key(g): g for g in map(jaccard.grams, texts) if len(g)}
    held = Counter(h for g in sets.values() for h in g.view("int64").tolist())
    for rows in (1024, 7):
        got = jaccard.rare_first_postings(docs_of(list(enumerate(texts))).repartition(3), 10_000, rows=rows).distinct().collect()
        found = {}
        for r in got:
            found.setdefault(r["key"], []).append((r["place"], r["gram"]))
            assert r["n"] == len(sets[r["key"]]) and r["place"] < jaccard.prefix_length(r["n"])
        for key, g in sets.items():
            own = sorted(found.get(key, []))
            alone = sum(held[h] == 1 for h in g.view("int64").tolist())
            if jaccard.linkable(len(g)):  # all grams of its own come first; equal sets in two blocks count as two
                assert len(own) >= max(0, jaccard.prefix_length(len(g)) - alone)
                assert all(held[h] > 1 or texts.count(next(t for t in texts if jaccard.set_key(jaccard.grams(t)) == key)) > 1 for _, h in own)
        order = {}
        for key, own in found.items():  # one order for all
            for (_, a), (_, b) in zip(sorted(own), sorted(own)[1:]):
                assert not order.get((b, a))
                order[a, b] = True


def test_no_documents(docs_of):
    none = docs_of([(1, "x")]).where("false")
    assert jaccard.similar_documents(none).count() == 0
    assert as_rows(jaccard.similar_documents(docs_of([(1, None), (2, "")]))) == [(1, 0, 1), (2, 0, 2)]


def test_query_as_sql(spark):
    import duckdb

    from faultline.llm.queries import llm_oracle_sql, op12_ngram_jaccard_join

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(llm_oracle_sql()["op12_ngram_jaccard_join"]).fetchall()
    assert as_rows(op12_ngram_jaccard_join(spark, sf)) == sorted(want, key=repr)
