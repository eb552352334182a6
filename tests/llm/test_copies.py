"""Exact and near copies, and components, against brute force."""

import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from faultline.llm import exact_dedup, simhash
from faultline.llm.components import stars
from faultline.llm.queries import llm_oracle_sql


def components_of(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


TEXTS = [None, "", " \t\n", "a b", "ab", "a  b ", "ab", "A b", "x" * 100_000, "x" * 99_999 + " x", "é a", "éa", "z z", "zz"]


def test_exact_as_sql(spark, docs_of):
    rows = [(100 - i, t) for i, t in enumerate(TEXTS)] + [(500 + i, "hot text") for i in range(300)]
    docs = docs_of(rows).repartition(4)
    got = sorted(map(tuple, exact_dedup.exact_duplicates(docs, support=0.01).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))
    con, documents = duckdb.connect(), docs.select("doc_id", "text").toPandas()
    con.register("documents", documents)
    want = con.execute(f"select doc_id, keep_id, group_size, kept, text_sha256 from ({llm_oracle_sql()['op8_exact_dedup']})").fetchall()
    assert got == sorted(want)
    assert sum(r[3] for r in got) == len({r[4] for r in got})


def test_exact_nulls_ties_and_repeats(docs_of):
    docs = docs_of([(None, "same"), (7, "same"), (7, "same"), (None, "alone"), (3, "s a m e")])
    got = exact_dedup.exact_duplicates(docs).collect()
    assert sorted((r["keep_id"] or -1, r["group_size"]) for r in got) == [(-1, 1), (3, 4), (3, 4), (3, 4), (3, 4)]
    kept = exact_dedup.without_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect()) == [(-1, "alone"), (3, "s a m e")]
    repeated = exact_dedup.without_duplicates(docs_of([(7, "same"), (7, "same"), (7, "other")]))
    assert sorted(r["text"] for r in repeated.collect()) == ["other", "same"]


def test_exact_no_documents(docs_of):
    none = docs_of([(1, "x")]).where("false")
    assert exact_dedup.exact_duplicates(none).count() == 0 and exact_dedup.without_duplicates(none).count() == 0


def test_exact_plan_has_no_python(docs_of):
    plan = exact_dedup.exact_duplicates(docs_of([(1, "x"), (2, "x")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def plain_fingerprint(text):
    import xxhash

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in lowered).split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def test_fingerprints(corpus):
    for _, text, _ in corpus[::5]:
        assert simhash.fingerprint(text or "") == plain_fingerprint(text or "")


def test_near_as_brute_force(docs_of, corpus):
    rows = [(i, t) for i, t, _ in corpus] + [(20_000, None), (None, "some words of no one else at all"), (0, corpus[0][1])]
    got = simhash.near_duplicates(docs_of(rows)).collect()
    fps = {(i, t): plain_fingerprint(t or "") for i, t in rows}
    values = sorted(set(fps.values()))
    pairs = [(a, b) for k, a in enumerate(values) for b in values[k + 1:] if bin(a ^ b).count("1") <= 4]
    root = components_of(values, pairs)
    smallest = defaultdict(list)
    for (i, _), fp in fps.items():
        if i is not None:
            smallest[root[fp]].append(i)
    want = sorted((i if i is not None else -1, f"{fps[i, t]:016x}", min(smallest[root[fps[i, t]]], default=-1)) for i, t in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["fingerprint"], r["component_id"] if r["component_id"] is not None else -1) for r in got) == want


@pytest.mark.parametrize("block", [1024, 16])
def test_links_connect_what_pairs_connect(spark, block):
    """Random fingerprints, chains, and a dense ball with long index lists, with the sign bit and without."""
    rng = random.Random(9)
    values = {rng.getrandbits(64) for _ in range(300)}
    for centre in (rng.getrandbits(64) | 1 << 63, rng.getrandbits(63)):
        for _ in range(250):
            values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    x = rng.getrandbits(64)
    for _ in range(40):
        x ^= sum(1 << b for b in rng.sample(range(64), 4))
        values.add(x)
    values = sorted(values)
    array = np.array(values, np.uint64)
    pairs = [(values[i], values[j]) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(array[i + 1:] ^ array[i]) <= 4) + i + 1]
    want = components_of(values, pairs)
    df = spark.createDataFrame([(int(v),) for v in array.view(np.int64)], "fp long").repartition(3)
    found = simhash.links(df, block=block).collect()
    unsigned = lambda v: v % (1 << 64)
    assert all(bin(unsigned(r["a"]) ^ unsigned(r["b"])).count("1") <= 4 for r in found)
    assert components_of(values, [(unsigned(r["a"]), unsigned(r["b"])) for r in found]) == want
    assert len(found) < len(pairs)


def test_one_of_each(docs_of):
    text = " ".join(f"word{i}" for i in range(400))
    rows = [(5, text), (2, text), (9, text + " end"), (4, "entirely different words stand here for once"), (None, "nobody has these five words"), (11, None), (12, "")]
    docs = docs_of(rows)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in kept.collect())
    near = bin(plain_fingerprint(text) ^ plain_fingerprint(text + " end")).count("1") <= 4
    assert ids == ([-1, 2, 4, 11] if near else [-1, 2, 4, 9, 11])
    assert simhash.one_of_each(docs.where("false")).count() == 0
    clash = simhash.one_of_each(docs_of([(7, "first text under this number"), (7, "and quite another one with it"), (7, "first text under this number")]))
    assert sorted(r["text"][:3] for r in clash.collect()) == ["and", "fir"]


def test_stars(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + k) for k in range(1, 80)] + [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(80)]
    links = [(max(p), min(p)) for p in pairs if p[0] != p[1]]
    df = spark.createDataFrame(links + links[:5], "a long, b long")
    want = components_of({n for p in links for n in p}, links)
    assert sorted(map(tuple, stars(df).collect())) == sorted((n, r) for n, r in want.items() if n != r)
    assert stars(df.where("false")).count() == 0


def test_no_table_is_broadcast_by_its_estimated_size(spark, docs_of):
    """The index has 70 rows a fingerprint and is sized like the fingerprints; it came to the driver in a single piece."""
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    fps = spark.createDataFrame([(i << 40,) for i in range(50)], "fp long")
    assert "Broadcast" not in plan(simhash.links(fps))
    docs = docs_of([(i, f"text {i % 7} of some words") for i in range(30)])
    assert "BroadcastHashJoin [fp#" not in plan(simhash.near_duplicates(docs))


def test_exact_join_is_not_broadcast_by_file_size(spark, docs_of):
    docs = docs_of([(i, f"text {i % 7}") for i in range(30)])
    plan = exact_dedup.exact_duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [digest#" in plan
