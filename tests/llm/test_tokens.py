"""Token counts, the codec and packing against the libraries themselves and against definitions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from faultline.llm import bpe_codec, packing, token_counts
from faultline.llm.byte_bpe import byte_bpe
from faultline.llm.queries import vocabulary

BYTES, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library_ids(corpus):
    tokenizer = Tokenizer.from_file(BYTES)
    return {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t, _ in corpus}


def test_counts_as_the_library(docs_of, corpus):
    tokenizer = Tokenizer.from_file(WORDS)
    docs = docs_of([(i, t) for i, t, _ in corpus] + [(None, "a b"), (0, corpus[0][1])])
    got = token_counts.token_counts(docs, WORDS, limit=100).collect()
    want = Counter()
    for i, t in [(i, t) for i, t, _ in corpus] + [(None, "a b"), (0, corpus[0][1])]:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 100] += 1
    assert Counter(map(tuple, got)) == want


def test_a_full_cache_changes_nothing(docs_of, corpus, monkeypatch):
    tokenizer = Tokenizer.from_file(WORDS)
    texts = [t or "" for _, t, _ in corpus[:60]]
    counts = Counter(w for t in texts for w in token_counts.pre_tokens(t))
    for t in texts:
        assert sum(token_counts.counts_of(WORDS, token_counts.pre_tokens(t))) == len(tokenizer.encode(t, add_special_tokens=False).ids)
    kept = token_counts.shrunk(counts, 50)
    assert len(kept) <= 50
    top = counts.most_common(5)
    assert all(w in kept for w, n in top if n > sum(counts.values()) / 50)


def test_frequent_pre_tokens_are_those_of_all_texts(docs_of):
    docs = docs_of([(i, "often rare%d often" % i) for i in range(50)])
    assert token_counts.frequent_pre_tokens(docs, entries=1) == ["often"]


def test_no_documents(spark, docs_of):
    none = docs_of([(1, "x")]).where("false")
    assert token_counts.token_counts(none, WORDS).count() == 0
    assert bpe_codec.codec_digests(none, BYTES).count() == 0
    assert packing.best_fit_packing(none, BYTES).count() == 0


def test_codec_as_the_library(docs_of, corpus, library_ids):
    docs = docs_of([(i, t) for i, t, _ in corpus] + [(None, "a b")])
    got = {r["doc_id"]: r for r in bpe_codec.codec_digests(docs, BYTES).collect()}
    tokenizer = Tokenizer.from_file(BYTES)
    assert None in got and len(got) == len(corpus) + 1
    for i, _, _ in corpus:
        ids = library_ids[i]
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), i
        assert got[i]["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest(), i


def test_round_trip(docs_of, corpus, library_ids):
    docs = docs_of([(i, t) for i, t, _ in corpus])
    encoded = bpe_codec.encode(docs, BYTES)
    for r in bpe_codec.decode(encoded, BYTES).collect():
        assert r["ids"] == library_ids[r["doc_id"]]
        assert r["text"] == (dict((i, t) for i, t, _ in corpus)[r["doc_id"]] or "")


def test_chunks_depend_on_content_and_are_reused():
    words = [f"w{k} " for k in range(4000)]
    random.Random(1).shuffle(words)
    passage = "".join(words)
    first, second = "short start. " + passage, "another and much longer start of a text " * 20 + passage
    assert "".join(bpe_codec.chunks(first)) == first
    shared = set(bpe_codec.chunks(first)) & set(bpe_codec.chunks(second))
    assert sum(map(len, shared)) > 0.8 * len(passage)
    assert all(len(c.encode()) <= bpe_codec.LARGEST for c in bpe_codec.chunks("é" * 50_000))
    encoder = bpe_codec.ChunkEncoder(byte_bpe(BYTES))
    for text in (first, second):
        assert encoder.ids(text).tolist() == byte_bpe(BYTES).exact.encode(text, add_special_tokens=False).ids
    assert encoder.reused > 0.3 * (encoder.reused + encoder.encoded)


def test_a_tiny_cache_changes_nothing(corpus, library_ids):
    encoder = bpe_codec.ChunkEncoder(byte_bpe(BYTES), cache_bytes=1)
    for i, text, _ in corpus[::7]:
        assert encoder.ids(text or "").tolist() == library_ids[i]


def test_packing(docs_of, corpus, library_ids):
    docs = docs_of([(i, t) for i, t, _ in corpus]).repartition(5)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in packing.best_fit_packing(docs, BYTES).collect():
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(library_ids)
    for i, rows in by_doc.items():
        ids, at = np.array([*library_ids[i], 2], "<u4"), 0
        for k, r in enumerate(sorted(rows, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == 1024)
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids) and (len(rows) == 1) == (len(ids) <= 1024)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    total = sum(len(x) + 1 for x in library_ids.values())
    assert len(by_sequence) <= 1.03 * total / 1024 + 1


def test_fullest_is_the_fullest():
    rng = random.Random(5)
    for _ in range(200):
        counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        size = rng.randint(1, 90)
        reach = {0}
        for length, n in counts.items():
            reach = {a + k * length for a in reach for k in range(n + 1) if a + k * length <= size}
        found = packing.fullest(counts, size)
        assert sum(k * n for k, n in found.items()) == max(reach)
        assert all(n <= counts[k] for k, n in found.items())


def test_plan_uses_every_piece_once():
    rng = random.Random(6)
    counts = Counter(min(1024, int(rng.lognormvariate(5.5, 1)) + 1) for _ in range(20_000))
    planned, used = packing.plan(counts), Counter()
    for times, found in planned:
        assert times > 0 and sum(k * n for k, n in found.items()) <= 1024
        used.update({k: times * n for k, n in found.items()})
    assert used == counts
    assert sum(t for t, _ in planned) <= 1.002 * sum(k * n for k, n in counts.items()) / 1024 + 1


def test_pieces_of_wrong_length_are_refused(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 2000, 0, 0)], "doc_id long, length long, task int, nth long"))
