"""Token counts by a two-tier lookup on the map side.

A text is cut at white space into pre-tokens; the library never joins characters over white space, so a text has as many
tokens as its pre-tokens together. First tier: the pre-tokens that are frequent over the whole corpus with their numbers
of tokens, a table of bounded size that is broadcast. Second tier: a cache in each worker, filled by encoding the misses
of some hundred documents in one call. No text's pre-tokens are shuffled for counting; what is, to find the frequent ones, is a
bounded summary of each task (SUMMARY entries).
"""

from __future__ import annotations

import functools
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import slices, texts_of

#: Entries and characters an entry may have: at most some 4 MB are broadcast.
FREQUENT, LONGEST = 65_536, 64
#: Entries of a task's summary, and of a worker's cache.
SUMMARY, CACHED = 8_192, 300_000
#: White space to str.split() or to the tokenizer beyond space and \t to \r. Texts with any are split at the latter alone.
ODD_SPACE = re.compile("[" + "".join(map(chr, [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "]")
PLAIN = re.compile("[^ \t-\r]+")


def pre_tokens(text: str) -> list[str]:
    return PLAIN.findall(text) if ODD_SPACE.search(text) else text.split()


def shrunk(counts: Counter, keep: int) -> Counter:
    """A mergeable frequent-items summary: the count just beyond the ``keep`` largest goes off every count."""
    if len(counts) <= keep:
        return counts
    values = np.fromiter(counts.values(), np.int64, len(counts))
    less = int(np.partition(values, len(values) - keep - 1)[len(values) - keep - 1])
    return Counter({w: n - less for w, n in counts.items() if n > less})


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in slices(batches):
        for text in batch.column("text").to_pylist():
            counts.update(pre_tokens(text))
        if len(counts) > 8 * SUMMARY:
            counts = shrunk(counts, 4 * SUMMARY)
    kept = {w: n for w, n in shrunk(counts, SUMMARY).items() if len(w) <= LONGEST}
    yield pa.RecordBatch.from_pydict({"token": pa.array(kept.keys(), pa.string()), "n": pa.array(kept.values(), pa.int64())})


def frequent_pre_tokens(docs: DataFrame, entries: int = FREQUENT) -> list[str]:
    """The most frequent pre-tokens over all texts, by summaries of bounded size; only speed depends on them."""
    found = (texts_of(docs).select("text").mapInArrow(_summaries, "token string, n long")
             .groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(entries))
    return [r["token"] for r in found.select("token").collect()]


@functools.cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def counts_of(path: str, texts: list[str]) -> list[int]:
    return _tokenizer(path)(texts)


#: Of this worker process: the broadcast it belongs to, and the number of tokens of each pre-token known.
_KNOWN: dict = {"of": None, "tokens": {}}


def _known(broadcast, path: str) -> dict[str, int]:
    if _KNOWN["of"] != (broadcast.value["id"], path) or len(_KNOWN["tokens"]) > FREQUENT + CACHED:
        words, lengths = broadcast.value["words"].split(" "), np.frombuffer(broadcast.value["lengths"], "<u2").tolist()
        _KNOWN.update(of=(broadcast.value["id"], path), tokens=dict(zip(words, lengths, strict=True)))
    return _KNOWN["tokens"]


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``.

    ``path``: a vocabulary that never joins characters over white space (word_bpe_49k.json). Special strings inside a
    text count as the library counts them by default. A null text is empty: 0 bytes, 0 tokens. Null ids and repeated rows
    are rows like others; an empty table gives no rows. Texts are never cut, however long.
    """
    spark = docs.sparkSession
    words = frequent_pre_tokens(docs)
    lengths = counts_of(path, words)
    small = [(w, n) for w, n in zip(words, lengths, strict=True) if n < 2 ** 16]
    table = spark.sparkContext.broadcast({"id": uuid.uuid4().hex, "words": " ".join(w for w, _ in small) if small else "",
                                          "lengths": np.array([n for _, n in small] or [0], "<u2").tobytes()})

    def count(batches):
        for batch in slices(batches):
            known = _known(table, path)
            split = [pre_tokens(t) for t in batch.column("text").to_pylist()]
            missing: set[str] = set()
            for tokens in split:
                missing.update(filterfalse(known.__contains__, tokens))
            missing = list(missing)
            long = {}
            for word, n in zip(missing, counts_of(path, missing), strict=True):
                (known if len(word) <= LONGEST else long)[word] = n
            n_tokens = [sum(map(known.__getitem__, t)) if not long else sum(long[w] if w in long else known[w] for w in t) for t in split]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.cast(pc.binary_length(batch.column("text")), pa.int64()),
                 pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return texts_of(docs).mapInArrow(count, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
