"""Byte-level BPE encoding with reuse of content-defined chunks, and decoding.

A rolling hash over the last 32 bytes decides where a text is cut, so passages that documents share fall into equal chunks
wherever they stand. A worker encodes a chunk once and keeps its ids in a cache of bounded size. Where two chunks meet,
the ids may differ from those of the whole text; they agree from the first place on at which no pre-token can span: a solid
character followed by a space or a line feed. So a join is re-encoded from the last such place before it to the first one
behind it, over further chunks if need be, until both sides must agree; a text without any such place becomes one join.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from faultline.llm.byte_bpe import ByteBpe, byte_bpe
from faultline.llm.shared import slices, texts_of

#: Bytes: one cut in so many on average; no chunk is shorter but the last, none longer.
AVERAGE, SHORTEST, LARGEST = 1024, 256, 8192
#: Bytes of texts and ids that each of a worker's two cache generations may hold.
CACHE_BYTES = 48 << 20
GEAR = np.random.default_rng(20240501).integers(0, 2 ** 32, 256, dtype=np.uint32)
SOLID = re.compile(r"[\w!-~](?=[ \n])")


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """At each byte, a hash of the 32 bytes up to it: sum of gear[byte] << age, by doubling windows."""
    h = GEAR[data]
    for width in (1, 2, 4, 8, 16):
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
    return h


def chunks(text: str) -> list[str]:
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) <= SHORTEST:
        return [text] if text else []
    data = np.frombuffer(raw, np.uint8)
    starts = (data & 0xC0) != 0x80
    hit = (rolling_hash(data) >> np.uint32(8)) % np.uint32(AVERAGE) == 0
    hit[:-1] &= starts[1:]
    hit[-1] = False
    cuts, last = [], 0
    for cut in (np.flatnonzero(hit) + 1).tolist() + [len(raw)]:
        while cut - last > LARGEST:
            at = last + LARGEST
            while not starts[at]:
                at -= 1
            cuts.append(at)
            last = at
        if cut - last >= SHORTEST or cut == len(raw):
            cuts.append(cut)
            last = cut
    return [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip([0, *cuts], cuts)]


def last_safe(text: str) -> int:
    """The last place in ``text`` at which no pre-token can span, or -1."""
    at = len(text)
    while (at := max(text.rfind(" ", 1, at), text.rfind("\n", 1, at))) > 0:
        if SOLID.match(text, at - 1):
            return at
    return -1


class ChunkEncoder:
    """Encodes texts chunk by chunk. ``encoded`` and ``reused`` count chunks."""

    def __init__(self, bpe: ByteBpe, cache_bytes: int = CACHE_BYTES):
        self.bpe, self.cache_bytes = bpe, cache_bytes
        self.young: dict = {}
        self.old: dict = {}
        self.size = self.encoded = self.reused = 0

    def _chunk(self, text: str):
        """(place of the first and last safe position in characters, ids between them), or None if there is no safe one."""
        found = self.young.get(text) or self.old.get(text)
        if found is not None:
            self.reused += 1
            if text in self.young:
                return found
        else:
            self.encoded += 1
            first = SOLID.search(text)
            if first is None:
                return None
            a, z = first.end(), last_safe(text)
            ids = self.bpe.ids(text)
            ends = np.cumsum(self.bpe.lengths[ids])
            i, k = np.searchsorted(ends, [len(text[:a].encode()), len(text[:z].encode())]) + 1
            found = (a, z, ids[:i], ids[i:k], ids[k:])
        self.young[text] = found
        self.size += 4 * len(text) + 400
        if self.size > self.cache_bytes:
            self.young, self.old, self.size = {}, self.young, 0
        return found

    def ids(self, text: str) -> np.ndarray:
        out, open_text, open_ids = [], "", np.empty(0, np.uint32)
        for n, chunk in enumerate(chunks(text)):
            found = self._chunk(chunk)
            if found is None:
                open_text, open_ids = open_text + chunk, None
                continue
            a, z, head, middle, tail = found
            out += [head if n == 0 else self.bpe.ids(open_text + chunk[:a]), middle]
            open_text, open_ids = chunk[z:], tail
        out.append(open_ids if open_ids is not None else self.bpe.ids(open_text))
        return np.concatenate(out)


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One for each worker process and vocabulary, so that its cache serves all tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(byte_bpe(path))
    return _ENCODERS[path]


def encode(docs: DataFrame, path: str, with_text: bool = False) -> DataFrame:
    """doc_id and ids (array of int) of every row of ``docs``, and the text too if asked for.

    As the tokenizers library gives them with add_special_tokens=False; a special string inside a text is its special
    token. A null text is empty and has no ids. Null ids of documents and repeated rows are rows like others; an empty
    table gives no rows; texts are never cut.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunked = encoder(path)
        for batch in slices(batches, 64):
            texts = batch.column("text").to_pylist()
            arrays = [chunked.ids(t) for t in texts]
            at = np.cumsum([0, *map(len, arrays)])
            ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(arrays).astype(np.int32)))
            columns = {"doc_id": batch.column("doc_id"), "ids": ids} | ({"text": batch.column("text")} if with_text else {})
            yield pa.RecordBatch.from_pydict(columns)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return texts_of(docs).mapInArrow(work, f"doc_id {id_type}, ids array<int>" + ", text string" * with_text)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded text of every row of ``encoded``; null ids decode to the empty text."""
    def work(batches):
        bpe = byte_bpe(path)
        for batch in slices(batches, 64):
            texts = [bpe.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": batch.column("ids"), "text": pa.array(texts, pa.string())})

    id_type = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(work, f"doc_id {id_type}, ids array<int>, text string")


def codec_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded and decoded in one pass, digests only coming out.

    Nulls, empty texts and repeated rows as in ``encode``.
    """
    def work(batches):
        chunked, bpe = encoder(path), byte_bpe(path)
        for batch in slices(batches, 64):
            n, ids_digest, text_digest = [], [], []
            for text in batch.column("text").to_pylist():
                ids = chunked.ids(text)
                n.append(len(ids))
                ids_digest.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_digest.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()),
                                              "ids_sha256": ids_digest, "decoded_sha256": text_digest})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return texts_of(docs).mapInArrow(work, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
