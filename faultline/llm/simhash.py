"""Near duplicates by 64-bit SimHash, found through an inverted index on byte positions with count filtering.

A fingerprint is eight positional bytes. Two fingerprints within four bits differ in four bytes at most, so they share at
least ``MATCHES`` = four positional bytes. The index therefore holds, for every fingerprint, each way to choose four of its
positional bytes: whoever shares four meets. Of a pair that meets, the shared positional bytes are tallied, pairs below the
guaranteed minimum are passed over (as are meetings but the first of a pair), and the bits are compared. Equal fingerprints
are one entry from the start.

A list of the index may be long where many documents are nearly the same. It is cut into blocks, and each two blocks are
compared in a task of their own, which returns a spanning forest of the links it finds, never the pairs.

Joins with the index and with stored tables shuffle (hint ``merge``). Spark would size the index, 70 rows a fingerprint, by the
fingerprints it is made of, and stored tables by their compressed files, and broadcast what is far beyond its limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.components import stars
from faultline.llm.shared import only_rows, slices, stored, texts_of, with_row

SHINGLE, MAX_BITS, SEED = 4, 4, 42
#: Positional bytes that two fingerprints within MAX_BITS must share.
MATCHES = 8 - MAX_BITS
#: Fingerprints in a block of a long index list; lists up to SHORT are compared at once with those of other lists.
BLOCK, SHORT = 1024, 8
CHOICES = list(combinations(range(8), MATCHES))
#: By the set of shared positions (one bit each): its first choice, -1 if it holds too few.
FIRST_CHOICE = np.full(256, -1, np.int64)
for _shared in range(256):
    _at = tuple(i for i in range(8) if _shared >> i & 1)[:MATCHES]
    if len(_at) == MATCHES:
        FIRST_CHOICE[_shared] = CHOICES.index(_at)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of the text's shingles, repeats included; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n, tally = max(1, len(words) - shingle + 1), np.zeros(64, np.int64)
    for start in range(0, n, 1 << 16):
        part = [xxhash.xxh64_intdigest(b" ".join(words[i:i + shingle]), SEED) for i in range(start, min(n, start + (1 << 16)))]
        tally += np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * tally > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *more: str, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) and the named columns of every row; a null text is empty."""
    def work(batches):
        for batch in slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps), *(batch.column(c) for c in more)], names=["doc_id", "fp", *more])

    kept = "".join(f", `{c}` {docs.select(c).schema[0].dataType.simpleString()}" for c in more)
    return texts_of(docs, *more).mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long{kept}")


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2048):
        fps = batch.column("fp").to_numpy()
        positions = np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8)
        keys = [(np.ascontiguousarray(positions[:, c]).view("<u4")[:, 0].astype(np.int64) | (k << 32)) for k, c in enumerate(CHOICES)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(fps, len(CHOICES)))], names=["key", "fp"])


def _links_of_short(key: np.ndarray, unit: np.ndarray, fps: np.ndarray) -> list[np.ndarray]:
    """All links within short lists, many lists at once: neighbours at each distance within a list."""
    out = []
    for lag in range(1, SHORT):
        at = np.flatnonzero(unit[lag:] == unit[:-lag])
        if not len(at):
            break
        a, b = fps[at], fps[at + lag]
        differing = (a ^ b).view(np.uint64)  # bits of a signed number would be those of its absolute value
        shared = np.packbits(differing.view(np.uint8).reshape(-1, 8) == 0, axis=1, bitorder="little")[:, 0]
        keep = (FIRST_CHOICE[shared] == key[at] >> 32) & (np.bitwise_count(differing) <= MAX_BITS)
        out.append(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1)[keep & (a != b)])
    return out


def _forest(fps: np.ndarray) -> np.ndarray:
    """A spanning forest of the links among ``fps``: each fingerprint leaves the rest as soon as it is reached."""
    rest, out = np.unique(fps), []
    while len(rest) > 1:
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            x = reached.pop()
            near = np.bitwise_count((rest ^ x).view(np.uint64)) <= MAX_BITS
            found, rest = rest[near], rest[~near]
            out.append(np.stack([np.maximum(found, x), np.minimum(found, x)], axis=1))
            reached += found.tolist()
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a > b) within each unit of rows sorted by key and blocks; a unit never spans tasks, but may span batches."""
    held = np.empty((0, 4), np.int64)

    def found(rows: np.ndarray):
        if not len(rows):
            return
        new = np.any(rows[1:, :3] != rows[:-1, :3], axis=1)
        unit = np.concatenate([[0], np.cumsum(new)])
        sizes = np.bincount(unit)
        short = sizes[unit] <= SHORT
        out = _links_of_short(rows[short, 0], unit[short], rows[short, 3].copy())
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        out += [_forest(rows[bounds[k]:bounds[k + 1], 3]) for k in np.flatnonzero(sizes > SHORT)]
        links = np.concatenate(out) if out else np.empty((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy() for c in ("key", "lo", "hi", "fp")], axis=1)
        held = np.concatenate([held, rows])
        start = int(np.argmax(np.all(held[:, :3] == held[-1, :3], axis=1))) if len(held) else 0
        if start:
            yield from found(held[:start])
            held = held[start:]
    yield from found(held)


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a > b) that connect exactly the distinct fingerprints (column fp) connected by pairs within MAX_BITS."""
    index = distinct.select("fp").mapInArrow(_index, "key long, fp long")
    met = index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("long")
    rows = (index.join(met.hint("merge"), "key").select("key", "fp", blocks.alias("blocks"), F.pmod(F.xxhash64("fp"), blocks).alias("own"))
            .select("key", "fp", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
            .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp"))
    units = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return units.mapInArrow(_links, "a long, b long").distinct()


def _rooted(fps: DataFrame) -> DataFrame:
    """fp, root, component_id of every distinct fingerprint of ``fps`` (doc_id, fp; stored)."""
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    linked = stars(links(distinct))
    roots = linked.select(F.col("a").alias("fp"), F.col("b").alias("root"))
    rooted = distinct.join(roots.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # a component's smallest id; only fingerprints with links have to meet for it
    with_links = roots.union(linked.select("b", "b").distinct())
    smallest = distinct.join(with_links.hint("merge"), "fp").groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(smallest, "root", "left").select("fp", "root", F.coalesce("component_id", "first_id").alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id of every row of ``docs``.

    component_id: the smallest id reachable over links, its own included. Null and empty texts have fingerprint zero and are
    linked like any other. Null ids are never the smallest unless all are null; repeated rows are rows of one component; an
    empty table gives no rows.
    """
    fps = stored(fingerprints(docs, shingle=shingle), "fingerprints")
    return fps.join(_rooted(fps).hint("merge"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row of each component, all columns: that with the smallest id (null last), of several the first in the table."""
    placed = with_row(docs)
    fps = stored(fingerprints(placed, "row_of_table", shingle=shingle), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_of_table"))
    kept = fps.join(_rooted(fps).select("fp", "root").hint("merge"), "fp").groupBy("root").agg(first.alias("kept")).select("kept.row_of_table")
    return only_rows(placed, kept)
