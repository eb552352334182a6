"""Best-fit packing of token pieces into fixed-size sequences by minimum bin slack.

A sequence is built around the longest piece left; a subset-sum over the lengths available, kept as bits of one integer,
finds the fullest sequence that can hold it, which is then removed. Pieces of one length are alike, so the work is done on
the number of pieces of each length: a combination is removed as often as those numbers allow, and a plan of at most a few
thousand combinations fits any number of pieces. The pieces themselves never meet: each gets its number among the pieces of
its length from counts for each task, and looks its sequence up in the plan.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.byte_bpe import byte_bpe
from faultline.llm.shared import slices, stored, texts_of

SIZE, END_ID = 1024, 2
PIECE = "piece int, start long, length long, ids_crc32 long"


def fullest(counts: dict[int, int], size: int) -> dict[int, int]:
    """The pieces (length: how many) with the largest sum of at most ``size``; longer lengths are tried first."""
    steps, reach, mask = [], 1, (1 << size + 1) - 1
    for length in sorted(counts, reverse=True):
        left, take = min(counts[length], size // length) if length else 0, 1
        while left > 0 and not reach >> size & 1:
            take = min(take, left)
            steps.append((length, take, reach))
            reach = (reach | reach << length * take) & mask
            left -= take
            take *= 2
    at, used = reach.bit_length() - 1, Counter()
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] += take
            at -= length * take
    return dict(used)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, dict[int, int]]]:
    """(how many sequences, pieces of each by length), longest piece first; every piece is in exactly one."""
    left, out = {k: n for k, n in counts.items() if n > 0}, []
    while left:
        longest = max(left)
        rest = {k: n - (k == longest) for k, n in left.items() if k <= size - longest and n > (k == longest)}
        found = Counter({longest: 1}) + Counter(fullest(rest, size - longest))
        times = min(left[k] // n for k, n in found.items())
        out.append((times, dict(found)))
        left = {k: m for k, n in left.items() if (m := n - times * found.get(k, 0)) > 0}
    return out


def slots(planned: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """By length: rows (first number of a piece, pieces in a sequence, first sequence, offset of its first piece)."""
    rows: dict[int, list] = {}
    seen, sequence = Counter(), 0
    for times, found in planned:
        offset = 0
        for length, n in sorted(found.items(), reverse=True):
            rows.setdefault(length, []).append((seen[length], n, sequence, offset))
            seen[length] += times * n
            offset += length * n
        sequence += times
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def token_pieces(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """The pieces of every text with its end id, and for packing: the task that made a piece and its number there among
    those of its length. Of a longer text the first piece is the shorter one."""
    def work(batches):
        bpe, task, seen = byte_bpe(path), TaskContext.get().partitionId(), Counter()
        for batch in slices(batches, 128):
            rows, source = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(bpe.ids(text), np.uint32(end_id)).astype("<u4")
                first = len(ids) % size or size
                for piece, start in enumerate([0, *range(first, len(ids), size)]):
                    part = ids[start:first if piece == 0 else start + size]
                    rows.append((piece, start, len(part), zlib.crc32(part.tobytes()), task, seen[len(part)]))
                    source.append(i)
                    seen[len(part)] += 1
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(source)), *columns],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return texts_of(docs).mapInArrow(work, f"doc_id {id_type}, {PIECE}, task int, nth long")


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` (with length, task, nth; stored, as they are read twice) with sequence_id and offset.

    An empty table gives no rows. Pieces of equal length are interchangeable; which of them goes where follows from their
    tasks and places there. A length of 0 or beyond ``size`` is an error.
    """
    in_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in in_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if any(not 0 < k <= size for k in counts):
        raise ValueError(f"a piece has to be 1 to {size} long")
    where = slots(plan(counts, size))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = in_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = pieces.join(first, ["task", "length"]).withColumn("nth", F.col("first") + F.col("nth")).drop("first", "task")

    def place(batches):
        for batch in batches:
            length, nth = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "nth"))
            sequence, offset = np.empty(len(nth), np.int64), np.empty(len(nth), np.int64)
            for k in np.unique(length).tolist():
                at = np.flatnonzero(length == k)
                start, n, first_sequence, first_offset = where[k][np.searchsorted(where[k][:, 0], nth[at], "right") - 1].T
                sequence[at] = first_sequence + (nth[at] - start) // n
                offset[at] = first_offset + (nth[at] - start) % n * k
            yield pa.RecordBatch.from_arrays([c for c, f in zip(batch.columns, batch.schema.names, strict=True) if f != "nth"] + [pa.array(sequence), pa.array(offset)],
                                             names=[f for f in batch.schema.names if f != "nth"] + ["sequence_id", "offset"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema if f.name != "nth"]
    return numbered.mapInArrow(place, ", ".join([*kept, "sequence_id long", "offset long"]))


def best_fit_packing(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece of every document.

    A null text is empty: its one piece is the end id. Null ids and repeated rows are documents like others; an empty
    table gives no rows. Only texts with more than ``size`` ids, the end id among them, are cut.
    """
    packed = pack(stored(token_pieces(docs, path, size, end_id), "pieces"), size)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
