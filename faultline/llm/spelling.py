"""Spelling variants: words one edit apart, found by integer pairs of trie nodes.

All words lie in a trie, and all reversed words in another one; the nodes of both are numbered. A word without its code
point at place i is the pair (node of what stands before i, node of what stands behind it); a word as it is, cut at i, is
such a pair too. Two words that share the pair of a skipped place differ by a replacement there; a word whose cut is another
word's skipped place lacks one code point of it. So equal integer pairs are exact neighbours, nothing is verified, and a
pair has no more words than the alphabet has letters, and one: there is no hot key.

A trie is numbered from words in order: a word has new nodes behind what it shares with the word before it. Ranges of words
are numbered by tasks of their own; only the nodes that a range's first word shares with the last word of the range before
it are put right afterwards, from one small row for each range.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import slices, stored, texts_of

LEAST_LENGTH, LEAST_COUNT, RATIO, DAMAGED = 7, 2, 10, 31
#: Different words that a task counts before it hands the counts on.
HELD = 200_000
#: Node numbers: the range in the upper bits, a counter in the lower ones.
RANGE = 40
RUNS = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text to (word, n), pre-summed; of a run that the damage hits one code point goes."""
    held: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    for batch in slices(batches):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for run, n in Counter(RUNS.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():
                h = zlib.crc32(run.encode(), start)
                if h % DAMAGED == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1:]
                    if len(run) < LEAST_LENGTH:
                        continue
                held[run] += n
        if len(held) > HELD:
            yield out()
            held.clear()
    yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: the damaged runs of letters of all texts that are long and frequent enough. A null id is written as nothing."""
    partial = texts_of(docs).mapInArrow(_counted, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (number, text) to (number, text, nodes, range, shared, last): the nodes of text's beginnings, numbered within this range.

    ``shared``: how many code points it shares with the range's first text. The last row of a range is marked.
    """
    place = TaskContext.get().partitionId()
    before, nodes, following, shared = None, [], place << RANGE, 0
    held: list[tuple] = []

    def out(rows):
        numbers, texts, lists, shares, lasts = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(numbers, pa.int64()), pa.array(texts), pa.array(lists, pa.list_(pa.int64())), pa.array([place] * len(rows), pa.int64()),
             pa.array(shares, pa.int64()), pa.array(lasts, pa.bool_())], names=["number", "text", "nodes", "range", "shared", "last"])

    for batch in batches:
        for number, text in zip(batch.column("number").to_pylist(), batch.column("text").to_pylist()):
            common = -1 if before is None else len(os.path.commonprefix((before, text)))
            fresh = len(text) - common
            nodes = nodes[:common + 1] + list(range(following, following + fresh))
            following += fresh
            shared = len(text) if before is None else min(common, shared)  # as the texts are in order
            before = text
            held.append((number, text, nodes, shared, False))
            if len(held) > 4096:
                yield out(held[:-1])
                held = held[-1:]
    if held:
        held[-1] = (*held[-1][:-1], True)
        yield out(held)


def trie_nodes(words: DataFrame, text: Column) -> DataFrame:
    """number, nodes: the numbers of the trie nodes of the beginnings (length 0, 1 ...) of ``text``; equal beginnings, equal numbers.

    One row for each range of words comes to the driver: its first and last text, and the last one's nodes.
    """
    spark = words.sparkSession
    ranges = words.select("number", text.alias("text")).repartitionByRange("text").sortWithinPartitions("text")
    rows = stored(ranges.mapInArrow(_nodes, "number long, text string, nodes array<long>, range long, shared long, last boolean"), "nodes")
    firsts = rows.groupBy("range").agg(F.min("text").alias("first"))
    ends = rows.where("last").join(firsts, "range").select("range", "first", "text", "nodes", "shared").orderBy("range").collect()
    before, carried, fixed = None, [], {}
    for r in ends:
        common = -1 if before is None else len(os.path.commonprefix((before, r["first"])))
        fixed[r["range"]] = carried[:common + 1]
        before, kept = r["text"], min(common, r["shared"])
        carried = carried[:kept + 1] + r["nodes"][kept + 1:]
    known = spark.sparkContext.broadcast(fixed)

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for nodes, place, shared in zip(*(batch.column(c).to_pylist() for c in ("nodes", "range", "shared"))):
                true = known.value[place][:shared + 1]
                lists.append(true + nodes[len(true):])
            yield pa.RecordBatch.from_arrays([batch.column("number"), pa.array(lists, pa.list_(pa.int64()))], names=["number", "nodes"])

    return rows.select("number", "nodes", "range", "shared").mapInArrow(right, "number long, nodes array<long>")


#: How a word meets a pair: cut there, without a code point that equals the one before it, without any other.
CUT, AGAIN, SKIPPED = 0, 1, 2


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words to their integer pairs. A code point among equal ones is a skipped place for insertions once, at the first of them."""
    for batch in slices(batches, 2048):
        out: list[list] = [[], [], [], [], []]
        for word, number, n, before, behind in zip(*(batch.column(c).to_pylist() for c in ("word", "number", "n", "nodes", "reversed"))):
            size = len(word)
            behind = behind[::-1]  # behind[i]: the node of what stands from i on
            out[0] += before
            out[1] += behind
            out[0] += before[:size]
            out[1] += behind[1:]
            out[2] += [CUT] * (size + 1) + [AGAIN if i and word[i] == word[i - 1] else SKIPPED for i in range(size)]
            out[3] += [number] * (2 * size + 1)
            out[4] += [n] * (2 * size + 1)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int8()), pa.array(out[3], pa.int64()),
                                          pa.array(out[4], pa.int64())], names=["before", "behind", "kind", "number", "n"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pairs to (number, n_near, best_n, less): of each word at a pair its neighbours there and the most frequent one.

    Among words that skip a place there the best neighbour is the best of all, or the second for the best itself.
    """
    held: np.ndarray | None = None

    def found(rows: np.ndarray):
        new = np.any(rows[1:, :2] != rows[:-1, :2], axis=1)
        group = np.concatenate([[0], np.cumsum(new)])
        rows, group = rows[(shared := np.bincount(group) > 1)[group]], group[shared[group]]
        if not len(rows):
            return
        # in each group by kind (the cut word first), then by falling n and rising number
        order = np.lexsort((rows[:, 3], -rows[:, 4], rows[:, 2] > CUT, group))
        rows, group = rows[order], group[order]
        start = np.concatenate([[True], group[1:] != group[:-1]])
        first = np.flatnonzero(start)
        index = np.cumsum(start) - 1
        cut = rows[first, 2] == CUT
        skips = first + cut  # where the skipping words of each group start
        size = np.diff(np.append(first, len(rows))) - cut
        numbers, counts, near = rows[:, 3], rows[:, 4], np.zeros(len(rows), np.int64)
        best_n, best = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)

        def offer(at, other):
            """Rows ``at`` have the row ``other`` as neighbour."""
            n, number = counts[other], numbers[other]
            better = (n > best_n[at]) | ((n == best_n[at]) & (number < best[at]))
            best_n[at[better]], best[at[better]] = n[better], number[better]

        skip = rows[:, 2] > CUT
        near[skip] += size[index[skip]] - 1
        at = np.flatnonzero(skip & (size[index] > 1))
        top = skips[index[at]]
        offer(at, np.where(at == top, top + 1, top))
        joined = np.flatnonzero((rows[:, 2] == SKIPPED) & cut[index])
        near[joined] += 1
        offer(joined, first[index[joined]])
        np.add.at(near, first[index[joined]], 1)
        # the best that joins the cut word: rows are by falling n, so the first of them
        heads = joined[np.unique(index[joined], return_index=True)[1]]
        offer(first[index[heads]], heads)
        some = near > 0
        yield pa.RecordBatch.from_arrays([pa.array(v[some]) for v in (numbers, near, best_n, -best)], names=["number", "n_near", "best_n", "less"])

    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("before", "behind", "kind", "number", "n")], axis=1)
        held = rows if held is None else np.concatenate([held, rows])
        start = int(np.argmax(np.all(held[:, :2] == held[-1, :2], axis=1))) if len(held) else 0
        if start:
            yield from found(held[:start])
            held = held[start:]
    if held is not None and len(held):
        yield from found(held)


def near_words(words: DataFrame) -> DataFrame:
    """number, n_near, best_n, best: the number of near words and the most frequent one (then the smallest), for words that have any.

    ``words``: word, n, number (rising with the word); stored.
    """
    forwards = trie_nodes(words, F.col("word"))
    backwards = trie_nodes(words, F.reverse("word")).withColumnRenamed("nodes", "reversed")
    pairs = words.join(forwards, "number").join(backwards, "number").mapInArrow(_pairs, "before long, behind long, kind byte, number long, n long")
    met = pairs.repartition("before", "behind").sortWithinPartitions("before", "behind")
    partial = met.mapInArrow(_neighbours, "number long, n_near long, best_n long, less long")
    best = F.max(F.struct("best_n", "less")).alias("best")
    return partial.groupBy("number").agg(F.sum("n_near").alias("n_near"), best).select("number", "n_near", "best.best_n", (-F.col("best.less")).alias("best"))


def _numbered(words: DataFrame) -> DataFrame:
    """word, n and a number that rises with the word."""
    ordered = words.repartitionByRange("word").sortWithinPartitions("word")
    return stored(ordered.withColumn("number", F.monotonically_increasing_id()), "words")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of ``words`` (word, n; each word once, none null).

    Near: exactly one code point inserted, deleted or replaced. form: the near word of largest n (ties: the smallest), if
    that is at least ``ratio`` times the word's own, else null. root: the last word that forms lead to, the word itself
    without one. No words give no rows.
    """
    words = _numbered(words)
    near = near_words(words)
    has_form = F.col("best_n") >= ratio * F.col("n")
    rows = stored(words.join(near, "number", "left").select(
        "number", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has_form, F.col("best")).alias("form"), F.when(has_form, F.col("best_n")).alias("form_n")), "near")
    # pointers double their reach each round; n grows by the ratio with each form, so a few rounds end it
    step = rows.where("form is not null").select("number", F.col("form").alias("root"))
    while True:
        on = step.select(F.col("number").alias("root"), F.col("root").alias("next"))
        after = stored(step.join(on, "root", "left").select("number", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        step = after.select("number", "root")
        if after.where("moved").isEmpty():
            break
    names = words.select(F.col("number").alias("to"), F.col("word").alias("name"))
    linked = (rows.where("form is not null").join(step, "number")
              .join(names.withColumnRenamed("name", "form_word"), F.col("form") == F.col("to")).drop("to")
              .join(names.withColumnRenamed("name", "root_word"), F.col("root") == F.col("to")).drop("to"))
    alone = rows.where("form is null").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
    return linked.select("word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", "n_near", "form_n").unionByName(alone)


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``variants`` of the words of all texts (``word_counts``). Null and empty texts have no words; repeated rows count each time."""
    return variants(word_counts(docs))
