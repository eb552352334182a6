"""Documents whose sets of word n-grams are nearly the same (Jaccard), by a prefix-filtered join.

A document is the set of hashes of its distinct n-grams; equal sets are one class from the start. Grams are ordered rare
first, by the logarithm of their document frequency (then by hash), counted over all documents: blocks of documents send their
distinct grams as packed numbers, slab by slab of hashes, and get back half a byte for each. So no gram travels as a row.

Two sets that are similar enough share a gram within their prefixes. A gram of one document only meets nobody, so just the
others of each prefix become postings (gram, set), which are shuffled by gram. Sets that meet pass the length filter, the
positional filter and the suffix filter (a lower bound of the Hamming distance from how many grams of each set fall into
each of 16 ranges of hashes).

What passes is not listed as pairs: each list returns a spanning forest of its candidates. Their components, the clusters,
are dealt out, each with its sets, and verified there by true intersections, once per pair at most and never between sets
that are already connected. A cluster too large for one task is first compared with some pivots; then only sets that
are not connected with most of the others are compared with all others, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.components import stars
from faultline.llm.shared import joined_by_key, slices, stored, texts_of, with_row
from faultline.llm.word_hash import ODD, mixed, texts_words

#: Words of a gram, and the least similarity in per cent.
GRAM, PERCENT = 3, 90
#: Rows of a table that are one block of documents while grams are counted; a longer text is a block of its own.
ROWS, LONG_TEXT = 1024, 1 << 20
#: Grams of one slab of hashes, about, and the least number of slabs.
SLAB_GRAMS, LEAST_SLABS = 1 << 22, 64
#: Bits of the filter that tells which sets are candidates; a full one only makes more sets travel.
FILTER_BITS = 1 << 24
#: Postings in a block of a long list; sets and grams in a block of a large cluster; pivots of such a cluster.
BLOCK, SETS, GRAMS, PIVOTS = 1024, 512, 1 << 21, 16
#: Sets that a task remembers having emitted.
SEEN = 1 << 20


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each n-gram, in order; with fewer words, of all of them."""
    size = min(size, len(words))
    n = len(words) - size + 1
    found = words[:n] * ODD[0] + np.uint64(size)
    for k in range(1, size):  # order counts, and the number of words
        found = (found ^ (found >> np.uint64(31))) * ODD[1] + words[k:n + k] * ODD[0]
    return mixed(found)


def grams(text: str, size: int = GRAM) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams; with fewer words the whole sequence is one, without words there is none."""
    return next(texts_grams([text], size))


def texts_grams(texts: list[str], size: int = GRAM) -> Iterator[np.ndarray]:
    for words in texts_words(texts):
        if not len(words):
            yield words
            continue
        found = np.sort(_grams(words, size))
        new = np.empty(len(found), bool)
        new[0] = True
        np.not_equal(found[1:], found[:-1], out=new[1:])
        yield found[new]


def set_key(hashes: np.ndarray) -> int:
    """One number for a set, as a signed long."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


def least_overlap(a: int, b: int, percent: int = PERCENT) -> int:
    """Of sets of a and b grams: the smallest intersection with at least ``percent`` of the union."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def linkable(n: int, percent: int = PERCENT) -> bool:
    """Whether a set of n grams can be similar to one that is not equal: to one with a gram more at least."""
    return n > 0 and 100 * n >= percent * (n + 1)


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = list(texts_grams(batch.column("text").to_pylist(), size))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(f) for f in found], pa.int64()),
                                          pa.array([set_key(f) if len(f) else None for f in found], pa.int64())], names=["doc_id", "n_shingles", "key"])


def _places(hashes: np.ndarray, slabs: int) -> np.ndarray:
    """Slab and place in it, as one number: what a gram is counted by."""
    return ((hashes % np.uint64(slabs)) << np.uint64(32)) | ((hashes >> np.uint64(20)) & np.uint64(0xFFFFFFFF))


def _distinct(sets: list[np.ndarray], slabs: int) -> np.ndarray:
    """Sorted places of all grams of a block of documents; sets that occur twice count once."""
    return np.unique(_places(np.concatenate(sets), slabs)) if sets else np.empty(0, np.uint64)


def _runs(batches: Iterator[pa.RecordBatch], size: int, columns: tuple[str, ...] = ()) -> Iterator[tuple]:
    """(file, block, rows, sets, others) of each run of rows of one block: row numbers, gram sets, and rows without a number."""
    now, rows, sets, others = None, [], [], []
    for batch in slices(batches):
        texts = batch.column("text").to_pylist()
        found = texts_grams([t or "" for t in texts], size)
        extra = zip(*(batch.column(c).to_pylist() for c in columns)) if columns else [()] * len(texts)
        for file, block, n, hashes, more in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "n")), found, extra):
            if now != (file, block):
                if now is not None:
                    yield (*now, rows, sets, others)
                now, rows, sets, others = (file, block), [], [], []
            if n is None:
                others.append(more)
            elif len(hashes):
                rows.append(n)
                sets.append(hashes)
    if now is not None:
        yield (*now, rows, sets, others)


def _packed(size: int, slabs: int):
    """Blocks of rows to (slab, file, block, first, last, values): the distinct grams of a run of rows, sorted, slab by slab.

    Four bytes a gram, the first byte of all of them first, so that they compress.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, rows, sets, _ in _runs(batches, size):
            places = _distinct(sets, slabs)
            if not len(places):
                continue
            slab = (places >> np.uint64(32)).astype(np.int64)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(slab)) + 1, [len(slab)]])
            values = places.astype(np.uint32)
            packed = [np.ascontiguousarray(values[a:b].astype(">u4").view(np.uint8).reshape(-1, 4).T).tobytes() for a, b in zip(starts[:-1], starts[1:])]
            n = len(packed)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slab[starts[:-1]]), pa.array([file] * n), pa.array([block] * n, pa.int64()), pa.array([rows[0]] * n, pa.int64()), pa.array([rows[-1]] * n, pa.int64()),
                 pa.array(packed, pa.binary())], names=["slab", "file", "block", "first", "last", "values"])

    return work


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All packed runs of each slab to the same runs with half a byte a gram: twice the logarithm of its document frequency.

    Frequencies count blocks of documents, where a gram counts once however many of the block's documents hold it; ``_classes``
    adds those within the block.
    """
    held: dict[int, list[tuple]] = {}
    for batch in batches:
        for slab, *place, values in zip(*(batch.column(c).to_pylist() for c in ("slab", "file", "block", "first", "last", "values"))):
            held.setdefault(slab, []).append((place, np.ascontiguousarray(np.frombuffer(values, np.uint8).reshape(4, -1).T).view(">u4")[:, 0]))
    for slab in list(held):
        runs = held.pop(slab)
        _, inverse, counts = np.unique(np.concatenate([v for _, v in runs]), return_inverse=True, return_counts=True)
        classes = np.minimum(15, 2 * np.log2(counts)).astype(np.uint8)[inverse]
        parts = np.split(classes, np.cumsum([len(v) for _, v in runs])[:-1])
        out = [(np.append(c, np.uint8(0)) if len(c) % 2 else c).reshape(-1, 2) for c in parts]
        cols = list(zip(*(place for place, _ in runs)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([slab] * len(runs), pa.int64()), pa.array(cols[0]), *(pa.array(c, pa.int64()) for c in cols[1:]), pa.array([len(c) for c in parts], pa.int64()),
             pa.array([(c[:, 0] << 4 | c[:, 1]).tobytes() for c in out], pa.binary())], names=["slab", "file", "block", "first", "last", "grams", "classes"])


def _unpacked(classes: bytes, n: int) -> np.ndarray:
    both = np.frombuffer(classes, np.uint8)
    return np.stack([both >> 4, both & 15], axis=1).reshape(-1)[:n]


def _classes(sets: list[np.ndarray], places: np.ndarray, classes: np.ndarray, slabs: int) -> list[np.ndarray]:
    """Of every gram of every set of a run its class: 0 for a gram that no other set holds, here or elsewhere.

    A class must be the same wherever the gram occurs, so a gram that only this run holds, but twice, is of class 1.
    """
    at = [np.searchsorted(places, _places(s, slabs)) for s in sets]
    inside = np.bincount(np.concatenate(at), minlength=len(places)) if at else np.zeros(0, np.int64)
    full = np.where((classes == 0) & (inside > 1), 1, classes)
    return [full[a] for a in at]


def _postings(size: int, percent: int, slabs: int):
    """Rows of a block, the classes of its grams first, to postings (gram, key, n, place, shape0, shape1)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, _, rows, sets, others in _runs(batches, size, ("first", "last", "slab", "grams", "classes")):
            numbers, cols = np.array(rows), [[] for _ in range(6)]
            for first, last in sorted({(o[0], o[1]) for o in others}):
                own = [sets[k] for k in np.flatnonzero((numbers >= first) & (numbers <= last))]
                places = _distinct(own, slabs)
                parts = sorted((o[2], _unpacked(o[4], o[3])) for o in others if o[:2] == (first, last))
                for hashes, classes in zip(own, _classes(own, places, np.concatenate([c for _, c in parts]), slabs)):
                    n = len(hashes)
                    if not linkable(n, percent) or (key := set_key(hashes)) in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    order = np.lexsort((hashes, classes))[:prefix_length(n, percent)]
                    place = np.flatnonzero(classes[order] > 0)
                    if not len(place):
                        continue
                    shape = (np.bincount((hashes >> np.uint64(60)).astype(np.int64), minlength=16) & 255).astype(np.uint8).view(np.int64)
                    p = len(place)
                    for col, v in zip(cols, (hashes[order[place]].view(np.int64), np.full(p, key), np.full(p, n), place, np.full(p, shape[0]), np.full(p, shape[1]))):
                        col.append(v)
            if cols[0]:
                types = (np.int64, np.int64, np.int32, np.int32, np.int64, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t)) for c, t in zip(cols, types)], names=["gram", "key", "n", "place", "shape0", "shape1"])

    return work


def rare_first_postings(docs: DataFrame, grams_in_all: int, size: int = GRAM, percent: int = PERCENT, rows: int = ROWS) -> DataFrame:
    """gram, key, n, place, shape0, shape1: of every different set the grams of its prefix that another one holds as well.

    ``place`` is the gram's place in the set, rare grams first. ``grams_in_all`` sets the number of slabs. A block is cut in two
    where the reading tasks' borders cut it; its parts are counted as two blocks.
    """
    slabs = max(LEAST_SLABS, -(-grams_in_all // SLAB_GRAMS))
    block = F.when(F.length("text") > LONG_TEXT, -1 - F.col("row_of_table.n")).otherwise(F.floor(F.col("row_of_table.n") / rows)).cast("long")
    texts = with_row(docs).select(F.col("row_of_table.file").alias("file"), block.alias("block"), F.col("row_of_table.n").alias("n"), F.coalesce("text", F.lit("")).alias("text"))
    packed = texts.mapInArrow(_packed(size, slabs), "slab long, file string, block long, first long, last long, values binary")
    counted = packed.repartition("slab").mapInArrow(_counted, "slab long, file string, block long, first long, last long, grams long, classes binary")
    blank = {"first": "long", "last": "long", "slab": "long", "grams": "long", "classes": "binary"}
    both = texts.select("*", *(F.lit(None).cast(t).alias(c) for c, t in blank.items())).unionByName(
        counted.select("file", "block", F.lit(None).cast("long").alias("n"), F.lit("").alias("text"), *blank))
    by_block = both.repartition("file", "block").sortWithinPartitions("file", "block", F.asc_nulls_first("n"))
    return by_block.mapInArrow(_postings(size, percent, slabs), "gram long, key long, n int, place int, shape0 long, shape1 long")


def _filtered(rows: np.ndarray, x: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Which of ``others`` pass the length, positional and suffix filters with row ``x``; rows: key, n, place, shape0, shape1."""
    n, m = rows[x, 1], rows[others, 1]
    least = -(-percent * (n + m) // (100 + percent))
    fits = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (1 + np.minimum(n - rows[x, 2], m - rows[others, 2]) - 1 >= least)
    shapes, shape = np.ascontiguousarray(rows[others, 3:5]).view(np.uint8), np.ascontiguousarray(rows[x:x + 1, 3:5]).view(np.uint8)
    apart = shapes - shape  # modulo 256, so the shorter way round is a lower bound
    return fits & (np.minimum(apart, -apart).sum(axis=1, dtype=np.int64) <= n + m - 2 * least)


def _forest(rows: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the candidate pairs within one list."""
    rest, out = np.arange(len(rows)), []
    while len(rest) > 1:
        reached, rest = [int(rest[0])], rest[1:]
        while reached and len(rest):
            x = reached.pop()
            near = _filtered(rows, x, rest, percent)
            out += [(int(rows[x, 0]), int(rows[y, 0])) for y in rest[near]]
            reached += rest[near].tolist()
            rest = rest[~near]
    return out


def _candidates(percent: int):
    """Postings sorted by gram and blocks to candidate links; a unit never spans tasks, but may span batches."""
    def found(rows: np.ndarray):
        new = np.any(rows[1:, :3] != rows[:-1, :3], axis=1)
        bounds = np.concatenate([[0], np.flatnonzero(new) + 1, [len(rows)]])
        links: set[tuple[int, int]] = set()
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a > 1:
                unit = rows[a:b, 3:]
                unit = unit[np.unique(unit[:, 0], return_index=True)[1]]  # tasks that met equal sets sent one each
                links.update((max(p), min(p)) for p in _forest(unit, percent))
        pairs = np.array(list(links), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 8), np.int64)
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("gram", "lo", "hi", "key", "n", "place", "shape0", "shape1")], axis=1)
            held = np.concatenate([held, rows])
            start = int(np.argmax(np.all(held[:, :3] == held[-1, :3], axis=1))) if len(held) else 0
            if start:
                yield found(held[:start])
                held = held[start:]
        if len(held):
            yield found(held)

    return work


def candidate_links(postings: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Links (a > b) between set keys that connect all pairs that pass the filters at the first gram their prefixes share.

    ``postings``: gram, key, n, place, shape0, shape1; stored.
    """
    met = stored(postings.groupBy("gram").agg(F.count("*").alias("many"), F.min("key").alias("least"), F.max("key").alias("most"))
                 .where("least < most").select("gram", F.ceil(F.col("many") / block).cast("long").alias("blocks")), "met")
    rows = joined_by_key(postings, met, "gram").withColumn("own", F.pmod(F.xxhash64("key"), "blocks"))
    rows = rows.select("gram", "key", "n", "place", "shape0", "shape1", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    units = rows.select("gram", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "key", "n", "place", "shape0", "shape1")
    units = units.repartition("gram", "lo", "hi").sortWithinPartitions("gram", "lo", "hi")
    return units.mapInArrow(_candidates(percent), "a long, b long")


def _candidate_filter(keys: DataFrame) -> np.ndarray:
    """Bit ``key modulo FILTER_BITS`` is set for every key; the driver gets FILTER_BITS bits at most."""
    at = F.pmod("key", F.lit(FILTER_BITS))
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    words = keys.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(key, {FILTER_BITS}) & 63 as int))").alias("bit"))
    for r in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        bits[r["word"]] = r["bits"]
    return bits


def _candidate_sets(bits, size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            keys, sets = [], []
            for text in batch.column("text").to_pylist():
                hashes = grams(text, size)
                if not len(hashes) or (key := set_key(hashes)) in seen:
                    continue
                at = key % FILTER_BITS
                if int(bits.value[at >> 6]) >> (at & 63) & 1:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    keys.append(key)
                    sets.append(hashes.tobytes())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], names=["key", "grams"])

    return work


UNIT = ["cluster", "lo", "hi"]


def _verified(percent: int):
    """Units (cluster, lo, hi; sorted) of sets to true links (a > b), a spanning forest over what the labels already connect.

    A set that asks is compared with those that are told: not with itself, once with a set that asks too, and not with sets
    of its own label; a link makes two labels one.
    """
    def links(unit: list[dict]) -> list[tuple[int, int]]:
        sets = [np.frombuffer(r["grams"], np.uint64) for r in unit]
        keys, labels = (np.array([r[c] for r in unit], np.int64) for c in ("key", "label"))
        told, peer = (np.array([r[c] for r in unit], bool) for c in ("told", "peer"))
        n = np.array([len(s) for s in sets], np.int64)
        shapes = np.stack([np.bincount((s >> np.uint64(60)).astype(np.int64), minlength=16) for s in sets])
        out = []
        for x in range(len(unit)):
            if not unit[x]["ask"]:
                continue
            least = -(-percent * (n[x] + n) // (100 + percent))
            may = told & (labels != labels[x]) & (keys != keys[x]) & (~peer | (keys < keys[x]))
            may &= 100 * np.minimum(n[x], n) >= percent * np.maximum(n[x], n)
            may &= np.abs(shapes - shapes[x]).sum(axis=1) <= n[x] + n - 2 * least
            for y in np.flatnonzero(may).tolist():
                if labels[y] == labels[x]:
                    continue
                at = np.searchsorted(sets[x], sets[y])
                at[at == n[x]] = 0
                if np.count_nonzero(sets[x][at] == sets[y]) >= least[y]:
                    out.append((max(keys[x], keys[y]), min(keys[x], keys[y])))
                    labels[labels == labels[y]] = labels[x]
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, now = [], None

        def done():
            pairs = np.array(links(unit), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in slices(batches):
            for r in batch.to_pylist():
                place = tuple(r[c] for c in UNIT)
                if place != now and unit:
                    yield done()
                    unit = []
                now = place
                unit.append(r)
        if unit:
            yield done()

    return work


def _verify(units: DataFrame, percent: int) -> DataFrame:
    rows = units.select(*UNIT, "key", "grams", "label", "ask", "told", "peer")
    return rows.repartition(*UNIT).sortWithinPartitions(*UNIT).mapInArrow(_verified(percent), "a long, b long")


def _verified_links(sets: DataFrame, percent: int, most_sets: int = SETS, most_grams: int = GRAMS) -> DataFrame:
    """True links that connect all similar sets of each cluster. ``sets``: cluster, key, grams (a set's hashes); stored."""
    yes, no, zero = F.lit(True), F.lit(False), F.lit(0).cast("long")
    sized = sets.groupBy("cluster").agg(F.count("*").alias("sets"), F.sum(F.length("grams") / 8).alias("grams_in"))
    blocks = F.greatest(F.ceil(F.col("sets") / most_sets), F.ceil(F.col("grams_in") / most_grams)).cast("long")
    sized = stored(sized.select("cluster", blocks.alias("blocks")), "sized")
    own = F.col("key").alias("label")
    small = joined_by_key(sets, sized.where("blocks = 1").select("cluster"), "cluster")
    found = stored(_verify(small.select("cluster", zero.alias("lo"), zero.alias("hi"), "key", "grams", own, yes.alias("ask"), yes.alias("told"), yes.alias("peer")), percent), "verified")
    large = stored(sized.where("blocks > 1"), "large")
    if large.isEmpty():
        return found
    members = stored(joined_by_key(sets, large, "cluster").withColumn("block", F.pmod(F.xxhash64("key"), "blocks")), "members")

    # pivots, from all over the cluster: of each hash class the smallest key
    pivots = members.groupBy("cluster", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(PIVOTS)).alias("nth")).agg(F.min("key").alias("key")).select("key")
    pivots = stored(members.join(pivots, "key", "left_semi"), "pivots")
    asking = pivots.select("cluster", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("lo"), zero.alias("hi"), "key", "grams", own, yes.alias("ask"), no.alias("told"), yes.alias("peer"))
    is_pivot = pivots.select("key", yes.alias("pivot"))
    told = members.join(is_pivot, "key", "left").select("cluster", F.col("block").alias("lo"), zero.alias("hi"), "key", "grams", own, no.alias("ask"), yes.alias("told"),
                                                        F.coalesce("pivot", no).alias("peer"))
    first = stored(_verify(asking.unionByName(told), percent), "by-pivots")

    # whoever is not connected with the most others asks all of them
    roots = stars(first).select(F.col("a").alias("key"), F.col("b").alias("root"))
    labelled = stored(members.select("cluster", "key", "block", "blocks").join(roots, "key", "left").withColumn("label", F.coalesce("root", "key")).drop("root"), "labelled")
    main = labelled.groupBy("cluster", "label").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max(F.struct("n", "label")).alias("most")).select("cluster", F.col("most.label").alias("main"))
    stray = stored(joined_by_key(labelled, stored(main, "main"), "cluster").withColumn("asks", F.col("label") != F.col("main")), "stray")
    counts = stray.where("asks").groupBy("cluster").agg(F.ceil(F.count("*") / most_sets).cast("long").alias("ask_blocks"))
    stray = stored(joined_by_key(stray, stored(counts, "ask-blocks"), "cluster"), "stray")
    rows = members.select("key", "grams").join(stray, "key")
    asking = rows.where("asks").select("cluster", F.pmod(F.xxhash64("key", F.lit(2)), "ask_blocks").alias("lo"), F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("hi"),
                                       "key", "grams", "label", yes.alias("ask"), no.alias("told"), yes.alias("peer"))
    told = rows.select("cluster", F.explode(F.sequence(zero, F.col("ask_blocks") - 1)).alias("lo"), F.col("block").alias("hi"), "key", "grams", "label",
                       no.alias("ask"), yes.alias("told"), F.col("asks").alias("peer"))
    rest = stored(_verify(asking.unionByName(told), percent), "by-blocks")
    return found.unionByName(first).unionByName(rest)


def similar_sets(docs: DataFrame, grams_in_all: int, size: int = GRAM, percent: int = PERCENT, block: int = BLOCK, most_sets: int = SETS) -> DataFrame:
    """Links (a > b) between the keys of different sets that connect exactly what pairs of similar sets connect.

    ``grams_in_all``: about how many grams all documents hold.
    """
    spark, texts = docs.sparkSession, texts_of(docs).select("text")
    postings = stored(rare_first_postings(docs, grams_in_all, size, percent), "postings")
    clusters = stars(candidate_links(postings, percent, block))
    members = stored(clusters.select(F.col("a").alias("key"), F.col("b").alias("cluster")).union(clusters.select("b", "b").distinct()), "clusters")
    bits = spark.sparkContext.broadcast(_candidate_filter(members))
    found = texts.mapInArrow(_candidate_sets(bits, size), "key long, grams binary")
    sets = stored(members.join(found, "key").dropDuplicates(["key"]), "sets")
    return _verified_links(sets, percent, most_sets)


def similar_documents(docs: DataFrame, size: int = GRAM, percent: int = PERCENT, block: int = BLOCK, most_sets: int = SETS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``: the smallest doc_id reachable over links, its own included.

    Two documents link if the intersection of their sets of n-grams is at least ``percent`` of the union; equal sets always
    do. A text with fewer than ``size`` words is one gram; null texts and those without words have no grams and no links. Null
    ids are never the smallest unless all are null; repeated rows are rows of one component; no rows give no rows. Sets are
    told apart by 64-bit hashes.
    """
    rows = stored(texts_of(docs).mapInArrow(lambda b: _sets(b, size), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, key long"), "documents")
    classes = stored(rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first_id")), "classes")
    grams_in_all = rows.agg(F.sum("n_shingles")).first()[0] or 0
    linked = stars(similar_sets(docs, grams_in_all, size, percent, block, most_sets))
    roots = linked.select(F.col("a").alias("key"), F.col("b").alias("root")).union(linked.select("b", "b").distinct())
    smallest = classes.join(roots, "key").groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = classes.join(roots, "key", "left").join(smallest, "root", "left").select("key", F.coalesce("component_id", "first_id").alias("component_id"))
    alone = rows.where("key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined_by_key(rows, stored(named, "named"), "key").select("doc_id", "n_shingles", "component_id").unionByName(alone)
