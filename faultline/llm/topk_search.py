"""Exact top-k search by tiled matrix products.

Queries go round in blocks of bounded size, all vectors pass by in shards. In a task a tile of queries times a tile of its
shard is one matrix product; of each tile the k best of every query are selected and merged into the task's running lists.
The lists of the tasks then meet in a tree: first in groups of tasks, then those of the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark import TaskContext

from faultline.llm.shared import stored

#: Queries that are broadcast at once (about 4 MB for 64 components); rows of a tile on either side; groups of tasks.
QUERIES, TILE, GROUPS = 8192, 1024, 64
EXACT = 2 ** 52
#: Queries with a component beyond this go in tiles of their own, so that they alone take the exact way.
USUAL = 2.0 ** 20
LOWEST, HIGHEST = -(2 ** 63), 2 ** 63 - 1


def quantised(vectors: DataFrame, id_column: str, vector_column: str, scale: int = 256) -> DataFrame:
    """id and components floor(scale * x) of the vectors that have no null and no non-finite component."""
    def whole(x):
        scaled = F.lit(float(scale)) * x.cast("double")
        return F.when(F.abs(scaled) >= 2.0 ** 52, scaled).otherwise(F.floor(scaled).cast("double"))  # such a double has no fraction

    parts = F.transform(F.col(vector_column), whole)
    finite = F.forall(F.col(vector_column), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(F.lit(float(scale)) * x.cast("double")) < float("inf")))
    return vectors.where(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull()).where(finite).select(F.col(id_column).alias("vec_id"), parts.alias("parts"))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the rows of each length, by id."""
    ids, lists = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("parts")
    sizes, flat, at = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False), 0
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        at = at[np.argsort(ids[at], kind="stable")]
        yield ids[at], flat[starts[at][:, None] + np.arange(size)]


def _whole(m: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in m], object).reshape(m.shape)


def beyond(score: int) -> bytes | None:
    """For a score at or beyond the ends of a long: bytes that sort as the scores do; else null."""
    if LOWEST < score < HIGHEST:
        return None
    size = (abs(score).bit_length() + 7) // 8
    code = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return code if score > 0 else bytes(255 - b for b in code)


def best_of_tile(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, ids, valid) of each query's k best; ``ids`` ascend, so of equal scores the first ones win.

    Products beyond what doubles hold exactly are taken in whole numbers of any size.
    """
    bound = (np.abs(q).max(initial=0) * np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if bound * len(ids) < EXACT:
        scores = (q @ x.T).astype(np.int64)
    else:
        scores = _whole(q) @ _whole(x).T if q.shape[1] else np.zeros((len(q), len(ids)), object)
    own = q_ids[:, None] == ids[None, :]
    k = min(k, len(ids))
    if bound * len(ids) < EXACT:
        key = scores * len(ids) + np.arange(len(ids) - 1, -1, -1)
        key[own] = LOWEST
        at = np.argpartition(key, len(ids) - k, axis=1)[:, len(ids) - k:]
    else:
        at = np.array([sorted(range(len(ids)), key=lambda j: (mine[j], -row[j], j))[:k] for row, mine in zip(scores, own, strict=True)], np.int64).reshape(len(q), k)
    take = lambda m: np.take_along_axis(m, at, axis=1)
    return take(scores), ids[at], ~take(own)


def search(vectors: DataFrame, queries: DataFrame, k: int, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: of every query the ``k`` vectors with the largest inner product, ties to the smaller id.

    Both tables: vec_id, parts (whole numbers as doubles), stored. The vector with the query's own id is no candidate;
    repeated rows of a query are one query; repeated rows of other vectors are candidates each. Only vectors of the query's
    length are compared. Scores are ranked by their true values; those beyond a long are shown as its ends. No queries or no
    vectors give no rows.
    """
    spark = vectors.sparkSession
    queries = queries.dropDuplicates(["vec_id"])
    rounds = max(1, -(-2 * queries.count() // block))
    paths: list[str] = []
    for n in range(rounds):
        here = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == n).limit(block + 1).toArrow()
        if here.num_rows > block:
            raise RuntimeError("a block of queries is larger than its bound")
        sent = spark.sparkContext.broadcast([x for b in here.combine_chunks().to_batches() for x in _rows(b)])
        lists = vectors.mapInArrow(_best(sent, k), "shard int, query_id long, vec_id long, score long, beyond binary")
        order = [F.desc("score"), F.desc_nulls_last("beyond"), F.asc("vec_id")]
        for group in (["query_id", F.col("shard") % GROUPS], ["query_id"]):
            lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)
        result = lists.select("query_id", "rank", "vec_id", "score")
        if rounds == 1:
            return result
        paths += {f.rsplit("/", 1)[0] for f in stored(result, "top").inputFiles()}
    return spark.read.schema(result.schema).parquet(*paths)  # one read, however many rounds


def _merged(a: tuple, b: tuple, k: int) -> tuple:
    """The ``k`` best of two lists (scores, ids, valid) of the same queries."""
    both = tuple(np.concatenate([m, n], axis=1) for m, n in zip(a, b, strict=True))
    if both[0].dtype == object:
        at = np.array([sorted(range(len(s)), key=lambda j: (not v[j], -s[j], i[j]))[:k] for s, i, v in zip(*both)], np.int64)
    else:
        at = np.lexsort((both[1], ~both[0], ~both[2]), axis=1)[:, :k]
    return tuple(np.take_along_axis(m, at, axis=1) for m in both)


def _best(sent, k: int):
    def work(batches: Iterator[pa.RecordBatch]):
        tiles = []
        for ids, q in sent.value:
            usual = np.abs(q).max(axis=1, initial=0) < USUAL
            for some in (usual, ~usual):
                tiles += [(ids[some][a:a + TILE], q[some][a:a + TILE]) for a in range(0, int(some.sum()), TILE)]
        lists: list = [None] * len(tiles)
        for batch in batches:
            for all_ids, all_x in _rows(batch):
                usual = np.abs(all_x).max(axis=1, initial=0) < USUAL
                for ids, x in ((all_ids[some], all_x[some]) for some in (usual, ~usual)):
                    for a in range(0, len(ids), TILE):
                        for t, (q_ids, q) in enumerate(tiles):
                            if q.shape[1] == x.shape[1]:
                                new = best_of_tile(q_ids, q, ids[a:a + TILE], x[a:a + TILE], k)
                                lists[t] = new if lists[t] is None else _merged(lists[t], new, k)
        shard = TaskContext.get().partitionId()
        for (q_ids, _), found in zip(tiles, lists, strict=True):
            if found is not None:
                scores, ids, valid = found
                asked, scores = np.broadcast_to(q_ids[:, None], ids.shape)[valid], scores[valid]
                over = [None] * len(asked) if scores.dtype != object else [beyond(s) for s in scores]
                shown = scores if scores.dtype != object else np.array([max(LOWEST, min(HIGHEST, s)) for s in scores], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(asked), shard, np.int32)), *(pa.array(c.astype(np.int64)) for c in (asked, ids[valid], shown)), pa.array(over, pa.binary())],
                                                 names=["shard", "query_id", "vec_id", "score", "beyond"])
    return work


def top_k_neighbours(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """The ``k`` best for each vector whose vec_id ``every`` divides; vectors from ``embedding``, see ``search``.

    Vectors that are null or hold a null or non-finite component take no part, neither as query nor as candidate; nor do rows
    without an id, and vectors of doubles that ``scale`` takes beyond the largest double. Finite components may be of any size.
    """
    parts = stored(quantised(vectors, "vec_id", "embedding", scale), "vectors")
    return search(parts, parts.where(F.col("vec_id") % every == 0), k)
