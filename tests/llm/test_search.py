"""Exact top-k search against brute force in whole numbers."""

import math
import random

from faultline.llm import topk_search


def brute(rows, every=50, k=5):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in {i: (i, q) for i, q in usable if i % every == 0}.values():
        found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in usable if j != i and len(v) == len(q))[:k]
        out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(found)}
    return out


def as_rows(df):
    return {tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(3)


def test_as_brute_force(spark):
    rng = random.Random(2)
    single = lambda: float(__import__("numpy").float32(rng.uniform(-1, 1)))
    rows = [(i, [single() for _ in range(8)]) for i in range(-100, 300)]
    rows += [(400, rows[3][1]), (401, rows[3][1]), (402, rows[3][1]), (450, None), (451, [1.0, None] + [0.0] * 6), (452, [float("nan")] * 8), (453, [float("inf")] + [0.0] * 7),
             (500, [1.0, 2.0]), (501, [1.0, 1.0]), (None, [0.5] * 8), (550, []), (551, [])]
    df = frame(spark, [(i, v, "clash") for i, v in rows])
    assert as_rows(topk_search.top_k_neighbours(df)) == brute(rows)


def test_blocks_and_tiles(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.randint(-3, 3) / 4 for _ in range(4)]) for i in range(500)]
    monkeypatch.setattr(topk_search, "TILE", 7)
    parts = topk_search.stored(topk_search.quantised(frame(spark, [(i, v, "") for i, v in rows]), "vec_id", "embedding"), "v")
    assert as_rows(topk_search.search(parts, parts.where("vec_id % 10 = 0"), 5, block=40)) == brute(rows, every=10)


def test_few_or_none(spark):
    df = frame(spark, [(0, [1.0], ""), (50, [2.0], ""), (1, [3.0], "")])
    assert as_rows(topk_search.top_k_neighbours(df)) == brute([(0, [1.0]), (50, [2.0]), (1, [3.0])])
    assert topk_search.top_k_neighbours(df.where("false")).count() == 0
    assert topk_search.top_k_neighbours(df.where("vec_id = 0")).count() == 0


def test_components_of_any_size(spark):
    """Scores within and beyond a long are ranked by their true values; shown ones end where a long does."""
    rng = random.Random(6)
    rows = [(i, [float(rng.choice([0, 1, -3, 2 ** 46, -2 ** 60, 2 ** 90, -2 ** 120]) * rng.choice([1, 1.5, 0.0078125])) for _ in range(3)]) for i in range(200)]
    rows += [(0, [2.0 ** 46, 1.0, 0.0]), (50, [1.0, 2.0, 0.0]), (203, [1.0, 1.0, 0.0])]
    held = lambda s: max(-(2 ** 63), min(2 ** 63 - 1, s))
    rows = list(dict(rows).items())
    for tile in (1024, 5):
        topk_search.TILE = tile
        got = as_rows(topk_search.top_k_neighbours(frame(spark, [(i, v, "") for i, v in rows])))
        topk_search.TILE = 1024
        assert got == {(*r[:3], held(r[3])) for r in brute(rows)}
    probe = frame(spark, [(0, [2.0 ** 46, 1.0], ""), (50, [1.0, 2.0], ""), (3, [1.0, 1.0], "")])
    assert as_rows(topk_search.top_k_neighbours(probe)) == brute([(0, [2.0 ** 46, 1.0]), (50, [1.0, 2.0]), (3, [1.0, 1.0])])


def test_scores_beyond_a_long_sort_by_bytes():
    values = sorted({s * (2 ** e + d) for s in (1, -1) for e in (63, 64, 71, 72, 200, 300) for d in (0, 1, 255)})
    low, high = ([v for v in values if (v > 0) == up] for up in (False, True))
    for side in (low, high):
        codes = [topk_search.beyond(v) for v in side]
        assert None not in codes and codes == sorted(codes)
    assert topk_search.beyond(2 ** 63 - 2) is None and topk_search.beyond(2 ** 63 - 1) is not None and topk_search.beyond(0) is None


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2 ** 40 + i * 2 ** 20), -float(2 ** 40)]) for i in range(0, 60)]
    got = topk_search.top_k_neighbours(frame(spark, [(i, v, "") for i, v in rows])).collect()
    assert len(got) == 10 and all(-(2 ** 63) <= r["score"] <= 2 ** 63 - 1 for r in got)
