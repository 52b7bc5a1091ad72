import math

import numpy as np
import pytest

from quarrymill.llm import topk


def brute(rows, every, k):
    good = [(i, tuple(max(-(2**63), min(2**63 - 1, math.floor(64 * x))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(good):
        if i % every == 0:
            scores = sorted(((-sum(x * y for x, y in zip(q, c, strict=True)), j) for b, (j, c) in enumerate(good) if a != b and len(c) == len(q)))
            out += [(i, r, j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def found(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("shard,block,k", [(8192, 8192, 20), (37, 5, 20), (50, 1000, 3), (1, 1, 2)])
def test_against_brute_force(spark, shard, block, k):
    rng = np.random.default_rng(shard)
    n = 60 if shard == 1 else 400
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 6)]) for i in range(n)]
    rows += [(n + i, [0.25] * 6) for i in range(30)]  # one vector many times: ties
    rows += [(1000, None), (1001, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (1020, [float("nan")] + [0.0] * 5), (1040, [float("inf")] + [0.0] * 5), (None, [0.5] * 6), (1060, [0.0] * 6), (1060, [0.0] * 6)]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, label int, shard int")
    assert found(topk.top_k(table, k=k, shard_rows=shard, block_rows=block)) == brute(rows, 20, k)


def test_empty_and_alone(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema)).collect() == []
    assert topk.top_k(spark.createDataFrame([(20, [1.0])], schema)).collect() == []


def test_tree_prunes_and_is_exact():
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.integers(-5, 5, (300, 8)) + 40 * np.eye(8, dtype=int)[g] for g in range(8)])
    tree = topk.BallTree(np.arange(len(points)), points, leaf=16)
    q = points[:50]
    for r, got in tree.search(q, np.arange(50), 5, [topk.LOWEST] * 50):
        all_ = points @ q[r]
        assert got == sorted((int(-s), i, 1) for i, s in enumerate(all_) if i != r)[:5]


def test_rows_count_each(spark):
    rows = [(20, [1.0, 1.0]), (20, [2.0, 2.0]), (20, [1.0, 1.0]), (21, [1.0, 3.0]), (21, [1.0, 3.0]), (21, [1.0, 3.0]), (40, [0.0, 0.0]), (41, [1.0, 1.0])] + [(60, [0.5, 0.5])] * 30
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in (2, 20):
        assert found(topk.top_k(table, k=k, shard_rows=2)) == brute(rows, 20, k)


@pytest.mark.parametrize("scale", [3e5, 3e7, 1e13, 1e17, 1e300])
def test_products_are_exact_at_any_size(spark, scale):
    rng = np.random.default_rng(3)
    rows = [(i, (np.sign(v) * scale + np.round(v * 64) / 64).tolist()) for i, v in enumerate(rng.normal(0, 8, (120, 3)))]
    rows += [(200 + i, [scale, scale + i / 64, -scale]) for i in range(8)] + [(300, [0.25, 0.5, 0.125]), (320, [1e-3, 0.0, -1e-3])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(topk.top_k(table, k=7, shard_rows=40)) == brute(rows, 20, 7)


def test_vectors_of_other_lengths_are_apart(spark):
    rows = [(i, [0.1 * i] * (i % 4)) for i in range(100)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(topk.top_k(table, every=5, k=3, shard_rows=10)) == brute(rows, 5, 3)
