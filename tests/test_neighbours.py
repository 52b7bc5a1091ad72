"""Nearest neighbours by cells, against all pairs."""

import numpy as np
import pandas as pd
import pytest

from quarrymill.operators import vectors


def data(spark, n=900, clusters=30, dims=8, seed=1):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(clusters, dims)) * 5
    x = middle[draw.integers(clusters, size=n)] + draw.normal(size=(n, dims)) * 0.3
    x[5] = x[6] = 0
    x[10:30] = x[9]  # ties by id
    rows = [(i, x[i].tolist(), "ab"[i % 2] if i % 50 else None) for i in range(n)]
    items = spark.createDataFrame(rows, "item_id long, ivec array<double>, kind string").repartition(4)
    asked = spark.createDataFrame([(i, v, kind) for i, v, kind in rows if i % 9 == 0 or i == 5], "query_id long, qvec array<double>, kind string")
    return x, rows, items, asked


def plain(x, rows, asked, k, by):
    unit = x / np.maximum(np.sqrt((x**2).sum(axis=1, keepdims=True)), 1e-300)
    out = set()
    for q in asked:
        near = sorted((round(float(d), 6) + 0.0, i) for i, d in enumerate(np.round(1 - unit @ unit[q[0]], 6)) if not by or (rows[i][2] == q[2] and q[2] is not None))
        out |= {(q[0], i, d, r + 1) for r, (d, i) in enumerate(near[:k])}
    return out


def got(df):
    return {(r["query_id"], r["item_id"], round(r["distance"], 6) + 0.0, r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("by", [None, "kind"])
@pytest.mark.parametrize("size, block, limit", [(20, 2048, 200_000), (300, 16, 200_000), (20, 64, 1)])
def test_the_nearest_are_those_of_all_pairs(spark, by, size, block, limit):
    x, rows, items, asked = data(spark)
    found = vectors.nearest(asked, items, k=7, by=by, size=size, block=block, limit=limit)
    assert got(found) == plain(x, rows, [tuple(r) for r in asked.select("query_id", "qvec", "kind").collect()], 7, by)


def test_few_items_or_none(spark):
    *_, items, asked = data(spark, n=40)
    assert vectors.nearest(asked, items.where("item_id < 3"), k=7).count() == 3 * asked.count()
    assert vectors.nearest(asked, items.where("false"), k=7).collect() == [] == vectors.nearest(asked.where("false"), items, k=7).collect()
    assert vectors.nearest(asked, items.where("item_id in (5, 6)"), k=1).select("distance").distinct().collect()[0][0] == 1.0


def test_most_cells_are_never_looked_into(spark):
    x, _, items, _ = data(spark, n=3000)
    found, centres = vectors.celled(items, None, 30)
    known = found.groupBy("cell").agg({"away": "max", "*": "count"}).toPandas()
    cells = vectors.Cells(centres, {None: (known["cell"].to_numpy(), known["max(away)"].to_numpy(), known["count(1)"].to_numpy())})
    asked = pd.Series([v.tolist() for v in x[100:200]])
    first, _ = vectors.cells_to_visit(asked, None, cells, 5)
    second, _ = vectors.cells_to_visit(asked, None, cells, 5, np.full(100, 0.001))
    assert 100 <= len(first) + len(second) < 0.25 * 100 * len(known)
