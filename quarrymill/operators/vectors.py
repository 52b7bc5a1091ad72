"""Nearest neighbours by cosine distance."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.sources.tables import cut


def checked(vectors: DataFrame, vec: str, size: int) -> DataFrame:
    """Vectors of `size` components: a null one becomes zeros, one of another length fails."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), size)
    ok = F.coalesce(F.col(vec), zero)
    return vectors.withColumn(vec, F.when(F.size(ok) == size, ok).otherwise(F.raise_error(F.lit(f"a vector does not have {size} components"))))


class Cells(NamedTuple):
    """Centres of unit length, and for each value of the metadata column the cells that have items: their numbers, radii and sizes.

    Cell -1 has the zero vectors, which are at distance 1 from everything.
    """

    centres: np.ndarray
    of: dict[object, tuple[np.ndarray, np.ndarray, np.ndarray]]


#: How many distances a task holds at once, and how many rows with their vectors it gives out at once.
AT_ONCE, ROWS = 2_000_000, 10_000


def _slices(n: int, width: int) -> Iterator[slice]:
    """Slices of n rows of which each has `width` distances."""
    each = max(1, AT_ONCE // max(1, width))
    return (slice(i, i + each) for i in range(0, n, each))


def _units(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Vectors at unit length, and which are zero."""
    x = np.array(vectors.tolist(), dtype=np.float64).reshape(len(vectors), -1)
    norms = np.sqrt((x**2).sum(axis=1, keepdims=True))
    return x / np.maximum(norms, 1e-300), norms[:, 0] == 0


def _apart(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors; twice the cosine distance is its square."""
    return np.sqrt(np.maximum(2 - 2 * (x @ centres.T), 0))


def celled(items: DataFrame, by: str | None, size: int = 256, most: int = 4096) -> tuple[DataFrame, np.ndarray]:
    """`items` (item_id, ivec, by) with the cell of the nearest centre and the distance to it, and the centres.

    Centres are items themselves, about one for `size` of them and `most` at most, chosen by a hash of their id.
    """
    n = items.count()
    chosen = items.where(F.exists("ivec", lambda v: v != 0)).orderBy(F.xxhash64("item_id"), "item_id").limit(max(1, min(most, n // size))).select("ivec").toPandas()
    centres = _units(chosen["ivec"])[0] if len(chosen) else np.zeros((0, 0))
    keys = [by] if by else []
    types = {f.name: f.dataType.simpleString() for f in items.schema.fields}

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            for some in _slices(len(whole), len(centres)):
                part = whole.iloc[some]
                x, zero = _units(part["ivec"])
                d = _apart(x, centres) if len(centres) else np.zeros((len(part), 1))
                cell = np.where(zero, -1, d.argmin(axis=1))
                yield part.assign(cell=cell.astype(np.int32), away=np.where(zero, 0.0, d.min(axis=1)))

    schema = ", ".join(f"{c} {types[c]}" for c in [*keys, "item_id", "ivec"]) + ", cell int, away double"
    return items.select(*keys, "item_id", "ivec").mapInPandas(assign, schema), centres


def cells_to_visit(vectors: pd.Series, by: pd.Series | None, cells: Cells, k: int, worst: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places of queries, cells): which cells each query looks into.

    First, without `worst`, those of the nearest centres until they have k items. Then, with the distance of the kth item
    found so far, all others that may have one as near: by the triangle inequality none of a cell is nearer than its
    centre less its radius. Distances are ranked by six places, so bounds are taken wider by that.
    """
    x, zero = _units(vectors)
    who, where = [], []
    for value, places in pd.Series(np.arange(len(x))).groupby(by.to_numpy() if by is not None else np.zeros(len(x))):
        known = cells.of.get(value if by is not None else None)
        if known is None:
            continue
        number, radius, size = known
        at = places.to_numpy()
        far = np.where(number < 0, 1.0, 0.0)[None, :].repeat(len(at), axis=0)
        real = number >= 0
        if real.any():
            far[:, real] = _apart(x[at], cells.centres[number[real]])
        order = np.argsort(far, axis=1, kind="stable")
        before = np.cumsum(size[order], axis=1) - size[order]
        first = np.zeros(far.shape, bool)
        np.put_along_axis(first, order, before < k, axis=1)
        if worst is None:
            chosen = first
        else:
            bound = np.where(real, np.maximum(far - radius, 0) ** 2 / 2, 1.0)
            bound[zero[at]] = 1.0
            chosen = ~first & (bound <= worst[at][:, None] + 2e-6)
        q, c = np.nonzero(chosen)
        who.append(at[q])
        where.append(number[c])
    return (np.concatenate(who), np.concatenate(where)) if who else (np.empty(0, int), np.empty(0, int))


def nearest(queries: DataFrame, items: DataFrame, k: int = 5, by: str | None = None, block: int = 2048, size: int = 256, limit: int = 200_000) -> DataFrame:
    """query_id, item_id, distance, rank of the k nearest items by cosine distance; ties by item_id. A zero vector is at distance 1.

    queries: query_id, qvec; items: item_id, ivec; by: a column of both that must agree; null agrees with nothing. Exact.
    Items are dealt into cells around centres. A query looks into the nearest cells first and then only into those that
    may have something as near as what it has found (see `cells_to_visit`); cells of other metadata are never met. Large
    cells are cut into blocks, and a task multiplies one block of items with one block of the queries that look into it.
    Cells are known to all tasks; if there were more than `limit` (many metadata values), each value is one cell.
    Distances are rounded to 6 places before ranking.
    """
    keys = [by] if by else []
    if by:
        queries, items = (df.where(F.col(by).isNotNull()) for df in (queries, items))
    found, centres = celled(items, by, size)
    found = cut(found)
    grouped = lambda df: df.groupBy(*keys, "cell").agg(F.max("away").alias("radius"), F.count("*").alias("n"))
    known = cut(grouped(found))
    if known.count() > limit:
        found, centres = found.withColumns({"cell": F.when(F.col("cell") < 0, -1).otherwise(0), "away": F.lit(2.0)}), centres[:1]
        known = cut(grouped(found))
    listed = known.toPandas()
    of = {value: (g["cell"].to_numpy(), g["radius"].to_numpy(), g["n"].to_numpy()) for value, g in (listed.groupby(by) if by else [(None, listed)]) if len(g)}
    cells = queries.sparkSession.sparkContext.broadcast(Cells(centres, of))
    parts = max(1, -(-queries.count() // block))
    blocks = known.select(*keys, "cell", F.ceil(F.col("n") / block).alias("blocks"))
    few = F.broadcast(blocks)  # at most `limit` cells
    on = [*keys, "cell", "blk", "part"]
    i = found.join(few, [*keys, "cell"]).withColumn("blk", F.pmod(F.xxhash64("item_id"), F.col("blocks"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(*on, "item_id", "ivec")
    types = {"query_id": queries.schema["query_id"].dataType.simpleString(), "item_id": items.schema["item_id"].dataType.simpleString()}
    shape = f"query_id {types['query_id']}, item_id {types['item_id']}, distance double"

    def inside(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": left["query_id"][:0], "item_id": right["item_id"][:0], "distance": np.zeros(0)})
        a, b = _units(left["qvec"])[0], _units(right["ivec"])[0]
        asked, ids, found = left["query_id"].to_numpy(), right["item_id"].to_numpy(), []
        for some in _slices(len(a), len(b)):
            d = np.round(1 - a[some] @ b.T, 6)
            order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :k]
            rows = np.repeat(np.arange(len(d)), order.shape[1])
            found.append(pd.DataFrame({"query_id": asked[some][rows], "item_id": ids[order.ravel()], "distance": d[rows, order.ravel()]}))
        return pd.concat(found)

    def wave(some: DataFrame) -> DataFrame:
        """What is found in the cells that each query looks into now; with a column `worst` the second time."""
        again = "worst" in some.columns

        def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            width = max((len(number) for number, _, _ in cells.value.of.values()), default=1)
            for whole in batches:
                for some in _slices(len(whole), width):
                    batch = whole.iloc[some]
                    who, where = cells_to_visit(batch["qvec"], batch[by] if by else None, cells.value, k, batch["worst"].fillna(np.inf).to_numpy() if again else None)
                    for at in range(0, len(who), ROWS):
                        yield batch.iloc[who[at : at + ROWS]][[*keys, "query_id", "qvec"]].assign(cell=where[at : at + ROWS].astype(np.int32))

        vec = some.schema["qvec"].dataType.simpleString()
        seen = some.mapInPandas(visits, ", ".join([*(f"{c} {some.schema[c].dataType.simpleString()}" for c in keys), f"query_id {types['query_id']}", f"qvec {vec}", "cell int"]))
        seen = seen.join(few, [*keys, "cell"]).withColumn("blk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
        return seen.select(*on, "query_id", "qvec").groupBy(*on).cogroup(i.groupBy(*on)).applyInPandas(inside, shape)

    ranked = Window.partitionBy("query_id").orderBy("distance", "item_id")  # k rows for each block that a query has met
    best = lambda rows: rows.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    base = queries.select(*keys, "query_id", "qvec")
    first = cut(best(wave(base)).drop("rank"))
    worst = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("distance")).alias("worst"))
    return best(first.unionByName(wave(base.join(worst, "query_id", "left"))))


def similarity_score(neighbours: DataFrame) -> DataFrame:
    """query_id, score = 1 / (1 + least distance)."""
    return neighbours.groupBy("query_id").agg((1 / (1 + F.min("distance"))).alias("score"))


def contrast_score(positive: DataFrame, negative: DataFrame, weight: float = 0.7) -> DataFrame:
    """query_id, score = max(0, best positive similarity - weight * best negative similarity); a side without neighbours is 0."""
    best = lambda n, name: n.groupBy("query_id").agg((1 - F.min("distance")).alias(name))
    both = best(positive, "p").join(best(negative, "n"), "query_id", "full")
    return both.select("query_id", F.greatest(F.coalesce("p", F.lit(0.0)) - weight * F.coalesce("n", F.lit(0.0)), F.lit(0.0)).alias("score"))


def upsert_id(name: str, kind: str, index: str, text: str) -> object:
    """The deterministic id of an example: SHA-256 of its name, kind, index and first 50 characters."""
    return F.sha2(F.concat_ws("-", F.col(name), F.col(kind), F.col(index), F.substring(F.col(text), 1, 50)), 256)


def upsert(stored: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of both; of equal keys, the new one."""
    values = [c for c in stored.columns if c != key]
    both = stored.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)))
    best = both.groupBy(key).agg(F.max_by(F.struct(*values), "__v").alias("r"))
    return best.select(key, *(F.col("r")[c].alias(c) for c in values))
