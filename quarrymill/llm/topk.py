"""Exact top-k search by ball-tree branch and bound.

Vectors are dealt to shards of bounded size by a hash. A shard's task builds one ball tree of its vectors and lets the
queries stream through it, batch by batch. A node with centre c and radius r has no vector whose product with a query q
exceeds q.c + |q| r. A query goes down from the root only into nodes whose bound reaches its current kth score, and
visits leaves in the order of their bounds. The kth score is shared in waves: the first searches one shard for each
query, the next a few more, the last all the others; what a query has found so far is the score to beat.

Products are exact: of 64-bit floats where no sum can pass 2**53, of 64-bit integers where none can pass 2**62, and of
integers of any size otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.sources.tables import cut

LEAF = 128
#: Below every score.
LOWEST = -(1 << 190)
_MOST, _LEAST = 2**63 - 1, -(2**63)
_RESULT = "row bigint, query_id bigint, copies bigint, id bigint, times bigint, score bigint, exact binary"


def exact_bytes(score: int) -> bytes | None:
    """A score beyond 64 bits as bytes in the order of the scores; None for any other."""
    return None if _LEAST < score < _MOST else (score + (1 << 191)).to_bytes(24, "big")


def exact_score(score: int, exact: bytes | None) -> int:
    return score if exact is None else int.from_bytes(exact, "big") - (1 << 191)


class BallTree:
    """A ball tree over rows of integers. Equal rows are one point with several ids, ascending, each so many times."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, times: np.ndarray | None = None, leaf: int = LEAF):
        times = np.ones(len(ids), np.int64) if times is None else times
        order = np.lexsort((ids, *rows.T[::-1]))
        self.ids, rows, self.times = ids[order], rows[order], times[order]
        new = np.ones(len(ids), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        self.first = np.append(np.flatnonzero(new), len(ids))
        self.points = rows[new]
        self.order = np.arange(len(self.points))
        self.nodes: list[tuple[int, int, int, int]] = []  # (begin, end, left child, right child); leaves have children -1
        centres: list[np.ndarray] = []
        radii: list[float] = []
        self._grow(self.points.astype(np.float64), leaf, centres, radii)
        self.points = self.points[self.order]
        self.most = float(np.abs(self.points.astype(np.float64)).max(initial=0.0))
        self.forms: dict[type, np.ndarray] = {}
        self.centre, self.radius = np.array(centres).reshape(len(self.nodes), -1), np.array(radii)
        self.reach = np.sqrt((self.centre**2).sum(axis=1)) + self.radius

    def _grow(self, points: np.ndarray, leaf: int, centres: list[np.ndarray], radii: list[float]) -> None:
        todo = [(0, len(points), -1, 0)]
        while todo:
            begin, end, parent, side = todo.pop()
            at = self.order[begin:end]
            own = points[at]
            centre = own.mean(axis=0)
            far = ((own - centre) ** 2).sum(axis=1)
            me = len(self.nodes)
            self.nodes.append((begin, end, -1, -1))
            centres.append(centre)
            radii.append(float(np.sqrt(far.max())))
            if parent >= 0:
                b, e, left, right = self.nodes[parent]
                self.nodes[parent] = (b, e, me, right) if side == 0 else (b, e, left, me)
            if end - begin <= leaf:
                continue
            one = own[far.argmax()]
            other = own[((own - one) ** 2).sum(axis=1).argmax()]
            # points in the order of their place on the line between two far ones, cut in the middle
            self.order[begin:end] = at[np.argsort(own @ (other - one), kind="stable")]
            middle = (begin + end) // 2
            todo += [(begin, middle, me, 0), (middle, end, me, 1)]

    def _as(self, kind: type) -> np.ndarray:
        if kind not in self.forms:
            self.forms[kind] = self.points.astype(kind)
        return self.forms[kind]

    def search(self, queries: np.ndarray, own_ids: np.ndarray, k: int, floor: list[int]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """(query, its up to k best candidates as (-score, id, times)): a row equal to the query, of its id, counts once less.

        floor: a score of each query; what scores less isn't wanted.
        """
        size = np.abs(queries.astype(np.float64)).max(initial=0.0) * self.most * max(1, queries.shape[1])
        kind = np.float64 if size < 2.0**53 else np.int64 if size < 2.0**62 else object
        q, points = queries.astype(kind), self._as(kind)
        qf = queries.astype(np.float64)
        norm = np.sqrt((qf**2).sum(axis=1))
        kth = list(floor)
        near = np.array([float(x) for x in kth])
        best: list[list[tuple[int, int, int]]] = [[] for _ in kth]
        # bounds are sums in floating point: the slack is far above their error
        slack = lambda who, node: 1e-9 * norm[who] * self.reach[node] + 1e-9 * np.abs(near[who]) + 1e-6
        # down the tree, level by level: pairs of a query and a node whose bound reaches the floor
        who, node = np.arange(len(q)), np.zeros(len(q), np.int64)
        leaves_q, leaves_n, leaves_b = [], [], []
        child = np.array([n[2:] for n in self.nodes])
        while len(who):
            bound = np.einsum("ij,ij->i", qf[who], self.centre[node]) + norm[who] * self.radius[node]
            ok = (near[who] < -1e57) | (bound + slack(who, node) >= near[who])
            who, node, bound = who[ok], node[ok], bound[ok]
            leaf = child[node, 0] < 0
            leaves_q.append(who[leaf])
            leaves_n.append(node[leaf])
            leaves_b.append(bound[leaf])
            who, node = np.repeat(who[~leaf], 2), child[node[~leaf]].ravel()
        lq, ln, lb = np.concatenate(leaves_q), np.concatenate(leaves_n), np.concatenate(leaves_b)
        # each query's leaves by falling bound; wave i takes the ith leaf of every query that still has one in reach
        order = np.lexsort((-lb, lq))
        lq, ln, lb = lq[order], ln[order], lb[order]
        start = np.searchsorted(lq, np.arange(len(q)))
        count = np.bincount(lq, minlength=len(q))
        live, wave = np.flatnonzero(count > 0), 0
        while len(live):
            at = start[live] + wave
            ok = (near[live] < -1e57) | (lb[at] + slack(live, ln[at]) >= near[live])
            live, at = live[ok], at[ok]
            if not len(live):
                break
            by = np.argsort(ln[at], kind="stable")
            groups = np.flatnonzero(np.diff(ln[at][by], prepend=-1))
            for a, b in pairwise([*groups.tolist(), len(by)]):
                rows = live[by[a:b]]
                begin, end = self.nodes[ln[at][by[a]]][:2]
                scores = q[rows] @ points[begin:end].T
                for r, s in zip(rows.tolist(), scores, strict=True):
                    self._take(r, s, begin, int(own_ids[r]), queries[r], k, best, kth, near)
            wave += 1
            live = live[count[live] > wave]
        yield from enumerate(best)

    def _take(self, r: int, scores: np.ndarray, begin: int, own: int, query: np.ndarray, k: int, best: list, kth: list[int], near: np.ndarray) -> None:
        limit = kth[r] if scores.dtype == object else near[r] if scores.dtype == np.float64 else max(_LEAST, min(_MOST, kth[r]))
        good = np.flatnonzero(scores >= limit)
        if len(good) > k + 1:  # a point has a row at least, but for the query's own
            least = np.partition(scores[good], len(good) - k - 1)[len(good) - k - 1]
            good = good[scores[good] >= least]
        if not len(good):
            return
        found = best[r]
        for p in good.tolist():
            point = self.order[begin + p]
            a, b = int(self.first[point]), int(self.first[point + 1])
            for i, n in zip(self.ids[a : min(b, a + k + 1)].tolist(), self.times[a : min(b, a + k + 1)].tolist(), strict=True):
                if i == own and np.array_equal(self.points[begin + p], query):
                    n -= 1
                if n:
                    found.append((-int(scores[p]), i, min(n, k)))
        found.sort()
        rows = 0
        for end, (score, _, n) in enumerate(found, 1):
            rows += n
            if rows >= k:
                del found[end:]
                if -score > kth[r]:
                    kth[r], near[r] = -score, float(-score)
                break


def quantized(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", factor: int = 64) -> DataFrame:
    """id and v (array of bigint: floor(factor * x), x as double) of the rows whose vector has no null or non-finite component.

    A component beyond 64 bits is the greatest or least number that 64 bits hold.
    """
    x = F.transform(F.col(vec_col), lambda e: e.cast("double"))
    good = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = table.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), x.alias("x"), good.alias("good")).where("good")
    return rows.select("id", F.transform("x", lambda e: F.floor(e * F.lit(float(factor)))).alias("v"))


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def _found(batch: pa.RecordBatch, tree: BallTree, width: int, k: int) -> pa.RecordBatch:
    """The candidates that a batch of queries finds in a tree."""
    columns = {c: batch.column(c).to_pylist() for c in ("row", "id", "copies", "score", "exact")}
    floor = [LOWEST if s is None else exact_score(s, e) for s, e in zip(columns["score"], columns["exact"], strict=True)]
    out: list[tuple] = []
    for r, found in tree.search(_matrix(batch, width), np.array(columns["id"], dtype=np.int64), k, floor):
        mine = columns["row"][r], columns["id"][r], columns["copies"][r]
        out += [(*mine, i, n, max(_LEAST, min(_MOST, -s)), exact_bytes(-s)) for s, i, n in found]
    kinds = [pa.int64()] * 6 + [pa.binary()]
    names = [x.split()[0] for x in _RESULT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], kind) for c, kind in enumerate(kinds)], names)


def _cells(k: int, batch_rows: int = 1024):
    """Over rows sorted by cell, a cell's vectors before its queries: builds the cell's tree, then searches it for each batch of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, tree, waiting = None, None, []
        for whole in batches:
            keys = list(zip(*(whole.column(c).to_pylist() for c in ("width", "shard", "block", "asks")), strict=True))
            starts = [i for i, key in enumerate(keys) if i == 0 or key != keys[i - 1]]
            for a, b in pairwise([*starts, len(keys)]):
                part, asks = whole.slice(a, b - a), keys[a][3]
                if keys[a][:3] != cell:
                    cell, tree, waiting = keys[a][:3], None, []
                if not asks:
                    waiting.append((part.column("id").to_numpy(), _matrix(part, cell[0]), part.column("copies").to_numpy()))
                    continue
                if waiting:
                    tree, waiting = BallTree(*(np.concatenate(x) for x in zip(*waiting, strict=True))), []
                if tree is not None:
                    for i in range(0, part.num_rows, batch_rows):
                        yield _found(part.slice(i, batch_rows), tree, cell[0], k)

    return run


def top_k(table: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", factor: int = 64, shard_rows: int = 8192, block_rows: int = 1_000_000, waves: tuple[int, ...] = (1, 8)) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer products of each query, ties to the smaller id.

    Queries are the rows whose id is divisible by `every`; candidates are all rows but the query's own. Rows count each,
    also those that repeat an id or a whole row: each of two equal query rows has the other among its candidates, and
    its own k results. Vectors that are null or have null or non-finite components take no part, nor have rows of a null
    id. Vectors of different lengths have no product; an empty vector scores 0 with every other empty one. Scores are
    ranked exactly; one that 64 bits can't hold is given as the greatest or least number that they hold. Other columns
    are not read.

    Shards have some `shard_rows` distinct rows, so a task holds one tree and a batch of queries. `waves`: how many shards
    each query has seen after the first, second, ... wave; the last one after these sees the rest. Beyond `block_rows`,
    the queries of a shard are dealt to several tasks, each with a tree of its own.
    """
    rows = quantized(table, id_col, vec_col, factor).groupBy("id", "v").agg(F.count("*").alias("copies"))
    rows = cut(rows.select(F.monotonically_increasing_id().alias("row"), "id", "v", "copies", F.size("v").alias("width")))
    n, asked = rows.agg(F.count("*"), F.count(F.when(F.col("id") % every == 0, 1))).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-asked // block_rows))
    candidates = rows.select("width", F.pmod(F.xxhash64("id", "v", F.lit(1)), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(False).alias("asks"), "row", "id", "copies", "v", F.lit(None).cast("long").alias("score"), F.lit(None).cast("binary").alias("exact"))
    queries = rows.where(F.col("id") % every == 0).select("width", "row", "id", "copies", "v", F.pmod(F.xxhash64("id", "v", F.lit(2)), F.lit(shards)).alias("home"), F.pmod(F.xxhash64("id", "v", F.lit(3)), F.lit(blocks)).alias("block"))
    order = [F.col("score").desc(), F.col("exact").desc(), F.col("id")]

    def wave(asking: DataFrame, begin: int, end: int) -> DataFrame:
        """What the queries find in the shards number begin to end - 1 from their home shard on."""
        sent = asking.withColumn("step", F.explode(F.sequence(F.lit(begin), F.lit(end - 1))))
        sent = sent.select("width", F.pmod(F.col("home") + F.col("step"), F.lit(shards)).alias("shard"), "block", F.lit(True).alias("asks"), "row", "id", "copies", "v", "score", "exact")
        # a cell's tree is the work, not its bytes: as many partitions as keep cells apart
        parts = min(20_000, 2 * shards * blocks)
        dealt = sent.unionByName(candidates).repartition(parts, "width", "shard", "block").sortWithinPartitions("width", "shard", "block", "asks")
        return dealt.mapInArrow(_cells(k), _RESULT)

    def best(found: DataFrame) -> DataFrame:
        """The k best rows of each query, each candidate as often as it stands for rows."""
        each = found.select("row", "query_id", "copies", "id", "score", "exact", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("time"))
        return each.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*order))).where(F.col("rank") <= k)

    found, seen = None, 0
    for end in sorted({min(x, shards) for x in (*waves, shards)}):
        asking = queries.withColumns({"score": F.lit(None).cast("long"), "exact": F.lit(None).cast("binary")})
        if found is not None:
            kth = best(found).where(F.col("rank") == k).select(F.col("row").alias("of"), "score", "exact")
            asking = queries.join(kth, F.col("row") == F.col("of"), "left").drop("of")
        more = wave(asking, seen, end)
        more = more if end == shards else cut(more)
        found, seen = more if found is None else found.union(more), end
    ranked = best(found)
    if k > 0:
        ranked = ranked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
