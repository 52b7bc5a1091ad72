"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into two segments. Two fingerprints that differ in at most 2 bits differ in
at most 1 bit of the high segment or in none of the low one. So a table of the segments is probed with a
Hamming ball of radius 1 in the high segment and of radius 0 in the low one; what the table returns is
verified by the complete distance. Only distinct fingerprints are in the tables: copies are grouped before.

A segment value that more than `crowd` distinct fingerprints share is not expanded into pairs. There the
ball is enumerated in the other segment as well: two fingerprints within 2 bits share a midpoint within
1 bit of both, so each names the 65 values within 1 bit of itself and is linked to the least fingerprint
that names the same. This is exact too, and linear in the number of fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import slices, texts_of
from quarrymill.sources.tables import cut, gathered, parts_for

#: Tables of so many narrow rows are sent to all tasks, larger ones joined by a shuffle.
BROADCAST_ROWS = 100_000

LOW = 0xFFFFFFFF


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of a text, repeats included; fewer than `words` words are one shingle, none have none."""
    found = text.encode("utf-8").lower().split()  # bytes: A-Z alone is lowered, and exactly \x20 \x09-\x0D separate
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], dtype=np.uint64)


def majority(h: np.ndarray) -> int:
    """The fingerprint of hashes: a bit is 1 if it is set in over half of them. Of none, 0."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str, words: int = 3) -> int:
    """The fingerprint of one text; 0 without words."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """id and signed 64-bit fingerprint `fp` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8_000_000):
            values = np.array([fingerprint(t, words) for t in texts_of(batch)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values)], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp bigint")


def links(values: DataFrame, crowd: int = 64, parts: int = 8) -> DataFrame:
    """Pairs (a, b) with a != b of the distinct fingerprints in `values` (column fp), all at 2 bits at most.

    Any two fingerprints within 2 bits are joined by a path of such pairs; pairs in segment values
    of at most `crowd` fingerprints are all given. parts: in how many tasks crowded values are found.
    """
    low, high = F.col("fp").bitwiseAND(LOW), F.shiftrightunsigned("fp", 32)
    table = values.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("seg"), low.alias("key")), F.struct(F.lit(1).alias("seg"), high.alias("key")))).alias("e")).select("fp", "e.seg", "e.key")
    # crowded values are few, mostly none: found first, they spare the rest
    busy = gathered(table.groupBy("seg", "key").agg(F.count("*").alias("n")).where(F.col("n") > max(crowd, 1)).select("seg", "key"), parts)
    crowds = busy.count()
    small = F.broadcast if crowds <= BROADCAST_ROWS else lambda df: df
    # the low segment: equal values. Of each pair the smaller one probes.
    rest = table.join(small(busy), ["seg", "key"], "left_anti") if crowds else table
    by_low = rest.where("seg = 0")
    same = by_low.alias("x").join(by_low.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= 2))
    # the high segment: a ball of radius 1. A pair that differs there is met once, from the side that has a 0 in that bit.
    ball = values.select("fp", high.alias("high")).select("fp", F.explode(F.expr("concat(array(high), transform(filter(sequence(0, 31), i -> shiftright(high, i) & 1 = 0), i -> high | shiftleft(1L, i)))")).alias("key"), "high")
    heads = rest.where("seg = 1").select(F.col("fp").alias("other"), "key")
    near = ball.join(heads, "key").where((F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= 2) & ((F.col("key") != F.col("high")) | (F.col("fp") < F.col("other"))))
    found = same.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).union(near.select(F.col("fp").alias("a"), F.col("other").alias("b")))
    if not crowds:
        return found.distinct()
    # crowded values: the midpoints
    crowded = table.join(small(busy), ["seg", "key"], "left_semi").select("fp")
    # whoever can meet a fingerprint of a crowded value names its midpoints: for the high segment those within its ball too
    reach = ball.join(small(busy.where("seg = 1").select("key")), "key", "left_semi").select("fp")
    named = crowded.union(reach).distinct().select("fp", F.expr("explode(concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i))))").alias("mid"))
    least = named.groupBy("mid").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)  # 65 values at most have a midpoint in common
    middle = least.select(F.explode("all").alias("a"), "b").where("a != b")
    return found.union(middle).distinct()


def _both_ways(edges: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) and (b, a)."""
    ways = F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return edges.select(F.explode(ways).alias("e")).select("e.a", "e.b").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component: the least `rank` (with its node's label) that each node reaches.

    nodes: node, label; edges: a, b. Alternating large-star and small-star steps until nothing changes:
    each step is a group-by and a join, and the number of steps grows with the logarithm of the longest path.
    A node with very many links is split by the group-by's own partial sums: a step needs only minima. Of a small graph
    these are sent to all tasks, so a step has two shuffles of minima and one of links.
    """
    current = cut(_both_ways(edges))
    size = current.count()
    if not size:
        return nodes.select("node", F.col("node").alias("root"))
    while True:
        # large star: every larger neighbour goes to the least of the neighbourhood, itself included
        small = F.broadcast if size <= BROADCAST_ROWS else lambda df: df
        least = current.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = current.where("b > a").join(small(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        # small star: what is smaller or equal goes to the least smaller neighbour
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(small(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(low.select("a", F.col("m").alias("b")))
        after = gathered(_both_ways(star), parts_for(size))
        before, size = size, after.count()
        if before == size and current.exceptAll(after).isEmpty():
            break
        current = after
    roots = current.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, crowd: int = 64) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least id that links reach, itself included) of every row.

    Words are runs other than blanks and \\t-\\r, A-Z lowered; shingles of `words` words, repeats included;
    a text of fewer words is one shingle, one of none (null, empty) has fingerprint 0, linked like any other.
    Fingerprints link at 2 bits or fewer. Repeated rows give repeated results; a null id takes part as a
    document but never names a component unless all of its component are null. Columns besides id and text are not read.
    """
    prints = cut(fingerprints(docs, id_col, text_col, words))
    few = parts_for(prints.count())
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), few)
    edges = cut(links(distinct.select("fp"), crowd, few), few)
    touched = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    roots = components(touched, edges)
    joined = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = joined.join(names, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
