"""Near copies: texts whose sets of word shingles have a Jaccard similarity of at least a share.

Texts of equal sets are grouped first. Of the others, pairs are proposed, then compared by their complete sets, which decide.

Proposals come from SimHash: texts whose fingerprints (of the distinct 5-word shingles here) `simhash.links` joins, or that
have one fingerprint; of each fingerprint, the text of the least label meets the others. At 2 bits these are the closest
copies. More come from MinHash, and are compared by the complete distance of their fingerprints first: texts that have all `rows` minima of one of `bands` bands in common share a bucket. With 25
bands of 4, a pair at 0.8 shares no bucket with probability (1 - 0.8^4)^25 < 2e-6, a likelier pair less often. Segments
of a SimHash can't propose them: at a similarity of 0.8 each bit differs with probability arccos(8/9) / pi = 0.151, so
10 of 64 bits do on average, and a segment that is long enough to tell texts apart is hardly ever equal (32 bits: 0.5 %,
within a ball of radius 1: 3.6 %, so some 360 segments and 6,000 keys a text would be needed for the same certainty).

A bucket of more than `crowd` sets isn't expanded into pairs at once. A set that links to any other has enough shingles
that others have too: at least share / (1 + share) of both sizes together. So the sets of crowded buckets count how many
of their shingles occur twice or more among all of them; those with too few leave. The others are compared with one of
their bucket, the hub, whose shingles are the most common - in a group of near copies one closest to what was copied -
and note which of its shingles they have. Two that a path of links doesn't join then have, at most, the hub's shingles
that both have and the fewer of the common ones that either has beside. Only if that is enough are they compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import give_back, slices, texts_of
from quarrymill.llm.simhash import BROADCAST_ROWS, components, links, majority, shingle_hashes
from quarrymill.sources.tables import cut, gathered, parts_for

#: Two sets of MANY shingles or more that are 0.8 alike have fingerprints that differ in more than FAR bits with
#: probability below 1e-6; two that have nothing in common are so near with probability 0.2.
FAR, MANY = 28, 64


def shingles(text: str, words: int = 5) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    return np.unique(shingle_hashes(text, words))


@lru_cache(maxsize=4)
def _factors(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(2025)).integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)


def bucket_keys(hashes: np.ndarray, bands: int = 25, rows: int = 4) -> list[int]:
    """A signed 64-bit key for each band; none for the empty set."""
    if not len(hashes):
        return []
    factors = _factors(bands * rows)
    least = np.full(bands * rows, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 4096):
        least = np.minimum(least, np.multiply.outer(factors, hashes[i : i + 4096]).min(axis=1))
    keys = [xxhash.xxh64_intdigest(least[i * rows : (i + 1) * rows].tobytes(), i) for i in range(bands)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def mark(text: Column) -> Column:
    """A hash of a text; null counts as empty. With the id it tells rows apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _label(hashes: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(hashes.tobytes(), 7)], dtype=np.uint64).view(np.int64)[0])


def _prints(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """id, mark, label of the set, its size n, its fingerprint fp and its bucket keys, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t, words) for t in texts_of(batch)]
            columns = [batch.column("id"), batch.column("mark"), pa.array([_label(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
            columns += [pa.array(np.array([majority(s) for s in sets], dtype=np.uint64).view(np.int64)), pa.array([bucket_keys(s, bands, rows) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "mark", "label", "n", "fp", "keys"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, mark bigint, label bigint, n bigint, fp bigint, keys array<bigint>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """label and the set's hashes, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500_000):
            sets = [shingles(t, words) for t in texts_of(batch)]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            hashes = pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([_label(s) for s in sets], pa.int64()), hashes], ["label", "hashes"])

    return docs.mapInArrow(run, "label bigint, hashes array<bigint>")


def _alike(pairs: DataFrame, sets: DataFrame, share: float, parts: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough."""
    joined = pairs.join(sets.select(F.col("label").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("label").alias("b"), F.col("hashes").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return cut(joined.select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).alias("sizes")).where(F.col("both") >= share * (F.col("sizes") - F.col("both")) - 1e-9).select("a", "b"), parts)


def _pairs(members: DataFrame, condition: Column | str, share: float) -> DataFrame:
    """The pairs (a, b), some repeated, of members p and q of a bucket that meet the condition and whose sizes and fingerprints allow the share."""
    p, q = (members.select("key", *(F.col(c).alias(f"{s}_{c}") for c in members.columns if c != "key")) for s in "pq")
    sizes = F.least("p_n", "q_n") >= F.greatest("p_n", "q_n") * share - 1e-9
    near = F.bit_count(F.col("p_fp").bitwiseXOR(F.col("q_fp"))) <= FAR if share >= 0.8 else F.lit(True)
    return p.join(q, "key").where(F.expr("p_label < q_label") & sizes & (near | (F.least("p_n", "q_n") < MANY)) & condition).select(F.col("p_label").alias("a"), F.col("q_label").alias("b"))


def _by_print(distinct: DataFrame, parts: int) -> DataFrame:
    """The pairs (a, b) that fingerprints propose: those of one fingerprint with the first of it, and the firsts of linked ones."""
    firsts = gathered(distinct.groupBy("fp").agg(F.min("label").alias("label"), F.count("*").alias("n")), parts)
    repeated = firsts.where("n > 1").select("fp", F.col("label").alias("a"))
    small = F.broadcast if repeated.count() <= BROADCAST_ROWS else lambda df: df
    same = distinct.select("fp", F.col("label").alias("b")).join(small(repeated), "fp").where("a < b").select("a", "b")
    p, q = (firsts.select(F.col("fp").alias(f"{s}_fp"), F.col("label").alias(s)) for s in "pq")
    linked = gathered(links(firsts.select("fp"), parts=parts).select(F.col("a").alias("p_fp"), F.col("b").alias("q_fp")), parts)
    small = F.broadcast if linked.count() <= BROADCAST_ROWS else lambda df: df
    near = q.join(small(p.join(small(linked), "p_fp")), "q_fp")
    return same.union(near.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))).distinct()


def _common(sets: DataFrame) -> DataFrame:
    """label, common (shingles that another of the sets has too) and often (in how many of the sets its common shingles are, added up)."""
    each = sets.select("label", F.explode("hashes").alias("s"))
    often = each.groupBy("s").agg(F.count("*").alias("often")).where("often > 1")
    return each.join(often, "s").groupBy("label").agg(F.count("*").alias("common"), F.sum("often").alias("often"))


def _framed(stars: DataFrame, sets: DataFrame) -> DataFrame:
    """hub, label, size (of the hub), n (of the set), both (shingles that the hub and the set have) and words: a bit for each shingle of the hub, 1 if the set has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (h, hs), (x, xs) = ((c.flatten().to_numpy().view(np.uint64), np.cumsum([0, *pc.list_value_length(c).to_pylist()])) for c in (batch.column("h"), batch.column("x")))
            both, words = [], []
            for i in range(batch.num_rows):
                own, other = h[hs[i] : hs[i + 1]], x[xs[i] : xs[i + 1]]
                has = other[np.minimum(np.searchsorted(other, own), len(other) - 1)] == own
                both.append(int(has.sum()))
                words.append(np.packbits(np.append(has, np.zeros(-len(has) % 64, bool))).view(np.int64))
            ends = np.cumsum([0, *map(len, words)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("hub"), batch.column("label"), pa.array(np.diff(hs), pa.int64()), pa.array(np.diff(xs), pa.int64()), pa.array(both, pa.int64()), pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, np.int64), *words]))], ["hub", "label", "size", "n", "both", "words"])
        give_back()

    joined = stars.join(sets.select(F.col("label").alias("hub"), F.col("hashes").alias("h")), "hub").join(sets.select("label", F.col("hashes").alias("x")), "label")
    return joined.select("hub", "label", "h", "x").mapInArrow(run, "hub bigint, label bigint, size bigint, n bigint, both bigint, words array<bigint>")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, share: float = 0.8, bands: int = 25, rows: int = 4, crowd: int = 8, broadcast_rows: int = 1_000_000) -> DataFrame:
    """id, mark (of the text) and component of every row: rows that a path of links joins have equal components.

    What is known of each crowded bucket is broadcast if there are `broadcast_rows` of them at most, so that a bucket
    of very many rows isn't one task's key; else it is joined by a shuffle.
    """
    prints, roots, _ = _found(docs, id_col, text_col, words, share, bands, rows, crowd, broadcast_rows)
    return prints.join(roots, F.col("label") == F.col("node")).select("id", "mark", F.col("root").alias("component"))


def _found(docs: DataFrame, id_col: str, text_col: str, words: int, share: float, bands: int, rows: int, crowd: int, broadcast_rows: int) -> tuple[DataFrame, DataFrame, int]:
    """id, mark and label of every row; node (a label) and root of every label; how many partitions such tables are worth."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), mark(F.col(text_col)).alias("mark"))
    prints = cut(_prints(texts, words, bands, rows))
    parts = parts_for(prints.count())
    # one row stands for all of an equal set
    distinct = gathered(prints.groupBy("label").agg(F.min(F.struct("id", "mark")).alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), parts)
    buckets = distinct.select("label", "n", "fp", F.explode("keys").alias("key"))
    sizes = buckets.groupBy("key").agg(F.count("*").alias("in_bucket")).where("in_bucket > 1")
    members = cut(buckets.join(sizes, "key"), parts)
    by_print = gathered(_by_print(distinct, parts), parts)
    needed_sets = members.select("label").union(by_print.select("a")).union(by_print.select("b")).distinct()
    firsts = distinct.join(needed_sets, "label", "left_semi").select(F.col("first.id").alias("of_id"), F.col("first.mark").alias("of_mark"))
    sets = cut(_sets(texts.join(firsts, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("mark") == F.col("of_mark"))).select("text"), words).dropDuplicates(["label"]))
    few, many = members.where(F.col("in_bucket") <= crowd).select("key", "label", "n", "fp"), members.where(F.col("in_bucket") > crowd)
    edges = _alike(_pairs(few, F.lit(True), share).union(by_print).distinct(), sets, share, parts)
    nodes = distinct.select(F.col("label").alias("node"))
    if many.isEmpty():
        roots = gathered(components(nodes, edges), parts)
    else:
        small = F.broadcast if many.select("key").distinct().count() <= broadcast_rows else lambda df: df
        needed = lambda sizes: share / (1 + share) * sizes - 1e-9  # noqa: E731  of the shingles of two sets, so many in both
        common = gathered(_common(sets.join(many.select("label").distinct(), "label", "left_semi")), parts)
        known = gathered(many.select("key", "label", "n", "fp").join(common, "label"), parts)
        least = known.groupBy("key").agg(F.min("n").alias("smallest"))
        able = F.col("common") >= needed(F.col("n") + F.greatest(F.col("smallest"), share * F.col("n")))
        crowded = known.join(small(least), "key").where(able)
        hubs = crowded.groupBy("key").agg(F.max_by("label", F.struct(F.col("often") / F.col("n"), "label")).alias("hub"))
        crowded = gathered(crowded.join(small(hubs), "key").select("key", "hub", "label", "n", "fp", "common"), parts)
        frames = cut(_framed(crowded.select("hub", "label").distinct(), sets), parts)
        stars = frames.where((F.col("hub") != F.col("label")) & (F.col("both") >= needed(F.col("size") + F.col("n"))))
        edges = edges.union(stars.select(F.least("hub", "label").alias("a"), F.greatest("hub", "label").alias("b")))
        roots = gathered(components(nodes, edges), parts)
        crowded = gathered(crowded.join(roots.select(F.col("node").alias("label"), "root"), "label"), parts)
        # buckets of one component are done
        open_ones = gathered(crowded.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key"), parts)
        if open_ones.isEmpty():
            return prints.select("id", "mark", "label"), roots, parts
        seen = frames.select("hub", "label", "both", "words")
        crowded = cut(crowded.join(small(open_ones), "key").join(seen, ["hub", "label"]).select("key", "label", "n", "fp", "common", "root", "words", F.greatest(F.col("common") - F.col("both"), F.lit(0)).alias("beside")), parts)
        in_hub = F.aggregate(F.zip_with("p_words", "q_words", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda total, n: total + n)
        enough = needed(F.col("p_n") + F.col("q_n"))
        open_pairs = F.expr("p_root != q_root") & (F.least("p_common", "q_common") >= enough) & (in_hub + F.least("p_beside", "q_beside") >= enough)
        more = _alike(_pairs(crowded, open_pairs, share).distinct(), sets, share, parts)
        if not more.isEmpty():
            # these join components, so the roots are the nodes
            a, b = (roots.select(F.col("node").alias(s), F.col("root").alias(f"{s}_root")) for s in "ab")
            across = more.join(a, "a").join(b, "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
            joined = components(roots.select(F.col("root").alias("node")).distinct(), across).select(F.col("node").alias("of"), F.col("root").alias("least"))
            roots = gathered(roots.join(joined, F.col("root") == F.col("of")).select("node", F.col("least").alias("root")), parts)
    return prints.select("id", "mark", "label"), roots, parts


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, share: float = 0.8, bands: int = 25, rows: int = 4, crowd: int = 8, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of `docs`, all columns, with one of each component: that of the least id and, of these, the least hash of the text.

    Rows are told apart by id and text; of equal ones, one stays. Rows of a null id can't be named as copies and stay.
    What goes, and the components of more than one row, are broadcast if they have at most `broadcast_rows` rows each, else
    joined by a shuffle.
    """
    prints, roots, parts = _found(docs, id_col, text_col, words, share, bands, rows, crowd, broadcast_rows)
    found = prints.where("id IS NOT NULL").join(roots, F.col("label") == F.col("node"))
    found = gathered(found.groupBy("id", "mark", F.col("root").alias("component")).agg(F.count("*").alias("copies")), parts)
    least = gathered(found.groupBy("component").agg(F.min(F.struct("id", "mark")).alias("least"), F.count("*").alias("n")).where("n > 1").select("component", "least"), parts)
    least = F.broadcast(least) if least.count() <= broadcast_rows else least  # a large component is one key
    gone = cut(found.join(least, "component").where(F.struct("id", "mark") != F.col("least")).select("id", "mark"), parts)
    if gone.count() <= broadcast_rows:
        gone = F.broadcast(gone)
    # all columns are one while rows are matched, so none can clash with another's name
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("id"), mark(F.col(text_col)).alias("mark"))
    kept = packed.join(gone, ["id", "mark"], "left_anti")
    if not found.where("copies > 1").isEmpty():
        kept = kept.where("id IS NOT NULL").dropDuplicates(["id", "mark"]).unionByName(kept.where("id IS NULL"))
    return kept.select("row.*")
