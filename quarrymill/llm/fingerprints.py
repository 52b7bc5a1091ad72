"""Homomorphic multiset fingerprints of documents, in DataFrame functions alone.

A text is the multiset of its paragraphs (what line ends separate, empty ones included). Every paragraph
is hashed to a wide vector, and the fingerprint is the sum of the vectors, each lane modulo a power of two.
So the order of paragraphs does not matter, and a paragraph is inserted or deleted by adding or subtracting
its vector, without the rest of the text.

Two kinds of lanes:

* `2 * WIDE` lanes of 32 bits, sums modulo 2**32 of 32-bit halves of 64-bit hashes of paragraphs: equality.
* `63 * SIGNS` lanes of 21 bits, sums (the whole modulo 2**62) of single hash bits of the sentences in the paragraphs: with
  the number of sentences n, 2 * lane - n is a sum of +1 and -1, so the cosine of two such vectors estimates
  the cosine of the two multisets of sentences. Three lanes share a 64-bit sum, 21 bits for each: the cosine
  is meant for texts of fewer than 2**20 sentences; equality and updates hold for any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.sources.tables import cut

#: 64-bit hashes of each paragraph: two lanes of 32 bits come from each, so equality is that of 1024 bits.
WIDE = 16
#: 64-bit hashes of each sentence: 63 lanes come from each.
SIGNS = 2
_BITS = (1 << 0) | (1 << 21) | (1 << 42)
#: The highest lane of a packed sum wraps at 2**20.
_FULL = (1 << 62) - 1
#: Ids of one block; the order of a block's documents is found in one task.
BLOCK = 256


def _hashed(units: Column, seed: int) -> Column:
    # the seed is bound here: a second parameter of the lambda would be the place in the array
    return F.transform(units, lambda u: F.xxhash64(u, F.lit(seed)))


def vector(text: Column) -> Column:
    """The lanes of a text as an array of bigint: 2 * WIDE sums modulo 2**32, then n, then 21 * SIGNS packed sums.

    Each list is bound to a lambda variable, so it is computed once for a text, not once for each lane.
    """
    paragraphs = F.split(F.coalesce(text, F.lit("")), "\n", -1)

    def wide(units: Column) -> Column:
        halves = []
        for seed in range(WIDE):
            hashes = _hashed(units, seed)
            halves.append(F.transform(F.array(hashes), lambda hs: F.array(F.aggregate(hs, F.lit(0).cast("long"), lambda a, h: (a + h.bitwiseAND(0xFFFFFFFF)).bitwiseAND(0xFFFFFFFF)), F.aggregate(hs, F.lit(0).cast("long"), lambda a, h: (a + F.shiftrightunsigned(h, 32)).bitwiseAND(0xFFFFFFFF))))[0])
        return F.concat(*halves)

    def signs(units: Column) -> Column:
        sums = [F.array(F.size(units).cast("long"))]
        for seed in range(SIGNS):
            hashes = _hashed(units, 100 + seed)
            sums.append(F.transform(F.array(hashes), lambda hs: F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.aggregate(hs, F.lit(0).cast("long"), lambda a, h: a.bitwiseAND(_FULL) + F.call_function("shiftright", h, i).bitwiseAND(_BITS))))[0])
        return F.concat(*sums)

    sentences = lambda ps: F.flatten(F.transform(ps, lambda p: F.split(p, r"(?<=[.!?])\s+", -1)))
    return F.transform(F.array(paragraphs), lambda ps: F.concat(wide(ps), F.transform(F.array(sentences(ps)), signs)[0]))[0]


def _sign_lanes(v: Column) -> Column:
    """2 * lane - n for every one-bit lane."""
    n = v[2 * WIDE]
    packed = F.slice(v, 2 * WIDE + 2, 21 * SIGNS)
    return F.flatten(F.transform(packed, lambda x: F.array(*(2 * F.shiftrightunsigned(x, s).bitwiseAND(0x1FFFFF if s < 42 else 0x3FFFFF) - n for s in (0, 21, 42)))))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two vectors from 0 to 1: 1 where all lanes agree, else the cosine of the one-bit lanes, at least 0."""

    def cosine(x: Column, y: Column) -> Column:
        dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0).cast("long"), lambda acc, z: acc + z)
        norm = F.sqrt(dot(x, x).cast("double") * dot(y, y).cast("double"))
        return F.when(norm > 0, dot(x, y) / norm).otherwise(0.0)

    pair = F.array(F.struct(_sign_lanes(a).alias("x"), _sign_lanes(b).alias("y")))
    near = F.transform(pair, lambda p: F.least(F.greatest(cosine(p["x"], p["y"]), F.lit(0.0)), F.lit(1.0)))[0]
    return F.when(a == b, F.lit(1.0)).otherwise(near)


def fingerprint(v: Column) -> Column:
    """A vector as text: 8 hexadecimal digits for each wide lane, 16 for n and each packed sum."""
    wide = F.transform(F.slice(v, 1, 2 * WIDE), lambda x: F.lpad(F.hex(x), 8, "0"))
    rest = F.transform(F.slice(v, 2 * WIDE + 1, 1 + 21 * SIGNS), lambda x: F.lpad(F.hex(x), 16, "0"))
    return F.lower(F.concat(F.array_join(wide, ""), F.array_join(rest, "")))


def insert(v: Column, paragraph: Column) -> Column:
    """The vector of a text after `paragraph` is added to it."""
    return _combine(v, vector(paragraph), 1)


def delete(v: Column, paragraph: Column) -> Column:
    """The vector of a text after one `paragraph` is taken from it."""
    return _combine(v, vector(paragraph), -1)


def _combine(v: Column, w: Column, sign: int) -> Column:
    total = F.zip_with(v, w, lambda x, y: x + sign * y)
    return F.concat(F.transform(F.slice(total, 1, 2 * WIDE), lambda x: x.bitwiseAND(0xFFFFFFFF)), F.transform(F.slice(total, 2 * WIDE + 1, 1 + 21 * SIGNS), lambda x: x.bitwiseAND(_FULL)))


def _placed(rows: DataFrame, block: int, broadcast_rows: int) -> tuple[DataFrame, bool]:
    """`rows` with their section (blk, s, p) and `copies`, and whether any id was split.

    A block of ids is one section. An id with more than `block` rows has sections of its own, of ranges of its texts, and
    divides its block's other ids: s counts the divisions before a row, p the range. Equal rows of such an id are one, with `copies`.
    """
    blk = F.floor(F.col("doc_id") / F.lit(block)).cast("long")
    plain = rows.select("nul", "doc_id", "text", blk.alias("blk"))
    hot = cut(rows.groupBy("nul", "doc_id").agg(F.count("*").alias("n")).where(F.col("n") > block).select("nul", "doc_id", blk.alias("blk")))
    few = hot.count()
    if not few:
        return plain.select("nul", "doc_id", "text", "blk", F.lit(0).alias("s"), F.lit(0).alias("p"), F.lit(1).cast("long").alias("copies")), False
    small = F.broadcast if few <= broadcast_rows else lambda df: df
    inside = small(hot.groupBy("blk").agg(F.collect_list(F.struct("nul", "doc_id")).alias("hots")))  # as many as a block has ids at most
    earlier = F.coalesce(F.size(F.filter("hots", lambda h: (h["nul"] < F.col("nul")) | ((h["nul"] == F.col("nul")) & (h["doc_id"] > F.col("doc_id"))))), F.lit(0))
    keys = small(hot.select("nul", "doc_id"))
    others = plain.join(keys, ["nul", "doc_id"], "left_anti").join(inside, "blk", "left").select("nul", "doc_id", "text", "blk", F.when(F.col("hots").isNull(), 0).otherwise(2 * earlier).alias("s"), F.lit(0).alias("p"), F.lit(1).cast("long").alias("copies"))
    own = plain.join(keys, ["nul", "doc_id"], "left_semi").groupBy("nul", "doc_id", "text", "blk").agg(F.count("*").alias("copies"))
    own = cut(own.repartitionByRange(F.col("nul"), F.col("doc_id").desc(), F.col("text")).withColumn("p", F.spark_partition_id()))
    return others.union(own.join(inside, "blk").select("nul", "doc_id", "text", "blk", (2 * earlier + 1).alias("s"), "p", "copies")), True


def with_next(rows: DataFrame, block: int = BLOCK, broadcast_rows: int = 200_000) -> DataFrame:
    """nul, doc_id, text, the text's vector v, and in `next` (text, v) of the row that follows by descending doc_id; after the last comes the first.

    rows: nul (1 if the id is null, else 0; null ids come last), doc_id, text. Rows are dealt out by sections, each at most
    a block of ids or a range of one id's texts (see `_placed`), so there is no total sort. The first row of each section
    is also sent to the section before it, whose last row it follows. Which section that is comes from a narrow table of
    sections, ordered the same way by blocks of blocks until one is left.
    """
    if block < 2:
        raise ValueError("a block has at least 2 ids")
    placed, split = _placed(rows, block, broadcast_rows)
    # the first row of a section: null ids last, then the greatest id, then the least text
    heads = cut(placed.groupBy("blk", "s", "p").agg(F.min(F.struct("nul", F.bitwise_not("doc_id").alias("down"))).alias("k")).select("blk", "s", "p", F.col("k.nul").alias("nul"), F.bitwise_not(F.col("k.down")).alias("doc_id")))
    before = F.lag(F.struct("s", "p")).over(Window.partitionBy("blk").orderBy("s", "p"))
    sections = heads.withColumn("b", before)
    last = heads.groupBy("blk").agg(F.max(F.struct("s", "p")).alias("last"))
    around = _previous(heads.select("blk").distinct(), block).join(last.withColumnRenamed("blk", "previous"), "previous")
    target = sections.join(around, "blk").select("blk", "s", "p", "nul", "doc_id", F.when(F.col("b").isNull(), F.col("previous")).otherwise(F.col("blk")).alias("to_blk"), F.coalesce("b", "last").alias("to"))
    target = cut(target.select("blk", "s", "p", "nul", "doc_id", "to_blk", F.col("to.s").alias("to_s"), F.col("to.p").alias("to_p")))
    wanted = target.select("blk", "s", "p", "nul", "doc_id", "to_blk", "to_s", "to_p")
    wanted = F.broadcast(wanted) if target.count() <= broadcast_rows else wanted
    # an id that is not split has few rows, and one that is has its equal rows as one, so these are few for each section
    ends = placed.join(wanted, ["blk", "s", "p", "nul", "doc_id"]).groupBy("to_blk", "to_s", "to_p", "nul", "doc_id").agg(F.min("text").alias("text"))
    guests = ends.select("nul", "doc_id", "text", F.col("to_blk").alias("blk"), F.col("to_s").alias("s"), F.col("to_p").alias("p"), F.lit(1).cast("long").alias("copies"), F.lit(1).alias("guest"))
    both = placed.withColumn("guest", F.lit(0)).union(guests).withColumn("v", vector(F.col("text")))
    window = Window.partitionBy("blk", "s", "p").orderBy("guest", "nul", F.col("doc_id").desc(), "text")
    out = both.withColumn("next", F.lead(F.struct("text", "v")).over(window)).where("guest = 0")
    if split:  # of equal rows each is followed by the next of them, the last by what follows
        follows = F.concat(F.array(F.struct(F.lit(1).cast("long").alias("times"), F.col("next").alias("next"))), F.when(F.col("copies") > 1, F.array(F.struct((F.col("copies") - 1).alias("times"), F.struct("text", "v").alias("next")))).otherwise(F.array()))
        out = out.select("nul", "doc_id", "text", "v", F.explode(follows).alias("f")).select("nul", "doc_id", "text", "v", F.col("f.next").alias("next"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("f.times"))).alias("time"))
    return out.select("nul", "doc_id", "text", "v", "next")


def _previous(keys: DataFrame, block: int) -> DataFrame:
    """keys: distinct blk. Returns blk and the next greater blk as `previous`; for the greatest, the least (what wraps around)."""
    keys = cut(keys)  # read several times below, once more on each level
    if keys.count() <= block:
        least = keys.agg(F.min("blk").alias("least"))
        return keys.withColumn("next", F.lead("blk").over(Window.orderBy("blk"))).join(F.broadcast(least), F.lit(True)).select("blk", F.coalesce("next", "least").alias("previous"))
    up = keys.withColumn("sup", F.floor(F.col("blk") / F.lit(block)).cast("long"))
    own = up.withColumn("previous", F.lead("blk").over(Window.partitionBy("sup").orderBy("blk")))
    sups = up.groupBy("sup").agg(F.min("blk").alias("least"))
    after = _previous(sups.select(F.col("sup").alias("blk")), block).select(F.col("blk").alias("sup"), F.col("previous").alias("after"))
    first = after.join(sups.select(F.col("sup").alias("after"), "least"), "after").select("sup", "least")
    return own.join(first, "sup").select("blk", F.coalesce("previous", "least").alias("previous"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The fingerprint of every whole text, of its edited text, and their likeness.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many (or all) of the
    next document by descending id; after the last comes the first. Rows with one id follow each other by
    text. A null text counts as empty. Rows with a null id come last. A table of one row is its own next; an empty one
    gives no rows. Ids are whole numbers; an id of another type is refused. Columns besides id and text are not read.
    """
    if not isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{id_col} is no whole number, so there is no next document by descending id")
    doc_id = F.col(id_col).cast("long")
    rows = docs.select(doc_id.isNull().cast("int").alias("nul"), F.coalesce(doc_id, F.lit(-(2**63))).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = with_next(rows, block)
    n = F.char_length("text")
    k = F.floor(n / 3).cast("int")
    found = found.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.col("next.text"), F.lit(1), k)))
    found = found.select(F.when(F.col("nul") == 0, F.col("doc_id")).alias("doc_id"), n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "v", F.col("next.v").alias("nv"), vector(F.col("edited")).alias("ev"))
    return found.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("v")).alias("fingerprint"), fingerprint(F.col("ev")).alias("edited_fingerprint"), likeness(F.col("v"), F.col("ev")).alias("near_edited"), likeness(F.col("v"), F.col("nv")).alias("near_next"))
