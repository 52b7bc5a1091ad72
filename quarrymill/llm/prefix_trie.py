"""The prefix trie of conversations, by ownership of the smallest member.

A node is a distinct sequence of first turns; its members are the conversations that begin with it. Each node is owned
by its smallest member, and since members only get fewer going down, what a conversation owns of its path is a suffix:
one number, the depth from which on it owns, marks it. Then

* the nodes of a subtree are counted by their owners: children and leaves are sums of marks over the members of a node;
* what a subtree saves, the sum of (members - 1) x tokens over its nodes, is the tokens of all occurrences less
  those of the owned ones: each member adds the tokens of the rest of its path that it doesn't own.

So one group-by of all occurrences by prefix gives every column; no node is visited from another. A prefix is named by
the sum of hashes of its (depth, turn)s, 128 bits, which windows along a path add up; a path is dealt out in blocks of
`STEP` turns, so a very long conversation is no task's own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.operators.order import running_totals
from quarrymill.sources.tables import cut, importable

#: Turns of a conversation in one block.
STEP = 10_000
#: Nodes of more members are looked up by broadcast, if there are at most `BROADCAST_ROWS` of them.
CROWD = 1_000
BROADCAST_ROWS = 1_000_000
_LANES = ("l0", "l1", "l2", "l3")
_KEY = ["k1", "k2", "depth"]
_HALF = (1 << 32) - 1


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), digest and tokens of every turn.

    A null role or text is empty. Turns are in the order of `turn`, null first, equal ones in that of their digest, so
    repeated rows follow each other. Rows without a conv_id belong to no conversation. Other columns are not read.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    tokens = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", F.unhex(digest).alias("digest"), tokens.alias("tokens"))
    # texts are read once: ranges are drawn from a sample of these rows, which would read them again
    return running_totals(cut(rows), ["conv_id"], ["turn", "digest"], {"place": F.lit(1).cast("long")}).drop("turn")


def paths_of(turns: DataFrame, family: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Paths (conv_id, block, depth from 1, digest, tokens, len, blocks) and members (conv_id, blocks, len) of rebuilt conversations.

    Conversation c has the first h = crc32(c) % heads turns of conversation c - c % family, then its own after its first
    h; with heads = 1 all are as they were. A member may have no turns left.
    """
    turns = cut(turns.withColumn("block", F.floor(F.col("place") / STEP)))
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    counts = counts.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % heads).alias("h"))
    bases = counts.where("conv_id = base").select(F.col("conv_id").alias("base"), F.col("n").alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    known = counts.join(bases, "base", "left").select("conv_id", "base", "h", taken.alias("m"), (F.floor((F.col("n") - 1) / STEP) + 1).alias("blocks"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"))
    known = cut(known)
    own = turns.join(in_blocks(known).hint("shuffle_hash"), ["conv_id", "block"]).where("place >= h").select("conv_id", "block", (F.col("place") - F.col("h") + F.col("m") + 1).alias("depth"), "digest", "tokens", "len", "blocks")
    # a base has `heads` - 1 turns at most and `family` conversations or twice as many (around 0)
    first = turns.where((F.col("place") < heads - 1) & (F.col("conv_id") % family == 0)).select(F.col("conv_id").alias("base"), "place", "digest", "tokens")
    given = first.join(known, "base").where("place < m").select("conv_id", F.lit(0).cast("long").alias("block"), (F.col("place") + 1).alias("depth"), "digest", "tokens", "len", "blocks")
    return own.unionByName(given), known.select("conv_id", "blocks", "len")


def in_blocks(members: DataFrame) -> DataFrame:
    """One row for each block of a member's turns, so that joining facts to turns meets no more than a block by one row."""
    return members.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))


def _along(paths: DataFrame, columns: tuple[str, ...], blocks: int, backward: bool = False) -> DataFrame:
    """`paths` with sums of `columns` from the start of a path to this turn, or from this turn to the end. blocks: of the longest path."""
    way = (lambda c: F.desc(c)) if backward else F.col
    within = Window.partitionBy("conv_id", "block").orderBy(way("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = paths.withColumns({f"{c}_sum": F.sum(c).over(within) for c in columns})
    if blocks <= 1:
        return summed
    before = Window.partitionBy("conv_id").orderBy(way("block")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    totals = paths.where("blocks > 1").groupBy("conv_id", "block").agg(*(F.sum(c).alias(c) for c in columns))
    carried = totals.select("conv_id", "block", *(F.sum(c).over(before).alias(f"{c}_carried") for c in columns))
    summed = summed.join(carried, ["conv_id", "block"], "left")
    return summed.withColumns({f"{c}_sum": F.col(f"{c}_sum") + F.coalesce(f"{c}_carried", F.lit(0)) for c in columns}).drop(*(f"{c}_carried" for c in columns))


def _joined(low: Column, high: Column) -> Column:
    return low.bitwiseAND(_HALF).bitwiseOR(F.shiftleft(high.bitwiseAND(_HALF), 32))


def occurrences(paths: DataFrame, blocks: int) -> DataFrame:
    """Each turn of each path with the name of the prefix that it ends (k1, k2, depth) and that of the one before (p1, p2)."""
    hashes = [F.xxhash64(F.lit(seed), F.col("depth").cast("long"), "digest") for seed in (1, 2)]
    lanes = [half for h in hashes for half in (h.bitwiseAND(_HALF), F.shiftrightunsigned(h, 32))]
    summed = _along(paths.withColumns(dict(zip(_LANES, lanes, strict=True))).drop("digest"), _LANES, blocks)
    total, earlier = [F.col(f"{c}_sum") for c in _LANES], [F.col(f"{c}_sum") - F.col(c) for c in _LANES]
    return summed.select("conv_id", "block", "blocks", "depth", "len", "tokens", _joined(*total[:2]).alias("k1"), _joined(*total[2:]).alias("k2"), _joined(*earlier[:2]).alias("p1"), _joined(*earlier[2:]).alias("p2"))


def _owners_above(owned: DataFrame, nodes: DataFrame, root_owner: int) -> DataFrame:
    """conv_id, above: the owner of the node over the first one that a conversation owns.

    Where many conversations leave one node, that node is among the few of more than `CROWD` members, which are broadcast.
    """
    entries = owned.select("conv_id", F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("from") - 1).alias("depth"))
    owners = nodes.select(*_KEY, F.col("owner").alias("above"))
    top = entries.where("depth = 0").select("conv_id", F.lit(root_owner).alias("above"))
    entries = entries.where("depth > 0")
    crowded = nodes.where(F.col("n") > CROWD).select(*_KEY, F.col("owner").alias("above"))
    if crowded.count() > BROADCAST_ROWS:
        return entries.join(owners, _KEY).select("conv_id", "above").union(top)
    here = entries.join(F.broadcast(crowded), _KEY).select("conv_id", "above")
    rest = entries.join(F.broadcast(crowded), _KEY, "left_anti").join(owners, _KEY).select("conv_id", "above")
    return here.union(rest).union(top)


def digests(ends: DataFrame) -> DataFrame:
    """k1, k2, depth, ends_sha256 of the conversations (k1, k2, depth, conv_id) that end at a node, ascending.

    Ids are joined in blocks of at most 65,536, by range of id; the blocks of a node, in order, stream through one digest.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = ends.groupBy(*_KEY, F.shiftright("conv_id", 16).alias("block")).agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, hashlib.sha256()
        for batch in batches:
            done: list[tuple] = []
            for *key, text in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "ids")), strict=True):
                if key != now:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(text.encode())
            yield _digest_rows(done)
        if now is not None:
            yield _digest_rows([(*now, digest.hexdigest())])

    return blocks.repartition(*_KEY).sortWithinPartitions(*_KEY, "block").select(*_KEY, "ids").mapInArrow(run, "k1 bigint, k2 bigint, depth bigint, ends_sha256 string")


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], [*_KEY, "ends_sha256"])


def trie(paths: DataFrame, members: DataFrame) -> DataFrame:
    """The nodes of the trie of `paths` (conv_id, block, depth, digest, tokens, len, blocks) and `members` (conv_id, blocks, len).

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256. Without
    members there is no node.
    """
    top = members.agg(F.min("conv_id").alias("owner"), F.max("len").alias("deepest"), F.max("blocks").alias("blocks")).first()
    root_owner, flat = top["owner"] if top["owner"] is not None else 0, top["deepest"] == 0
    blocks = top["blocks"] or 0
    found = cut(occurrences(paths, blocks))
    nodes = found.groupBy(*_KEY).agg(F.min("conv_id").alias("owner"), F.max("len").alias("deepest"), F.count("*").alias("n"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    nodes = cut(nodes)
    owned = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.min("depth").alias("from"), F.min_by("p1", "depth").alias("p1"), F.min_by("p2", "depth").alias("p2"), F.max((F.col("deepest") == F.col("depth")).cast("int")).alias("leaf"))
    marks = members.join(owned, "conv_id", "left").join(_owners_above(owned, nodes, root_owner), "conv_id", "left")
    at_root = (F.col("conv_id") == root_owner) & F.lit(flat)
    marks = cut(marks.select("conv_id", "blocks", "len", F.coalesce("from", F.col("len") + 1).alias("from"), F.when(at_root, 1).otherwise(F.coalesce("leaf", F.lit(0))).alias("leaf"), "above"))
    marked = found.join(in_blocks(marks.drop("len")).drop("blocks").hint("shuffle_hash"), ["conv_id", "block"]).withColumn("more", F.when(F.col("depth") < F.col("from"), F.col("tokens")).otherwise(0))
    rest = _along(marked, ("more",), blocks, backward=True)
    # the first turn of a path stands for the root too
    seen = rest.withColumn("at", F.explode(F.when(F.col("depth") == 1, F.array(F.lit(0).cast("long"), "depth")).otherwise(F.array("depth"))))
    zero = F.lit(0).cast("long")
    key = lambda c: F.when(F.col("at") == 0, zero).otherwise(F.col(c)).alias(c)
    parent = F.when(F.col("at") == 0, None).when(F.col("at") > F.col("from"), F.col("conv_id")).otherwise(F.col("above"))
    child = ((F.col("at") + 1 >= F.col("from")) & (F.col("at") < F.col("len"))).cast("long")
    rows = seen.select(key("k1"), key("k2"), F.col("at").alias("depth"), "conv_id", parent.alias("parent"), child.alias("child"), F.col("leaf").cast("long").alias("leaf"), F.col("more_sum").alias("more"))
    none = F.lit(None).cast("long")
    rows = rows.union(marks.where("len = 0").select(zero, zero, zero, "conv_id", none, zero, F.col("leaf").cast("long"), zero))
    summed = rows.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.min_by("parent", "conv_id").alias("parent_conv_id"), F.count("*").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("more").alias("saved_tokens"))
    ends = found.where("depth = len").select(*_KEY, "conv_id").union(marks.where("len = 0").select(zero, zero, zero, "conv_id"))
    out = summed.join(digests(ends), _KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """The trie of all conversations, rebuilt with shared heads; see `turns_of`, `paths_of` and `trie`. An empty table gives no node."""
    importable(conversations.sparkSession)
    return trie(*paths_of(turns_of(conversations), family, heads))
