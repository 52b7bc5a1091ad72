"""First-wins deduplication, anti-joins, and the sequential claim."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions.text import is_generic_email
from quarrymill.operators.order import running_total
from quarrymill.sources.tables import cut


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an explicit order. A window over the keys: Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def last_per_key(rows: DataFrame, keys: Sequence[str], seq: Column) -> DataFrame:
    """The last row of each key by `seq`, by partial aggregation instead of a sort."""
    values = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), seq).alias("__row"))
    return best.select(*keys, *(F.col("__row")[c].alias(c) for c in values))


def keep_blank(rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """First wins by `key`; rows whose key is blank all stay."""
    k = F.lower(F.trim(F.coalesce(F.col(key), F.lit(""))))
    marked = rows.withColumn("__k", k)
    return first_per_key(marked.where("__k <> ''"), ["__k"], order).unionByName(marked.where("__k = ''")).drop("__k")


def without(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose trimmed, lower-cased key isn't in `other`; rows with a blank key are dropped too."""
    norm = lambda df: F.lower(F.trim(df[key]))
    seen = other.select(norm(other).alias("__k")).where(F.col("__k").isNotNull()).distinct()
    marked = rows.withColumn("__k", norm(rows)).where(F.col("__k").isNotNull() & (F.col("__k") != ""))
    return marked.join(seen, "__k", "left_anti").drop("__k")


def claim(rows: DataFrame, group: str, position: str, member: str, values: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The sequential claim: members, walked by (group, position), each take their first usable value that none before took.

    rows: one row for each member with an array of values. Returns group, position, member, claimed; members
    without a usable value left are not in the result.

    It is found in rounds, all members at once. In a round each member without a value bids for the first of its own that
    no earlier member holds; of the bids for a value the earliest member's is kept, and who held it goes on in the next
    round. Holders only become earlier ones, so a value that is refused once is refused for good, and no member is refused
    what the walk would give it: when nobody bids any more, values are held as the walk gives them. A round is a join
    by value and two group-bys of minima; there is one more for each further value that members have to turn to.
    """
    usable = F.array_distinct(F.filter(F.transform(F.coalesce(F.col(values), F.array()), lambda e: F.lower(F.trim(e))), lambda e: ~is_generic_email(e)))
    base = rows.select(group, position, member, usable.alias("__v")).where(F.size("__v") > 0).withColumn("__all", F.concat_ws("\n", "__v"))
    # equal rows are members each; a member is its place among all
    base = base.groupBy(group, position, member, "__all").agg(F.first("__v").alias("__v"), F.count("*").alias("__n")).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__n")))
    base = cut(running_total(base, [group, position, member, "__all", "__copy"], F.lit(1).cast("long"), "__m").select(group, position, member, "__m", "__v"))
    wanted = base.select("__m", F.posexplode("__v").alias("__k", "__e"))
    held = None
    while True:
        bidding = wanted
        if held is not None:
            holders = F.broadcast(held) if held.count() <= broadcast_rows else held
            wanted = cut(wanted.join(holders.select("__e", F.col("__m").alias("__by")), "__e", "left").where("__by IS NULL OR __m <= __by").select("__m", "__k", "__e"))
            bidding = wanted.join(holders.select("__m"), "__m", "left_anti")
        bids = cut(bidding.groupBy("__m").agg(F.min_by("__e", "__k").alias("__e")))
        if bids.isEmpty():
            break
        best = bids if held is None else bids.unionByName(held)
        held = cut(best.groupBy("__e").agg(F.min("__m").alias("__m")))
    claimed = base.drop("__v") if held is None else base.drop("__v").join(held, "__m")
    return claimed.select(group, position, member, F.col("__e") if held is not None else F.lit(None).cast("string").alias("__e")).withColumnRenamed("__e", "claimed")
