"""Places in one order over all rows, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.sources.tables import cut


def running_total(rows: DataFrame, order: list[str], weight: Column, name: str) -> DataFrame:
    """`rows` with `name`: the sum of `weight` over all rows before this one in ascending order; 0 for the first.

    Rows are dealt out by ranges of the order, sums are taken within a range and carried over from a table of one row for
    each range. With weight 1 it is the place of a row, from 0.
    """
    ranged = cut(rows.withColumn("__w", weight).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranged.groupBy("__part").agg(F.sum("__w").alias("__s")).select("__part", F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__before"))
    own = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # as many rows as ranges, so broadcast
    return ranged.join(F.broadcast(carried), "__part").withColumn(name, F.col("__before") + F.coalesce(F.sum("__w").over(own), F.lit(0))).drop("__part", "__w", "__before")


def running_totals(rows: DataFrame, groups: list[str], order: list[str], weights: dict[str, Column]) -> DataFrame:
    """`rows` with, for each name of `weights`, the sum over the rows of its group before this one; 0 for the first.

    With weight 1 it is the place of a row in its group, from 0. No task sees a group: rows are dealt out by ranges of
    (groups, order), so a large group takes many ranges, each is summed by itself, and what a range leaves of its last
    group is carried into the next, by a table of one row for each range. Nulls come first and are one group.
    """
    inner = {name: f"__w{i}" for i, name in enumerate(weights)}
    group = F.struct(*groups)
    weighted = rows.withColumns({inner[name]: weight for name, weight in weights.items()})
    ranged = cut(weighted.repartitionByRange(*groups, *order).withColumn("__part", F.spark_partition_id()))
    last = ranged.groupBy("__part").agg(F.max(group).alias("__last"))
    left = ranged.join(F.broadcast(last), "__part").where(group.eqNullSafe(F.col("__last"))).groupBy("__part").agg(F.first("__last").alias("__last"), *(F.sum(w).alias(w) for w in inner.values()))
    so_far = Window.partitionBy("__last").orderBy("__part")  # as many rows as ranges
    carried = left.select(F.lead("__part").over(Window.orderBy("__part")).alias("__next"), "__last", *(F.sum(w).over(so_far).alias(f"{w}c") for w in inner.values()))
    own = Window.partitionBy("__part", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = ranged.join(F.broadcast(carried), (F.col("__part") == F.col("__next")) & group.eqNullSafe(F.col("__last")), "left")
    zero = F.lit(0)
    return met.withColumns({name: F.coalesce(F.sum(w).over(own), zero) + F.coalesce(F.col(f"{w}c"), zero) for name, w in inner.items()}).select(*rows.columns, *weights)


def with_sizes(rows: DataFrame, groups: list[str], name: str, weight: Column | None = None, broadcast_rows: int = 200_000) -> DataFrame:
    """`rows` with the number of rows of its group, or the sum of `weight` over them. Sizes are broadcast if there are at most `broadcast_rows` groups."""
    keys = [f"__g{i}" for i in range(len(groups))]
    sizes = rows.groupBy(*(F.col(g).alias(k) for g, k in zip(groups, keys, strict=True))).agg((F.count("*") if weight is None else F.sum(weight)).alias(name))
    sizes = F.broadcast(sizes) if sizes.count() <= broadcast_rows else sizes
    return rows.join(sizes, [F.col(g).eqNullSafe(F.col(k)) for g, k in zip(groups, keys, strict=True)]).drop(*keys)
