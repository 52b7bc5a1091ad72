"""Stratified splits and samples, decided by a hash of the key: the same for any layout, and for any engine that has MD5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions import rates
from quarrymill.operators.order import running_totals, with_sizes


def shuffled(key: Column, seed: int) -> Column:
    """What rows are ordered by instead of a random shuffle."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), key.cast("string")).cast("binary"))


def stratified_split(rows: DataFrame, stratum: str, key: str, ratio: float = 0.7, seed: int = 42) -> DataFrame:
    """`rows` with `part`: 'train' for floor(n * ratio) of each stratum, else 'test'. Places within strata come by ranges, so a few large ones are dealt out."""
    mixed = rows.withColumn("__mixed", shuffled(F.col(key), seed))
    placed = with_sizes(running_totals(mixed, [stratum], ["__mixed", key], {"__place": F.lit(1).cast("long")}), [stratum], "__size")
    part = F.when(F.col("__place") < F.floor(F.col("__size") * F.lit(ratio) + F.lit(1e-9)), "train").otherwise("test")
    return placed.withColumn("part", part).drop("__mixed", "__place", "__size")


def split_quality(split: DataFrame, pattern: str, present: str) -> DataFrame:
    """pattern, train, test, their shares in each part, and one_sided (present in one part only)."""
    sizes = split.groupBy(pattern).agg(*(F.count_if((F.col("part") == p) & F.col(present)).alias(p) for p in ("train", "test")), *(F.count_if(F.col("part") == p).alias(f"{p}_rows") for p in ("train", "test")))
    return sizes.select(pattern, "train", "test", rates.percent(F.col("train"), F.col("train_rows")).alias("train_pct"), rates.percent(F.col("test"), F.col("test_rows")).alias("test_pct"), ((F.col("train") > 0) != (F.col("test") > 0)).alias("one_sided"))


def variation_sample(rows: DataFrame, stratum: str, key: str, size: int = 20, seed: int = 42) -> DataFrame:
    """About `size` rows over all strata: max(1, round half to even(size * share)) of each, in the order of strata while
    any of `size` are left; what is missing then is filled from the others by hash. With `picked`: 'quota' or 'fill'."""
    counts = rows.groupBy(stratum).agg(F.count("*").alias("n"))
    total = Window.partitionBy()
    want = F.least(F.greatest(F.bround(F.lit(float(size)) * F.col("n") / F.sum("n").over(total)).cast("long"), F.lit(1)), F.col("n"))
    quota = counts.select(stratum, want.alias("want")).withColumn("before", F.coalesce(F.sum("want").over(Window.orderBy(stratum).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    quota = quota.select(stratum, F.greatest(F.least(F.col("want"), F.lit(size) - F.col("before")), F.lit(0)).alias("quota"))
    w = Window.partitionBy(stratum).orderBy(shuffled(F.col(key), seed), key)
    placed = rows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= size).join(quota, stratum)
    picked = placed.where("__rn <= quota").drop("__rn", "quota").withColumn("picked", F.lit("quota"))
    rest = placed.where("__rn > quota").drop("__rn", "quota")
    filled = rest.withColumn("__f", F.row_number().over(Window.orderBy(shuffled(F.col(key), seed + 1), key)))
    have = picked.agg(F.count("*").alias("__have"))
    return picked.unionByName(filled.crossJoin(F.broadcast(have)).where(F.col("__f") <= size - F.col("__have")).drop("__f", "__have").withColumn("picked", F.lit("fill")))
