"""Descriptive statistics, correlation, regression residuals, dominance, resampling, variance analysis."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions import rates
from quarrymill.operators.order import running_total, running_totals, with_sizes


def percentiles(rows: DataFrame, value: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    """The exact percentiles of each group, by linear interpolation: a column of each name in `shares`. Nulls don't count.

    Values are counted first, then distinct ones are placed within their group by ranges, and only those at the wanted
    places are picked. So no buffer and no task holds a group.
    """
    groups = by or ["__all"]
    rows = rows if by else rows.withColumn("__all", F.lit(0))
    counts = rows.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("double").alias("__x")).agg(F.count("*").alias("__c"))
    placed = with_sizes(running_totals(counts, groups, ["__x"], {"__before": F.col("__c")}), groups, "__n", F.col("__c"))
    place = {name: F.lit(p) * (F.col("__n") - 1) for name, p in shares.items()}
    at = lambda k: F.max(F.when((F.col("__before") <= k) & (k < F.col("__before") + F.col("__c")), F.col("__x")))
    picked = placed.groupBy(*groups).agg(F.max("__n").alias("__n"), *(f(at, place[name]).alias(f"{name}_{end}") for name in shares for end, f in (("lo", lambda pick, p: pick(F.floor(p))), ("hi", lambda pick, p: pick(F.ceil(p))))))
    between = lambda name: (F.ceil(place[name]) - place[name]) * F.col(f"{name}_lo") + (place[name] - F.floor(place[name])) * F.col(f"{name}_hi")
    return picked.select(*by, *(F.when(F.col(f"{name}_lo") == F.col(f"{name}_hi"), F.col(f"{name}_lo")).otherwise(between(name)).alias(name) for name in shares))


def describe(rows: DataFrame, value: str, by: list[str], sample: bool = False) -> DataFrame:
    """n, mean, median, std (population unless `sample`), min, max, p25 and p75 by linear interpolation; exact percentiles."""
    x = F.col(value)
    sums = rows.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.stddev_samp(x) if sample else F.stddev_pop(x)).alias("std"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    found = percentiles(rows, value, by, {"median": 0.5, "p25": 0.25, "p75": 0.75})
    columns = [*by, "n", "mean", "median", "std", "lo", "hi", "p25", "p75"]
    keys = {c: f"__{c}" for c in by}
    return sums.join(found.withColumnsRenamed(keys), [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()] or F.lit(True), "left").select(*columns)


def average_rank(rows: DataFrame, value: str, name: str) -> DataFrame:
    """`rows` with the rank of `value`, ties sharing the mean of their places.

    Ranks come from counts of distinct values: rows are grouped by value first, and only that smaller table is
    put in order, by ranges.
    """
    counts = rows.groupBy(F.col(value).alias("__x")).agg(F.count("*").alias("__n"))
    ranks = running_total(counts, ["__x"], F.col("__n"), "__b").select("__x", (F.col("__b") + (F.col("__n") + 1) / 2).alias(name))
    return rows.join(ranks, F.col(value) == F.col("__x")).drop("__x")


def pearson(rows: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or [])).agg(F.corr(x, y).alias("r"), F.count("*").alias("n"))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    ranked = average_rank(average_rank(rows, x, "__rx"), y, "__ry")
    return ranked.agg(F.corr("__rx", "__ry").alias("rho"), F.count("*").alias("n"))


def correlation_p_value(r: float, n: int) -> float:
    """Two-sided p-value of a correlation of n pairs, by Student's t with n - 2 degrees of freedom."""
    if n < 3 or abs(r) >= 1:
        return 0.0 if n >= 3 else 1.0
    t2 = r * r * (n - 2) / (1 - r * r)
    return incomplete_beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def f_p_value(f: float, d1: float, d2: float) -> float:
    """The chance of an F statistic of at least f."""
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, total = 1.0, 0.0, 1.0
    for i in range(0, 300):
        m = i // 2
        k = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + k * d
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1 + k / (c if abs(c) > 1e-300 else 1e-300)
        total *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (total - 1)


def residuals(rows: DataFrame, x: str, y: str, limit: float = 1.5) -> DataFrame:
    """`rows` with fitted, residual, z (residual / population std of residuals) and outlier (abs(z) > limit) of the line y on x."""
    fit = rows.agg(F.regr_slope(F.col(y), F.col(x)).alias("__b"), F.regr_intercept(F.col(y), F.col(x)).alias("__a"))
    out = rows.crossJoin(F.broadcast(fit)).withColumn("fitted", F.col("__a") + F.col("__b") * F.col(x)).withColumn("residual", F.col(y) - F.col("fitted"))
    spread = out.agg(F.stddev_pop("residual").alias("__s"))
    out = out.crossJoin(F.broadcast(spread)).withColumn("z", rates.guarded(F.col("residual"), F.col("__s")))
    return out.withColumn("outlier", F.abs("z") > limit).drop("__a", "__b", "__s")


def dominance(rows: DataFrame, group: str, name: str, top: int = 10) -> DataFrame:
    """group, name, n, total, distinct_names, index = n * distinct / total, rank: the `top` most frequent names of each group.

    One row for a name is 1 if names are equally frequent. Ties by name.
    """
    counts = rows.groupBy(group, name).agg(F.count("*").alias("n"))
    all_ = Window.partitionBy(group)
    ranked = counts.withColumn("total", F.sum("n").over(all_)).withColumn("distinct_names", F.count("*").over(all_)).withColumn("rank", F.row_number().over(all_.orderBy(F.desc("n"), name)))
    return ranked.where(F.col("rank") <= top).withColumn("dominance", F.col("n") * F.col("distinct_names") / F.col("total"))


def bootstrap_mean(rows: DataFrame, value: str, key: str, resamples: int = 1500, seed: int = 42, level: float = 0.95, broadcast_rows: int = 100_000) -> DataFrame:
    """n, mean, lo, hi: the percentile interval of the mean over seeded resamples; zeros for fewer than 3 values.

    Draw j of resample b picks the value whose place (by key) is a hash of (seed, b, j) modulo n, so the result
    does not depend on the layout. There are n * resamples draws, made and summed up in parallel; the values are
    broadcast to them if there are `broadcast_rows` at most, and joined by place otherwise.
    """
    placed = running_total(rows.select(F.col(key).alias("__key"), F.col(value).cast("double").alias("x")), ["__key"], F.lit(1), "i").select("i", "x")
    n = rows.count()
    if n < 3:
        return rows.sparkSession.createDataFrame([(n, 0.0, 0.0, 0.0)], "n bigint, mean double, lo double, hi double")
    text = F.concat_ws("-", F.lit(str(seed)), F.floor(F.col("id") / n).cast("string"), (F.col("id") % n).cast("string"))
    draws = rows.sparkSession.range(resamples * n)
    picks = draws.select(F.floor(F.col("id") / n).alias("b"), (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % n).alias("i"))
    means = picks.join(F.broadcast(placed) if n <= broadcast_rows else placed, "i").groupBy("b").agg(F.avg("x").alias("m"))
    tail = (1 - level) / 2
    interval = means.agg(F.percentile("m", F.lit(tail)).alias("lo"), F.percentile("m", F.lit(1 - tail)).alias("hi"))
    return placed.agg(F.count("*").alias("n"), F.avg("x").alias("mean")).crossJoin(interval)  # one row each


def bootstrap_by_counts(rows: DataFrame, value: str, key: str, resamples: int = 1500, seed: int = 42, level: float = 0.95, part: int = 10_000) -> DataFrame:
    """n, mean, lo, hi: the percentile interval of the mean over seeded resamples; zeros for fewer than 3 values.

    Values are cut into parts of `part` by their place (by key). How many of the n draws of a resample fall into a part is
    drawn on the way to it in a tree of halves, a binomial number at each, from a generator that the seed and the place in
    the tree start. So parts agree on their shares without a word, each makes its own draws only and sends one sum for each
    resample, and the draws depend neither on layout nor on retries. Null values don't count.
    """
    rows = rows.where(F.col(value).isNotNull())
    placed = running_total(rows.select(F.col(key).alias("__key"), F.col(value).cast("double").alias("x")), ["__key", "x"], F.lit(1).cast("long"), "i").select("i", "x")
    n = rows.count()
    if n < 3:
        return rows.sparkSession.createDataFrame([(n, 0.0, 0.0, 0.0)], "n bigint, mean double, lo double, hi double")

    def draws_of(number: int) -> np.ndarray:
        """How many draws of each resample fall into a part."""
        low, high, left = 0, -(-n // part), np.full(resamples, n, np.int64)
        while high - low > 1:
            middle = (low + high) // 2
            whole, first = min(high * part, n) - low * part, (middle - low) * part
            below = np.random.default_rng([seed, low, high]).binomial(left, first / whole)
            low, high, left = (low, middle, below) if number < middle else (middle, high, left - below)
        return left

    def inside(some: pd.DataFrame) -> pd.DataFrame:
        number = int(some["i"].iloc[0]) // part
        x = some.sort_values("i")["x"].to_numpy()
        draw = np.random.default_rng([seed, number])
        return pd.DataFrame({"b": np.arange(resamples), "s": [x[draw.integers(len(x), size=m)].sum() for m in draws_of(number).tolist()]})

    sums = placed.groupBy(F.floor(F.col("i") / part).alias("part")).applyInPandas(inside, "b int, s double")
    means = sums.groupBy("b").agg((F.sum("s") / n).alias("m"))
    tail = (1 - level) / 2
    interval = means.agg(F.percentile("m", F.lit(tail)).alias("lo"), F.percentile("m", F.lit(1 - tail)).alias("hi"))  # of `resamples` values
    return placed.agg(F.count("*").alias("n"), F.avg("x").alias("mean")).crossJoin(interval)  # one row each


def interval_flag(n: Column, lo: Column, hi: Column, wide: float = 0.3) -> Column:
    return F.when(n < 3, "insufficient").when(hi - lo > wide, "high_uncertainty").otherwise("ok")


def anova(rows: DataFrame, group: str, value: str) -> DataFrame:
    """groups, n, f: the F statistic of one-way analysis of variance, from sums of each group."""
    g = rows.groupBy(F.col(group).alias("__g")).agg(F.count(value).alias("__n"), F.avg(value).alias("__m"), F.var_pop(value).alias("__v"))
    grand = g.agg(F.sum("__n").alias("__total"), (F.sum(F.col("__n") * F.col("__m")) / F.sum("__n")).alias("__mean"))
    both = g.crossJoin(F.broadcast(grand)).agg(F.count("*").alias("groups"), F.first("__total").alias("n"), F.sum(F.col("__n") * (F.col("__m") - F.col("__mean")) ** 2).alias("between"), F.sum(F.col("__n") * F.col("__v")).alias("within"))
    return both.select("groups", "n", rates.guarded(F.col("between") / (F.col("groups") - 1), F.col("within") / (F.col("n") - F.col("groups"))).alias("f"))


def variation(rows: DataFrame, run: str, metrics: list[str]) -> DataFrame:
    """metric, mean, std (sample) and cv = std / mean over the means of each run."""
    means = rows.groupBy(run).agg(*(F.avg(m).alias(m) for m in metrics))
    stacked = means.unpivot([run], metrics, "metric", "x")
    out = stacked.groupBy("metric").agg(F.avg("x").alias("mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("std"))
    return out.withColumn("cv", rates.guarded(F.col("std"), F.col("mean")))


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """bin (1 to bins; 0 below, bins + 1 from `high` on) and n."""
    return rows.groupBy(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))
