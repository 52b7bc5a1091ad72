"""Counts with shares, fixed levels, funnels, ledgers, and top rows of groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions import rates


def category_shares(rows: DataFrame, value: str, by: Sequence[str] = (), missing: str = "Missing") -> DataFrame:
    """by, value, n, pct of the group; null and blank values are counted as `missing`."""
    name = F.coalesce(F.when(F.trim(F.col(value).cast("string")) != "", F.col(value).cast("string")), F.lit(missing))
    counts = rows.groupBy(*by, name.alias(value)).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", rates.percent(F.col("n"), F.sum("n").over(Window.partitionBy(*by))))


def fixed_levels(rows: DataFrame, value: str, levels: Sequence[str]) -> DataFrame:
    """position, level, n in the given order; a level that doesn't occur has 0."""
    table = rows.sparkSession.createDataFrame(list(enumerate(levels, 1)), "position int, level string")
    counts = rows.groupBy(F.col(value).alias("level")).agg(F.count("*").alias("n"))
    return F.broadcast(table).join(counts, "level", "left").select("position", "level", F.coalesce("n", F.lit(0)).alias("n"))


def completion_funnel(rows: DataFrame, invited: int, answers: Sequence[str], submitted: Column) -> DataFrame:
    """invited, responses (any answer), complete, and complete as a share of both."""
    any_answer = F.greatest(*(F.coalesce(F.trim(F.col(a).cast("string")) != "", F.lit(False)) for a in answers)) if len(answers) > 1 else F.coalesce(F.trim(F.col(answers[0]).cast("string")) != "", F.lit(False))
    out = rows.agg(F.lit(invited).cast("long").alias("invited"), F.count_if(any_answer).alias("responses"), F.count_if(submitted).alias("complete"))
    return out.withColumn("pct_of_invited", rates.percent(F.col("complete"), F.col("invited"))).withColumn("pct_of_responses", rates.percent(F.col("complete"), F.col("responses")))


def top_per_group(rows: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank", ties: bool = False) -> DataFrame:
    """The first n rows of each group; with `ties`, all rows of the first n distinct values."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(rank, (F.dense_rank() if ties else F.row_number()).over(w)).where(F.col(rank) <= n)


def cost_ledger(calls: DataFrame, prices: DataFrame, default: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """operation, calls, tokens_in, tokens_out, cost. prices: ord, prefix, price_in, price_out for a million tokens.

    A model's price is that of the first prefix (by ord) that its name starts with; `default` without one or without a name.
    Each distinct name meets prices by all its own prefixes, so prices of any number are joined by equality.
    """
    prefixes = F.transform(F.sequence(F.lit(0), F.char_length("model")), lambda n: F.substr("model", F.lit(1), n))
    named = calls.select("model").distinct().select("model", F.explode(prefixes).alias("prefix")).join(prices, "prefix")
    price = named.groupBy("model").agg(F.min_by(F.struct("price_in", "price_out"), "ord").alias("p"))
    priced = calls.join(price, "model", "left").withColumn("cost", (F.col("tokens_in") * F.coalesce("p.price_in", F.lit(default[0])) + F.col("tokens_out") * F.coalesce("p.price_out", F.lit(default[1]))) / 1e6)
    return priced.groupBy("operation").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost").alias("cost"))


def file_funnel(rows: DataFrame, by: str) -> DataFrame:
    """Sums of scored, analysed, evidence; detected groups; analysed and evidence shares."""
    out = rows.groupBy(by).agg(*(F.sum(c).alias(c) for c in ("scored", "analysed", "evidence")), F.count_if("detected").alias("detected"))
    return out.withColumn("analysed_pct", rates.percent(F.col("analysed"), F.col("scored"))).withColumn("evidence_pct", rates.percent(F.col("evidence"), F.col("analysed")))


def evidence_position(rows: DataFrame, by: str, rank: str, is_evidence: Column, confidence: Column) -> DataFrame:
    """Mean confidence of evidence, and the first and last place in the queue that has any."""
    return rows.groupBy(by).agg(F.avg(F.when(is_evidence, confidence)).alias("mean_confidence"), F.min(F.when(is_evidence, F.col(rank))).alias("first_at"), F.max(F.when(is_evidence, F.col(rank))).alias("last_at"), F.count_if(is_evidence).alias("n_evidence"))


def evidence_rate(rows: DataFrame, by: str, is_evidence: Column, seconds: Column) -> DataFrame:
    """Pieces of evidence and how many there are for each second that files took."""
    return rows.groupBy(by).agg(F.count_if(is_evidence).alias("n_evidence"), rates.guarded(F.count_if(is_evidence), F.sum(seconds)).alias("per_second"))


def phase_cost(rows: DataFrame, phase: str, each: float = 0.10) -> DataFrame:
    """How many entries a phase has, and what they cost at a price for each."""
    return rows.groupBy(phase).agg(F.count("*").alias("n")).withColumn("cost", F.col("n") * each)


def hint_usage(rows: DataFrame, by: str, hint: Column, score: Column, floor: float) -> DataFrame:
    return rows.groupBy(by).agg(F.avg(hint).alias("mean_hint"), F.count_if(hint != 0).alias("non_zero"), F.count_if(score < floor).alias("rejected"))


def resolution_rate(rows: DataFrame, tier: str, resolved: Column) -> DataFrame:
    out = rows.groupBy(tier).agg(F.count("*").alias("returned"), F.count_if(resolved).alias("resolved"))
    return out.withColumn("pct", rates.percent(F.col("resolved"), F.col("returned")))


def as_map(rows: DataFrame, by: str, key: str, value: str, name: str) -> DataFrame:
    """One map for each group from rows of a key and a value; keys are distinct within a group."""
    return rows.groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value)))).alias(name))


def as_rows(maps: DataFrame, by: str, name: str, key: str, value: str) -> DataFrame:
    """A row for each entry of each group's map."""
    return maps.select(by, F.explode(name).alias(key, value))


def distinct_per_file(rows: DataFrame, file: str, value: str) -> DataFrame:
    """Distinct values of each file and (file null) of all, in one pass over grouping sets."""
    pairs = rows.select(file, value).where(F.col(value).isNotNull()).distinct()
    return pairs.rollup(file).agg(F.count_distinct(value).alias("n"))
