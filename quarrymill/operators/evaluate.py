"""Truth against predictions: outcomes, confusion counts, rates, agreement, calibration, errors, evolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions import rates

COUNTS = ("tp", "fp", "tn", "fn")


def outcomes(truth: DataFrame, detected: DataFrame, keys: list[str], only_known: bool = True) -> DataFrame:
    """keys, truth, detected: every pair of the truth; a missing detection is false.

    only_known: detections of pairs that the truth doesn't have are left out; else they come with truth null.
    """
    found = detected.select(*keys, F.col("detected").cast("boolean").alias("detected"))
    how = "left" if only_known else "full"
    return truth.select(*keys, F.col("truth").cast("boolean").alias("truth")).join(found, keys, how).withColumn("detected", F.coalesce("detected", F.lit(False)))


def union_of_keys(truth: DataFrame, detected: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs of either side; what is missing on a side is false."""
    return outcomes(truth, detected, keys, only_known=False).withColumn("truth", F.coalesce("truth", F.lit(False)))


def outcome_name(truth: Column, detected: Column) -> Column:
    return F.when(truth & detected, "TP").when(~truth & detected, "FP").when(truth & ~detected, "FN").when(~truth & ~detected, "TN")


def confusion(rows: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, tn, fn of each group (of all rows if `by` is empty)."""
    t, d = F.col("truth"), F.col("detected")
    return rows.groupBy(*by).agg(F.count_if(t & d).alias("tp"), F.count_if(~t & d).alias("fp"), F.count_if(~t & ~d).alias("tn"), F.count_if(t & ~d).alias("fn"))


def with_rates(counts: DataFrame) -> DataFrame:
    """precision, recall, accuracy, f1 from counts; a zero denominator gives 0."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in COUNTS)
    return (
        counts.withColumn("precision", rates.guarded(tp, tp + fp))
        .withColumn("recall", rates.guarded(tp, tp + fn))
        .withColumn("accuracy", rates.guarded(tp + tn, tp + fp + tn + fn))
        .withColumn("f1", rates.guarded(2 * tp, 2 * tp + fp + fn))
    )


def with_kappa(counts: DataFrame) -> DataFrame:
    """Cohen's kappa from counts; 0 where agreement by chance is complete."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in COUNTS)
    n = tp + fp + tn + fn
    po = rates.guarded(tp + tn, n)
    pe = rates.guarded((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    return counts.withColumn("kappa", rates.guarded(po - pe, 1 - pe))


def label_of(is_evidence: Column, synthesis_score: Column, confidence: Column) -> Column:
    """The predicted label: the flag if there is one, else a score of 7 or more, else a confidence over 0.6."""
    return F.coalesce(is_evidence, synthesis_score >= 7, confidence > 0.6, F.lit(False))


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, midpoint, accuracy and error of equal bins of `confidence` in [0, 1] (the last one closed); empty bins are left out."""
    b = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    grouped = rows.withColumn("bin", b).groupBy("bin").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    mid = (F.col("bin") + 0.5) / bins
    return grouped.select("bin", "n", mid.alias("midpoint"), "accuracy", F.abs(mid - F.col("accuracy")).alias("error"))


def expected_calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    return calibration(rows, bins).agg(rates.guarded(F.sum(F.col("error") * F.col("n")), F.sum("n")).alias("ece"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def confidence_distribution(rows: DataFrame) -> DataFrame:
    """mean, population standard deviation, min, max and n of `confidence` by outcome, and overall; zeros where there is none."""
    c = F.col("confidence")
    stats = [F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(c).alias("n")]
    named = rows.withColumn("outcome", outcome_name(F.col("truth"), F.col("detected")))
    every = named.groupBy("outcome").agg(*stats).unionByName(named.agg(*stats).withColumn("outcome", F.lit("overall")), allowMissingColumns=True)
    names = rows.sparkSession.createDataFrame([(x,) for x in ("TP", "FP", "TN", "FN", "overall")], "outcome string")
    return F.broadcast(names).join(every, "outcome", "left").select("outcome", *(F.coalesce(x, F.lit(0.0)).alias(x) for x in ("mean", "std", "lo", "hi")), F.coalesce("n", F.lit(0)).alias("n"))


def confident_errors(rows: DataFrame, ids: list[str], top: int = 10) -> DataFrame:
    """The `top` false positives by falling and false negatives by rising confidence, ranked; ties by the ids."""
    named = rows.withColumn("outcome", outcome_name(F.col("truth"), F.col("detected"))).where(F.col("outcome").isin("FP", "FN"))
    key = F.when(F.col("outcome") == "FP", -F.col("confidence")).otherwise(F.col("confidence"))
    w = Window.partitionBy("outcome").orderBy(key, *ids)
    return named.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def evolution(reports: DataFrame, order: list[str], step: int = 5, part: str | None = None) -> DataFrame:
    """Cumulative counts and rates after every `step` reports and after the last.

    Running sums need one order over all reports. `part` names a column whose values follow each other in that
    order (a day, a shard): sums are then taken within parts and carried over from a table of one row for each part,
    so no task sees all rows. Without it the window is over all rows, which is meant for a table of reports.
    """
    sums = list(COUNTS)
    if part is None:
        w = Window.orderBy(*order)
        run = reports.select(F.row_number().over(w).alias("seen"), *(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in sums), F.count("*").over(Window.partitionBy()).alias("all_rows"))
    else:
        totals = reports.groupBy(part).agg(F.count("*").alias("__rows"), *(F.sum(c).alias(f"__{c}") for c in sums))
        earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.select(F.col(part).alias("__part"), F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__rows"), *(F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__{c}") for c in sums), F.sum("__rows").over(Window.partitionBy()).alias("all_rows"))
        w = Window.partitionBy(part).orderBy(*order)
        run = reports.select(part, F.row_number().over(w).alias("k"), *(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in sums))
        run = run.join(carried, run[part] == carried["__part"]).select((F.col("k") + F.col("__rows")).alias("seen"), *((F.col(c) + F.col(f"__{c}")).alias(c) for c in sums), "all_rows")
    return with_rates(run.where((F.col("seen") % step == 0) | (F.col("seen") == F.col("all_rows"))).select("seen", *sums))


def side_by_side(tables: list[DataFrame], key: str) -> DataFrame:
    """Tables of one row for each key, joined where all of them have it."""
    out = tables[0]
    for other in tables[1:]:
        out = out.join(other, key)
    return out


def status_lists(rows: DataFrame, group: str, pattern: str, of: int | None = None) -> DataFrame:
    """Sorted arrays of the patterns of each outcome for each group, and accuracy over `of` patterns (their number if None)."""
    name = outcome_name(F.col("truth"), F.col("detected"))
    lists = rows.withColumn("o", name).groupBy(group).agg(*(F.sort_array(F.collect_list(F.when(F.col("o") == o.upper(), F.col(pattern)))).alias(o) for o in COUNTS))
    right = F.size("tp") + F.size("tn")
    return lists.withColumn("accuracy", rates.guarded(right, F.lit(of) if of else right + F.size("fp") + F.size("fn")))


def confusion_pairs(rows: DataFrame, group: str, pattern: str) -> DataFrame:
    """missed, wrong, n: how often a missed pattern and another wrongly detected one occur in one group."""
    named = rows.withColumn("o", outcome_name(F.col("truth"), F.col("detected")))
    missed = named.where("o = 'FN'").select(group, F.col(pattern).alias("missed"))
    wrong = named.where("o = 'FP'").select(group, F.col(pattern).alias("wrong"))
    return missed.join(wrong, group).where("missed <> wrong").groupBy("missed", "wrong").agg(F.count("*").alias("n"))
