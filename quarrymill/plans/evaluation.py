"""Evaluation of a length rule against quality labels, and of other predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import rates
from quarrymill.operators import evaluate, shares, stats
from quarrymill.plans.registry import query
from quarrymill.sources import read_table

#: A document counts as detected if it has so many characters.
LENGTH = 1500


def outcome_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, truth, detected, confidence, correct of labelled documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", (F.col("n_chars") >= LENGTH).alias("detected"))
    truth = read_table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("truth"))
    rows = evaluate.outcomes(truth, docs, ["doc_id"]).join(docs.drop("detected"), "doc_id")
    rows = rows.withColumn("confidence", F.least(F.col("n_chars") / F.lit(2000.0), F.lit(1.0)))
    return rows.withColumn("correct", F.col("truth") == F.col("detected"))


_O = f"""o AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality = 1 AS truth, d.n_chars >= {LENGTH} AS detected,
        least(d.n_chars / 2000::DOUBLE, 1::DOUBLE) AS confidence, (l.quality = 1) = (d.n_chars >= {LENGTH}) AS correct
        FROM labels l JOIN documents d USING (doc_id))"""
_COUNTS = """CAST(count(*) FILTER (truth AND detected) AS BIGINT) AS tp, CAST(count(*) FILTER (NOT truth AND detected) AS BIGINT) AS fp,
        CAST(count(*) FILTER (NOT truth AND NOT detected) AS BIGINT) AS tn, CAST(count(*) FILTER (truth AND NOT detected) AS BIGINT) AS fn"""
_RATES = """round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall,
        round(coalesce((tp + tn)::DOUBLE / nullif(tp + fp + tn + fn, 0), 0), 6) AS accuracy, round(coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"""


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})


_FOUR = ("precision", "recall", "accuracy", "f1")


@query(f"WITH {_O}, c AS (SELECT lang, {_COUNTS} FROM o GROUP BY lang) SELECT *, {_RATES} FROM c")
def lang_confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.with_rates(evaluate.confusion(outcome_rows(spark, sf_dir), ["lang"])), *_FOUR)


@query(f"WITH {_O}, c AS (SELECT source, {_COUNTS} FROM o GROUP BY source) SELECT *, {_RATES} FROM c")
def source_confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.with_rates(evaluate.confusion(outcome_rows(spark, sf_dir), ["source"])), *_FOUR)


@query(f"WITH {_O}, c AS (SELECT {_COUNTS} FROM o) SELECT *, {_RATES} FROM c")
def global_confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total as the sum of the groups."""
    groups = evaluate.confusion(outcome_rows(spark, sf_dir), ["source"])
    return rounded(evaluate.with_rates(groups.agg(*(F.sum(c).alias(c) for c in evaluate.COUNTS))), *_FOUR)


@query(f"""WITH k AS (SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(l.quality = 1, false) AS truth, coalesce(d.n_chars >= {LENGTH}, false) AS detected
        FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id) SELECT {_COUNTS} FROM k""")
def union_of_keys_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") >= LENGTH).alias("detected"))
    truth = read_table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("truth"))
    return evaluate.confusion(evaluate.union_of_keys(truth, docs, ["doc_id"]), [])


@query(f"""WITH {_O}, c AS (SELECT lang, {_COUNTS} FROM o GROUP BY lang),
        p AS (SELECT *, (tp + tn)::DOUBLE / (tp + fp + tn + fn) AS po,
              ((tp + fp)::DOUBLE * (tp + fn) + (fn + tn)::DOUBLE * (fp + tn)) / ((tp + fp + tn + fn)::DOUBLE * (tp + fp + tn + fn)) AS pe FROM c)
        SELECT lang, tp, fp, tn, fn, round(coalesce((po - pe) / nullif(1 - pe, 0), 0), 6) AS kappa FROM p""")
def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.with_kappa(evaluate.confusion(outcome_rows(spark, sf_dir), ["lang"])), "kappa")


@query(f"""WITH {_O}, p AS (SELECT lang, CASE WHEN doc_id % 3 = 0 THEN truth WHEN doc_id % 3 = 1 THEN n_chars / 500 >= 7 ELSE confidence > 0.6::DOUBLE END AS label FROM o)
        SELECT lang, label, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY ALL""")
def label_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag for a third of the rows, a score for another, a confidence for the last."""
    third = F.col("doc_id") % 3
    label = evaluate.label_of(F.when(third == 0, F.col("truth")), F.when(third == 1, F.col("n_chars") / 500), F.when(third == 2, F.col("confidence")))
    return outcome_rows(spark, sf_dir).groupBy("lang", label.alias("label")).agg(F.count("*").alias("n"))


_BINS = f"""{_O}, b AS (SELECT CAST(least(floor(confidence * 10), 9) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n, avg(CAST(correct AS DOUBLE)) AS accuracy FROM o GROUP BY 1),
        e AS (SELECT bin, n, (bin + 0.5::DOUBLE) / 10 AS midpoint, accuracy, abs((bin + 0.5::DOUBLE) / 10 - accuracy) AS error FROM b)"""


@query(f"WITH {_BINS} SELECT bin, n, round(midpoint, 6) AS midpoint, round(accuracy, 6) AS accuracy, round(error, 6) AS error FROM e")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.calibration(outcome_rows(spark, sf_dir)), "midpoint", "accuracy", "error")


@query(f"WITH {_BINS} SELECT round(sum(error * n) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM e")
def expected_calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.expected_calibration_error(outcome_rows(spark, sf_dir)), "ece")


_OUTCOME = "CASE WHEN truth AND detected THEN 'TP' WHEN detected THEN 'FP' WHEN truth THEN 'FN' ELSE 'TN' END"


@query(f"""WITH {_O}, n AS (SELECT unnest(['TP', 'FP', 'TN', 'FN', 'overall']) AS outcome),
        r AS (SELECT {_OUTCOME} AS outcome, confidence FROM o UNION ALL SELECT 'overall', confidence FROM o),
        a AS (SELECT outcome, avg(confidence) AS mean, stddev_pop(confidence) AS std, min(confidence) AS lo, max(confidence) AS hi, count(*) AS n FROM r GROUP BY 1)
        SELECT n.outcome, round(coalesce(mean, 0), 6) AS mean, round(coalesce(std, 0), 6) AS std, coalesce(lo, 0) AS lo, coalesce(hi, 0) AS hi, CAST(coalesce(a.n, 0) AS BIGINT) AS n
        FROM n LEFT JOIN a USING (outcome)""")
def confidence_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.confidence_distribution(outcome_rows(spark, sf_dir)), "mean", "std")


@query(f"""WITH {_O}, e AS (SELECT doc_id, {_OUTCOME} AS outcome, confidence FROM o)
        SELECT outcome, CAST(row_number() OVER (PARTITION BY outcome ORDER BY CASE WHEN outcome = 'FP' THEN -confidence ELSE confidence END, doc_id) AS INTEGER) AS rank, doc_id, confidence
        FROM e WHERE outcome IN ('FP', 'FN') QUALIFY rank <= 10""")
def top_confident_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confident_errors(outcome_rows(spark, sf_dir), ["doc_id"]).select("outcome", "rank", "doc_id", "confidence")


@query(f"""WITH {_O}, r AS (SELECT row_number() OVER w AS seen, count(*) OVER () AS n,
          sum(CAST(truth AND detected AS INT)) OVER w AS tp, sum(CAST(NOT truth AND detected AS INT)) OVER w AS fp,
          sum(CAST(NOT truth AND NOT detected AS INT)) OVER w AS tn, sum(CAST(truth AND NOT detected AS INT)) OVER w AS fn
          FROM o WINDOW w AS (ORDER BY doc_id ROWS UNBOUNDED PRECEDING))
        SELECT CAST(seen AS BIGINT) AS seen, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn, {_RATES}
        FROM r WHERE seen % 50 = 0 OR seen = n""")
def metric_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums by doc_id, within parts of 4096 ids that are then added up: no window over all rows."""
    t, d = F.col("truth"), F.col("detected")
    rows = outcome_rows(spark, sf_dir).select("doc_id", F.floor(F.col("doc_id") / 4096).alias("part"), *(x.cast("long").alias(n) for n, x in (("tp", t & d), ("fp", ~t & d), ("tn", ~t & ~d), ("fn", t & ~d))))
    return rounded(evaluate.evolution(rows, ["doc_id"], 50, part="part").withColumn("seen", F.col("seen").cast("long")), *_FOUR)


def pattern_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang (group), source (pattern), truth and detected of each pair."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    each = docs.join(labels, "doc_id").groupBy("lang", "source").agg(F.avg(F.col("quality").cast("double")).alias("q"), F.avg(F.col("n_chars").cast("double")).alias("c"))
    return each.select("lang", "source", (F.col("q") >= 0.85).alias("truth"), (F.col("c") >= 2500).alias("detected"))


_P = """p AS (SELECT lang, source, avg(CAST(quality AS DOUBLE)) >= 0.85::DOUBLE AS truth, avg(CAST(n_chars AS DOUBLE)) >= 2500 AS detected
        FROM documents JOIN labels USING (doc_id) GROUP BY ALL)"""


@query(f"""WITH {_P}, n AS (SELECT *, {_OUTCOME} AS o FROM p)
        SELECT a.source AS missed, b.source AS wrong, CAST(count(*) AS BIGINT) AS n FROM n a JOIN n b ON a.lang = b.lang AND a.o = 'FN' AND b.o = 'FP' AND a.source <> b.source GROUP BY ALL""")
def confusion_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion_pairs(pattern_rows(spark, sf_dir), "lang", "source")


@query(f"""WITH {_P}, n AS (SELECT *, {_OUTCOME} AS o FROM p),
        c AS (SELECT a.source AS missed, b.source AS wrong FROM n a JOIN n b ON a.lang = b.lang AND a.o = 'FN' AND b.o = 'FP' AND a.source <> b.source)
        SELECT missed, CAST(count(*) FILTER (wrong = 'src0') AS BIGINT) AS src0, CAST(count(*) FILTER (wrong = 'src1') AS BIGINT) AS src1,
               CAST(count(*) FILTER (wrong = 'src2') AS BIGINT) AS src2, CAST(count(*) FILTER (wrong = 'src3') AS BIGINT) AS src3 FROM c GROUP BY missed""")
def confusion_pair_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = evaluate.confusion_pairs(pattern_rows(spark, sf_dir), "lang", "source")
    return pairs.groupBy("missed").pivot("wrong", ["src0", "src1", "src2", "src3"]).agg(F.sum("n")).na.fill(0)


@query(f"""WITH {_P}, n AS (SELECT *, {_OUTCOME} AS o FROM p)
        SELECT lang, coalesce(string_agg(source, ',' ORDER BY source) FILTER (o = 'TP'), '') AS tp, coalesce(string_agg(source, ',' ORDER BY source) FILTER (o = 'FP'), '') AS fp,
               coalesce(string_agg(source, ',' ORDER BY source) FILTER (o = 'TN'), '') AS tn, coalesce(string_agg(source, ',' ORDER BY source) FILTER (o = 'FN'), '') AS fn,
               round(count(*) FILTER (o IN ('TP', 'TN')) / 20::DOUBLE, 6) AS accuracy FROM n GROUP BY lang""")
def status_lists_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = evaluate.status_lists(pattern_rows(spark, sf_dir), "lang", "source", of=20)
    return rounded(lists.withColumns({c: F.array_join(c, ",") for c in evaluate.COUNTS}), "accuracy")


@query(f"WITH {_P} SELECT lang, source, {_OUTCOME} AS status FROM p WHERE lang = 'en'")
def group_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pattern_rows(spark, sf_dir).where("lang = 'en'")
    return rows.select("lang", "source", evaluate.outcome_name(F.col("truth"), F.col("detected")).alias("status"))


@query("""SELECT d.source, CAST(sum(quality) AS BIGINT) AS present, round(100 * sum(quality)::DOUBLE / count(*), 6) AS pct FROM labels JOIN documents d USING (doc_id) GROUP BY d.source""")
def pattern_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "labels").join(read_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return rounded(rows.groupBy("source").agg(F.sum("quality").alias("present"), rates.percent(F.sum("quality"), F.count("*")).alias("pct")), "pct")


@query(f"""WITH {_O}, c AS (SELECT doc_id % 5 AS run, source, {_COUNTS} FROM o GROUP BY ALL), m AS (SELECT run, source, {_RATES} FROM c),
        a AS (SELECT run, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 FROM m GROUP BY run),
        u AS (UNPIVOT a ON precision, recall, f1 INTO NAME metric VALUE x)
        SELECT metric, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(stddev_samp(x) / avg(x), 6) AS cv FROM u GROUP BY metric""")
def variation_across_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outcome_rows(spark, sf_dir).withColumn("run", F.col("doc_id") % 5)
    metrics = rounded(evaluate.with_rates(evaluate.confusion(rows, ["run", "source"])), *_FOUR)
    return rounded(stats.variation(metrics, "run", ["precision", "recall", "f1"]), "mean", "std", "cv")


@query(f"""WITH {_O}, c AS (SELECT lang, CASE WHEN doc_id % 10 < 7 THEN 'train' ELSE 'test' END AS part, {_COUNTS} FROM o GROUP BY ALL), m AS (SELECT lang, part, {_RATES} FROM c)
        SELECT a.lang, a.f1 AS train_f1, b.f1 AS test_f1, round(a.f1 - b.f1, 6) AS diff, abs(a.f1 - b.f1) < 0.05::DOUBLE AS close
        FROM m a JOIN m b ON a.lang = b.lang AND a.part = 'train' AND b.part = 'test'""")
def train_test_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outcome_rows(spark, sf_dir).withColumn("part", F.when(F.col("doc_id") % 10 < 7, "train").otherwise("test"))
    m = rounded(evaluate.with_rates(evaluate.confusion(rows, ["lang", "part"])), "f1")
    wide = m.groupBy("lang").pivot("part", ["train", "test"]).agg(F.first("f1")).where("train IS NOT NULL AND test IS NOT NULL")
    return wide.select("lang", F.col("train").alias("train_f1"), F.col("test").alias("test_f1"), F.round(F.col("train") - F.col("test"), 6).alias("diff"), (F.abs(F.col("train") - F.col("test")) < 0.05).alias("close"))


@query("""SELECT l_returnflag, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 6) AS f, round(avg(l_quantity) FILTER (l_linestatus = 'O'), 6) AS o FROM lineitem GROUP BY 1""")
def pivot_metric_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = read_table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.avg("l_quantity"))
    return wide.select("l_returnflag", F.round("F", 6).alias("f"), F.round("O", 6).alias("o"))


@query(f"""WITH {_O}, c AS (SELECT source, {_COUNTS} FROM o GROUP BY source), m AS (SELECT source, {_RATES} FROM c)
        SELECT source, accuracy, f1, 'best' AS side, CAST(row_number() OVER (ORDER BY accuracy DESC, f1 DESC, source) AS INTEGER) AS rank FROM m QUALIFY rank <= 5
        UNION ALL SELECT source, accuracy, f1, 'worst', CAST(row_number() OVER (ORDER BY accuracy, f1, source DESC) AS INTEGER) AS rank FROM m QUALIFY rank <= 5""")
def best_and_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = rounded(evaluate.with_rates(evaluate.confusion(outcome_rows(spark, sf_dir), ["source"])), *_FOUR)
    best = shares.top_per_group(m, [F.lit(1)], [F.desc("accuracy"), F.desc("f1"), F.asc("source")], 5).withColumn("side", F.lit("best"))
    worst = shares.top_per_group(m, [F.lit(1)], [F.asc("accuracy"), F.asc("f1"), F.desc("source")], 5).withColumn("side", F.lit("worst"))
    return best.union(worst).select("source", "accuracy", "f1", "side", "rank")


@query(f"""WITH t AS (SELECT unnest([500, 1000, 1500, 2000, 3000]) AS cut), o AS (SELECT cut, l.quality = 1 AS truth, d.n_chars >= cut AS detected FROM labels l JOIN documents d USING (doc_id), t),
        c AS (SELECT cut, {_COUNTS} FROM o GROUP BY cut), m AS (SELECT cut, {_RATES} FROM c)
        SELECT CAST(cut AS INTEGER) AS cut, precision, recall, f1 FROM m ORDER BY precision >= 0.9::DOUBLE DESC, CASE WHEN precision >= 0.9::DOUBLE THEN recall ELSE f1 END DESC, cut LIMIT 1""")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several thresholds, the one of highest recall among those of precision 0.9 or more, else of highest F1."""
    rows = outcome_rows(spark, sf_dir).select("truth", "n_chars", F.explode(F.array(*(F.lit(x) for x in (500, 1000, 1500, 2000, 3000)))).alias("cut"))
    m = rounded(evaluate.with_rates(evaluate.confusion(rows.withColumn("detected", F.col("n_chars") >= F.col("cut")), ["cut"])), *_FOUR)
    precise = F.col("precision") >= 0.9
    return m.orderBy(precise.desc(), F.when(precise, F.col("recall")).otherwise(F.col("f1")).desc(), "cut").limit(1).select("cut", "precision", "recall", "f1")
