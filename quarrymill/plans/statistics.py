"""Descriptive statistics, correlation, resampling and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.operators import sampling, stats
from quarrymill.plans.evaluation import rounded
from quarrymill.plans.registry import query
from quarrymill.sources import read_table


@query("""SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(stddev_pop(o_totalprice), 4) AS std, min(o_totalprice) AS lo, max(o_totalprice) AS hi,
        round(quantile_cont(o_totalprice, 0.25), 4) AS p25, round(quantile_cont(o_totalprice, 0.75), 4) AS p75 FROM orders GROUP BY 1""")
def descriptive_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.describe(read_table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"]), "mean", "median", "std", "p25", "p75", places=4)


@query("""WITH c AS (SELECT p_type, p_name, count(*) AS n FROM part GROUP BY ALL)
        SELECT p_type, p_name, CAST(n AS BIGINT) AS n, CAST(sum(n) OVER w AS BIGINT) AS total, CAST(count(*) OVER w AS BIGINT) AS distinct_names, CAST(row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_name) AS INTEGER) AS rank,
          round(n * count(*) OVER w / CAST(sum(n) OVER w AS DOUBLE), 6) AS dominance FROM c WINDOW w AS (PARTITION BY p_type) QUALIFY rank <= 10""")
def file_dominance_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.dominance(read_table(spark, sf_dir, "part"), "p_type", "p_name"), "dominance")


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def correlation_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.pearson(read_table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]), "r")


@query("""WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2::DOUBLE AS x, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2::DOUBLE AS y FROM part)
        SELECT round(corr(x, y), 6) AS rho, CAST(count(*) AS BIGINT) AS n FROM r""")
def correlation_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.spearman(read_table(spark, sf_dir, "part").select("p_size", "p_retailprice"), "p_size", "p_retailprice"), "rho")


_BRANDS = "b AS (SELECT p_brand, avg(CAST(p_size AS DOUBLE)) AS x, avg(p_retailprice) AS y FROM part GROUP BY 1)"


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").groupBy("p_brand").agg(F.avg(F.col("p_size").cast("double")).alias("x"), F.avg("p_retailprice").alias("y"))


@query(f"""WITH {_BRANDS}, f AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM b), r AS (SELECT p_brand, y - i - s * x AS e FROM b, f), z AS (SELECT p_brand, e / (SELECT stddev_pop(e) FROM r) AS z FROM r)
        SELECT p_brand, round(z, 5) AS z, abs(z) > 1.5 AS outlier FROM z""")
def ols_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.residuals(brands(spark, sf_dir), "x", "y"), "z", places=5).select("p_brand", "z", "outlier")


@query(f"""WITH {_BRANDS}, f AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM b), r AS (SELECT x, y, y - i - s * x AS e FROM b, f)
        SELECT round(corr(x, y), 6) AS r, CAST(count(*) AS BIGINT) AS n FROM r WHERE abs(e / (SELECT stddev_pop(e) FROM r)) <= 1.5""")
def correlation_without_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.pearson(stats.residuals(brands(spark, sf_dir), "x", "y").where("NOT outlier"), "x", "y"), "r")


@query("""WITH v AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS i, s_acctbal AS x, count(*) OVER () AS n FROM supplier),
        d AS (SELECT b, j, CAST(concat('0x', substr(md5(concat('42-', b, '-', j)), 1, 8)) AS BIGINT) AS h FROM range(1500) t(b), range((SELECT count(*) FROM v)) u(j)),
        m AS (SELECT b, avg(x) AS m FROM d JOIN v ON v.i = d.h % v.n GROUP BY b)
        SELECT CAST((SELECT count(*) FROM v) AS BIGINT) AS n, round((SELECT avg(x) FROM v), 4) AS mean, round(quantile_cont(m, 0.025), 4) AS lo, round(quantile_cont(m, 0.975), 4) AS hi FROM m""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "supplier")
    return rounded(stats.bootstrap_mean(rows, "s_acctbal", "s_suppkey"), "mean", "lo", "hi", places=4)


@query()
def bootstrap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval of the mean price of all orders; its draws come from generators that SQL doesn't have, tests compare it with direct resampling."""
    return stats.bootstrap_by_counts(read_table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey")


@query("""WITH g AS (SELECT month(o_orderdate) AS m, count(*) AS n, avg(o_totalprice) AS a, var_pop(o_totalprice) AS v FROM orders GROUP BY 1), t AS (SELECT sum(n) AS n, sum(n * a) / sum(n) AS a FROM g)
        SELECT CAST(count(*) AS BIGINT) AS groups, CAST(any_value(t.n) AS BIGINT) AS n, round((sum(g.n * (g.a - t.a) ** 2) / (count(*) - 1)) / (sum(g.n * g.v) / (any_value(t.n) - count(*))), 6) AS f FROM g, t""")
def anova_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "orders").select(F.month("o_orderdate").alias("m"), "o_totalprice")
    return rounded(stats.anova(rows, "m", "o_totalprice"), "f")


@query("SELECT CAST(CASE WHEN l_quantity < 0 THEN 0 WHEN l_quantity >= 50 THEN 11 ELSE floor(l_quantity / 5) + 1 END AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(read_table(spark, sf_dir, "lineitem"), "l_quantity", 0.0, 50.0, 10)


_SPLIT = """s AS (SELECT doc_id, source, quality, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY md5(concat('42-', doc_id)), doc_id) <= floor(count(*) OVER (PARTITION BY source) * 0.7::DOUBLE + 1e-9) THEN 'train' ELSE 'test' END AS part
        FROM labels JOIN documents USING (doc_id))"""


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "labels").join(read_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return sampling.stratified_split(rows, "source", "doc_id")


@query(f"WITH {_SPLIT} SELECT doc_id, source, part FROM s")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(spark, sf_dir).select("doc_id", "source", "part")


@query(f"""WITH {_SPLIT}, c AS (SELECT source, count(*) FILTER (part = 'train' AND quality = 1) AS a, count(*) FILTER (part = 'test' AND quality = 1) AS b, count(*) FILTER (part = 'train') AS n, count(*) FILTER (part = 'test') AS m FROM s GROUP BY 1)
        SELECT source, CAST(a AS BIGINT) AS train, CAST(b AS BIGINT) AS test, round(coalesce(100 * a / nullif(n, 0)::DOUBLE, 0), 6) AS train_pct, round(coalesce(100 * b / nullif(m, 0)::DOUBLE, 0), 6) AS test_pct, (a > 0) <> (b > 0) AS one_sided FROM c""")
def split_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sampling.split_quality(split(spark, sf_dir).withColumn("present", F.col("quality") == 1), "source", "present"), "train_pct", "test_pct")


@query("""WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), w AS (SELECT lang, least(greatest(CAST(round_even(20 * n::DOUBLE / sum(n) OVER (), 0) AS BIGINT), 1), n) AS want FROM c),
        q AS (SELECT lang, greatest(least(want, 20 - coalesce(sum(want) OVER (ORDER BY lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) AS quota FROM w),
        p AS (SELECT doc_id, d.lang, quota, row_number() OVER (PARTITION BY d.lang ORDER BY md5(concat('42-', doc_id)), doc_id) AS rn FROM documents d JOIN q ON q.lang = d.lang),
        r AS (SELECT doc_id, lang, row_number() OVER (ORDER BY md5(concat('43-', doc_id)), doc_id) AS f FROM p WHERE rn > quota AND rn <= 20)
        SELECT doc_id, lang, 'quota' AS picked FROM p WHERE rn <= quota UNION ALL SELECT doc_id, lang, 'fill' FROM r WHERE f <= 20 - (SELECT count(*) FROM p WHERE rn <= quota)""")
def variation_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.variation_sample(read_table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id")
