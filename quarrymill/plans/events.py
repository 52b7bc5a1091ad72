"""Event logs, in batches and as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.operators.order import running_totals
from quarrymill.plans.registry import query
from quarrymill.sources import read_table
from quarrymill.sources.tables import ensure_checkpoint_dir
from quarrymill.streaming import event_fold, pattern_stream

_FOLD = """SELECT user_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (event_type = 'signup') AS BIGINT) AS signups, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS errors,
        round(coalesce(sum(value) FILTER (event_type = 'purchase'), 0), 4) AS spent, arg_max(event_type, (ts, event_id)) AS last_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at FROM events GROUP BY 1"""


def _shown(df: DataFrame) -> DataFrame:
    return df.select("user_id", "n", "signups", "errors", F.round("spent", 4).alias("spent"), "last_type", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss").alias("last_at"))


@query(_FOLD)
def event_log_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(event_fold.user_fold(read_table(spark, sf_dir, "events")))


@query(_FOLD)
def event_stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fold as a stream over files, until all that is there has been read."""
    events = read_table(spark, sf_dir, "events")
    where = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    events.repartition(3, "event_id").write.parquet(f"{where}/in")
    return _shown(event_fold.stream_user_fold(spark, f"{where}/in", events.schema, f"{where}/out", f"{where}/state"))


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS context FROM events""")
def session_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_fold.forward_filled(read_table(spark, sf_dir, "events"))


_KIND = "CASE event_type WHEN 'signup' THEN 'pattern_analysis_start' WHEN 'error' THEN 'pattern_verdict' WHEN 'purchase' THEN 'investigation_phase_complete' ELSE 'file_scored' END"


_REPORTS = f"""WITH l AS (SELECT event_id AS seq, CAST(user_id % 40 AS VARCHAR) AS run, concat('p', user_id % 3) AS pattern, {_KIND} AS event, concat('f', event_id % 50) AS file, value FROM events),
        s AS (SELECT *, max(CASE WHEN event = 'pattern_analysis_start' THEN 1 ELSE 0 END) OVER (PARTITION BY run, pattern ORDER BY seq ROWS UNBOUNDED PRECEDING) AS started FROM l)
        SELECT run, pattern, CAST(count(DISTINCT file) FILTER (event = 'file_scored') AS INTEGER) AS n_files, coalesce(arg_max(CAST(floor(value) AS BIGINT), seq) FILTER (event = 'investigation_phase_complete'), 0) AS files_analyzed,
          coalesce(arg_max(value > 50, seq) FILTER (event = 'pattern_verdict'), false) AS detected FROM s WHERE started = 1 GROUP BY ALL"""


@query(_REPORTS)
def pattern_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold of a detection log into one report for each run and pattern, on events dressed as log lines."""
    return event_fold.pattern_reports(_dressed(spark, sf_dir)).select("run", "pattern", "n_files", "files_analyzed", "detected")


def _dressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as lines of detection logs."""
    t = F.col("event_type")
    kind = F.when(t == "signup", "pattern_analysis_start").when(t == "error", "pattern_verdict").when(t == "purchase", "investigation_phase_complete").otherwise("file_scored")
    return read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), (F.col("user_id") % 40).cast("string").alias("run"), F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("pattern"), kind.alias("event"), F.concat(F.lit("f"), (F.col("event_id") % 50).cast("string")).alias("file"),
        F.floor("value").alias("files_analyzed"), F.lit(0).cast("long").alias("evidence_found"), (F.col("value") > 50).alias("detected"),
    )


@query(_REPORTS)
def stream_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same reports by a stream that keeps each log's context and gates: its lines come in files in no order, in several batches, and are put in theirs."""
    lines = running_totals(_dressed(spark, sf_dir), ["run"], ["seq"], {"line": F.lit(1).cast("long")})
    opening = lines.select("run").distinct().select(F.concat(F.lit("log"), "run").alias("log"), F.lit(0).cast("long").alias("seq"), F.lit("session_start").alias("event"), F.col("run").alias("run_id"))
    rest = lines.withColumns({"log": F.concat(F.lit("log"), "run"), "seq": F.col("line") + 1}).drop("run", "line")
    where = f"{ensure_checkpoint_dir(spark)}/reports-{uuid.uuid4().hex}"
    opening.unionByName(rest, allowMissingColumns=True).repartition(4, F.xxhash64("log", "seq")).write.parquet(f"{where}/in")
    reports = pattern_stream.stream_reports(spark, f"{where}/in", f"{where}/out", f"{where}/state", files=2)
    return reports.select("run", "pattern", "n_files", "files_analyzed", "detected")
