"""Detection logs and event tables folded into reports: one function, for batches and for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.sources import schemas


def with_run(log: DataFrame) -> DataFrame:
    """The log with the run that each line belongs to: the last run_id of a session_start before it in its file."""
    w = Window.partitionBy("file_path").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    started = F.when((F.col("event") == "session_start") & F.col("run_id").isNotNull(), F.col("run_id"))
    return log.withColumn("run", F.last(started, ignorenulls=True).over(w))


def pattern_reports(log: DataFrame, gated: bool = True) -> DataFrame:
    """run, pattern, files, n_files, files_analyzed, evidence_found, detected of a log with runs.

    gated: lines of a pattern before its pattern_analysis_start don't count, and files are distinct; else no start
    is needed and repeated files are kept. Lines without a run are left out. The last verdict wins.
    """
    rows = log.where(F.col("run").isNotNull() & F.col("pattern").isNotNull())
    if gated:
        w = Window.partitionBy("run", "pattern").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("__on", F.max((F.col("event") == "pattern_analysis_start").cast("int")).over(w)).where("__on = 1")
    scored = F.when(F.col("event") == "file_scored", F.col("file"))
    files = F.sort_array(F.collect_set(scored) if gated else F.collect_list(scored))
    verdicts = F.col("event").isin("pattern_analysis_end", "pattern_analysis_complete", "pattern_verdict") & F.col("detected").isNotNull()
    done = F.col("event") == "investigation_phase_complete"
    out = rows.groupBy("run", "pattern").agg(
        files.alias("files"),
        F.max_by(F.when(done, F.col("files_analyzed")), F.when(done, F.col("seq"))).alias("files_analyzed"),
        F.max_by(F.when(done, F.col("evidence_found")), F.when(done, F.col("seq"))).alias("evidence_found"),
        F.max_by(F.when(verdicts, F.col("detected")), F.when(verdicts, F.col("seq"))).alias("detected"),
    )
    return out.select("run", "pattern", "files", F.size("files").alias("n_files"), F.coalesce("files_analyzed", F.lit(0)).alias("files_analyzed"), F.coalesce("evidence_found", F.lit(0)).alias("evidence_found"), F.coalesce("detected", F.lit(False)).alias("detected"))


def user_fold(events: DataFrame) -> DataFrame:
    """user_id, n, signups, errors, spent, last_type, last_at: what a session log folds into. Only associative aggregates, so batch and stream agree."""
    at = F.col("ts").cast("timestamp")
    is_ = lambda kind: F.count_if(F.col("event_type") == kind)
    return events.groupBy("user_id").agg(
        F.count("*").alias("n"), is_("signup").alias("signups"), is_("error").alias("errors"), F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)).alias("spent"), F.max_by("event_type", F.struct(at, F.col("event_id"))).alias("last_type"), F.max(at).alias("last_at")
    )


def write_updates(changed: DataFrame, out: str, checkpoint: str) -> None:
    """A stream in update mode to folders `batch=N` of `out`, until what is there has been read. A batch that is run again overwrites itself."""

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number:06d}")

    changed.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, out: str, keys: list[str], version: list[str]) -> DataFrame:
    """The last row that a stream wrote of each key, by `version` within a batch."""
    rows = spark.read.option("basePath", out).parquet(out)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct("batch", *version)).alias("r"))
    return best.select(*keys, *(F.col("r")[c].alias(c) for c in values))


def stream_user_fold(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str, files: int = 1) -> DataFrame:
    """`user_fold` over a folder of Parquet files as a stream that ends with what is there; users that change are written to `out`."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    write_updates(user_fold(stream), out, checkpoint)
    return latest(spark, out, ["user_id"], [])


def stream_pattern_counts(spark: SparkSession, path: str, out: str, checkpoint: str) -> DataFrame:
    """Counts of a detection log by event and pattern, as a stream over a folder of JSON lines, written to `out`."""
    lines = spark.readStream.schema(schemas.DETECTION_EVENT).option("maxFilesPerTrigger", 1).json(path)
    write_updates(lines.groupBy("event", "pattern").agg(F.count("*").alias("n")), out, checkpoint)
    return latest(spark, out, ["event", "pattern"], [])


def stream_evolution(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str) -> None:
    """Confusion counts of arriving reports added up batch by batch: each batch appends the totals so far to `out`."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)

    def add(batch: DataFrame, number: int) -> None:
        new = batch.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "tn", "fn"))).withColumn("batch", F.lit(number))
        new.write.mode("overwrite").parquet(f"{out}/batch={number:06d}")  # a batch that is run again overwrites itself

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def evolution_so_far(spark: SparkSession, out: str) -> DataFrame:
    """batch and the totals up to it."""
    rows = spark.read.option("basePath", out).parquet(out)
    w = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("batch", *(F.sum(c).over(w).alias(c) for c in ("tp", "fp", "tn", "fn")))


def forward_filled(events: DataFrame, kind: str = "signup") -> DataFrame:
    """event_id, user_id, context: the id of the user's last event of `kind` up to each event; null before the first."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.select("event_id", "user_id", F.last(F.when(F.col("event_type") == kind, F.col("event_id")), ignorenulls=True).over(w).alias("context"))
