"""Writers of JSON lines, CSV, nested reports and fixed-width text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_gate(audited: DataFrame, passing: str, log: str, name: Column, columns: Sequence[str]) -> None:
    """Passing records and the decision log as JSON lines, from one computation of the audit."""
    from quarrymill.operators.quality_gate import decision_log

    kept = audited.persist()
    try:
        kept.where(F.col("status") == "PASS").select(*columns).write.mode("overwrite").json(passing)
        decision_log(kept, name).write.mode("overwrite").json(log)
    finally:
        kept.unpersist()


def write_csv(rows: DataFrame, path: str, columns: Sequence[str]) -> None:
    """CSV with a header, the named columns in their order; others are left out."""
    rows.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def nested_reports(detections: DataFrame, files: DataFrame, run_id: str, configuration: dict[str, str]) -> DataFrame:
    """One nested report for each repository: summary, patterns, files of each pattern, how it was made."""
    found = detections.groupBy("repo").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("pattern", "detected")))).alias("patterns"),
        F.sort_array(F.collect_list(F.when(F.col("detected"), F.col("pattern")))).alias("detected_patterns"),
        F.count("*").alias("total_patterns_scanned"),
    )
    per = files.groupBy("repo", "pattern").agg(F.sort_array(F.collect_set("file")).alias("files")).groupBy("repo").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("pattern", "files")))).alias("scanned_files_per_pattern"))
    settings = F.create_map(*(F.lit(x) for kv in configuration.items() for x in kv)) if configuration else F.create_map().cast("map<string,string>")
    return found.join(per, "repo", "left").select(
        F.struct(F.col("repo").alias("repository_name"), "detected_patterns", "total_patterns_scanned", F.lit(run_id).alias("run_id")).alias("summary"),
        "patterns",
        "scanned_files_per_pattern",
        F.struct(F.struct(settings.alias("configuration")).alias("reproducibility")).alias("_metadata"),
    )


def fixed_width(rows: DataFrame, columns: dict[str, int]) -> DataFrame:
    """One text column `value`: each column cut or padded to its width, ready for write.text."""
    return rows.select(F.concat(*(F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), w, " ") for c, w in columns.items())).alias("value"))
