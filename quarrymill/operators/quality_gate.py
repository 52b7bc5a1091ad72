"""An audited quality gate over repository-like records: every predicate is evaluated and kept with its reason."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions import dates, globs, rates, text


@dataclass(frozen=True)
class GateConfig:
    """Thresholds of the gate. as_of: the day that ages are counted to, as 'YYYY-MM-DD'."""

    as_of: str
    min_stars: int = 10
    min_age_months: float = 6.0
    min_contributors: int = 3
    min_recent_commits: int = 1
    min_size: int = 0
    max_size: int = 0
    min_pattern_files: int = 1
    patterns: tuple[str, ...] = ()
    require_email: bool = True
    columns: dict[str, str] = field(default_factory=dict)

    def col(self, name: str) -> Column:
        return F.col(self.columns.get(name, name))


def _result(passed: Column, message: Column, actual: Column, threshold: float) -> Column:
    return F.struct(F.coalesce(passed, F.lit(False)).alias("passed"), F.when(passed, "ok").otherwise(message).alias("message"), actual.cast("double").alias("actual"), F.lit(float(threshold)).alias("threshold"))


def at_least(actual: Column, threshold: float, what: str) -> Column:
    """{passed, message, actual, threshold} of actual >= threshold; a null fails."""
    return _result(actual >= threshold, F.concat(F.lit(f"{what}: "), F.coalesce((F.lit(threshold) - actual).cast("string"), F.lit("unknown")), F.lit(" short")), actual, threshold)


def _age(c: GateConfig) -> Column:
    return at_least(dates.age_months(F.to_date(c.col("created_at")), F.to_date(F.lit(c.as_of))), c.min_age_months, "age_months")


def _size(c: GateConfig) -> Column:
    x = c.col("size")
    return _result(in_range(x, c.min_size, c.max_size), F.concat(F.lit("size: "), F.coalesce(x.cast("string"), F.lit("unknown")), F.lit(" out of range")), x, c.min_size)


def in_range(x: Column, low: float, high: float) -> Column:
    """low <= x, and x <= high unless high is 0."""
    return (x >= low) if not high else (x >= low) & (x <= high)


def _files(c: GateConfig) -> Column:
    if not c.min_pattern_files:
        return _result(F.lit(True), F.lit(""), F.lit(0), 0)
    if not c.patterns:
        return _result(F.lit(False), F.lit("no patterns"), F.lit(0), c.min_pattern_files)
    reduced = F.array_distinct(F.array_compact(F.array(*(globs.reduce_glob(F.lit(p)) for p in c.patterns))))
    paths = F.array_distinct(F.transform(c.col("file_tree"), lambda f: f["path"]))
    n = F.coalesce(F.size(F.filter(paths, lambda p: F.exists(reduced, lambda r: globs.matches_reduced(p, r)))), F.lit(0))
    return at_least(n, c.min_pattern_files, "file_extensions")


def _emails(c: GateConfig) -> Column:
    if not c.require_email:
        return _result(F.lit(True), F.lit(""), F.lit(0), 0)
    every = F.flatten(F.transform(F.map_values(c.col("contributors")), lambda x: x["emails"]))
    valid = F.array_distinct(F.filter(every, lambda e: ~text.is_generic_email_lenient(e)))
    return at_least(F.coalesce(F.greatest(F.size(valid), F.lit(0)), F.lit(0)), 1, "valid_emails")


#: Predicates by name, in the order in which failures are listed. Others may be added.
CHECKS: dict[str, Callable[[GateConfig], Column]] = {
    "stars": lambda c: at_least(c.col("stars"), c.min_stars, "stars"),
    "age_months": _age,
    "contributors": lambda c: at_least(F.greatest(F.coalesce(F.size(F.map_keys(c.col("contributors"))), F.lit(0)), F.lit(0)), c.min_contributors, "contributors"),
    "recent_commits": lambda c: at_least(c.col("recent_commits"), c.min_recent_commits, "recent_commits"),
    "size": _size,
    "file_extensions": _files,
    "valid_emails": _emails,
}


def audit(records: DataFrame, config: GateConfig, checks: dict[str, Callable[[GateConfig], Column]] | None = None) -> DataFrame:
    """`records` with `filters` (a struct of every predicate's result), `failed_filters` and `status`. No predicate short-circuits another."""
    checks = CHECKS if checks is None else checks
    out = records.withColumn("filters", F.struct(*(make(config).alias(name) for name, make in checks.items())))
    failed = F.array_compact(F.array(*(F.when(~F.col(f"filters.{n}.passed"), F.lit(n)) for n in checks)))
    out = out.withColumn("failed_filters", failed)
    return out.withColumn("status", F.when(F.size("failed_filters") == 0, "PASS").otherwise("FAIL")).withColumn(
        "summary", F.when(F.size("failed_filters") == 0, "all filters passed").otherwise(F.concat(F.lit("failed: "), F.array_join("failed_filters", ", ")))
    )


def rollup(audited: DataFrame, by: list[str] | None = None) -> DataFrame:
    """processed, passed, rejected and success_pct."""
    counts = audited.groupBy(*(by or [])).agg(F.count("*").alias("processed"), F.count_if(F.col("status") == "PASS").alias("passed"))
    return counts.withColumn("rejected", F.col("processed") - F.col("passed")).withColumn("success_pct", rates.percent(F.col("passed"), F.col("processed")))


def decision_log(audited: DataFrame, name: Column, metadata: Column | None = None) -> DataFrame:
    """The audit as a log: repository, status, filters, summary, failed_filters (null when empty)."""
    extra = [metadata.alias("metadata")] if metadata is not None else []
    return audited.select(name.alias("repository"), "status", *extra, "filters", "summary", F.when(F.size("failed_filters") > 0, F.col("failed_filters")).alias("failed_filters"))


def metadata_summary(created: Column, language: Column, description: Column, url: Column) -> Column:
    return F.struct(created.alias("created_at"), language.alias("language"), text.head(description, 200).alias("description"), url.alias("url"))


#: Answers that count, in lower case and without blanks around them; the last may go on.
YES, NO, UNCLEAR = "yes", "no", "i don't understand"


def answered(answer: Column) -> Column:
    a = F.lower(F.trim(answer))
    return F.coalesce((a == YES) | (a == NO) | a.startswith(UNCLEAR), F.lit(False))


def response_validity(rows: DataFrame, name: str, answers: list[str]) -> DataFrame:
    """`rows` with `valid` and `reason`: no name, then no answer at all, then how many are missing and the first three."""
    missing = F.array_compact(F.array(*(F.when(~answered(F.col(a)), F.lit(a)) for a in answers)))
    no_name = F.trim(F.coalesce(F.col(name), F.lit(""))) == ""
    reason = (
        F.when(no_name, "Missing repository name")
        .when(F.size("missing") == len(answers), "All patterns unanswered")
        .when(F.size("missing") > 0, F.concat(F.size("missing").cast("string"), F.lit(" pattern(s) unanswered: "), F.array_join(F.slice("missing", 1, 3), ", ")))
    )
    return rows.withColumn("missing", missing).withColumn("reason", reason).withColumn("valid", F.col("reason").isNull()).drop("missing")


def reason_histogram(validated: DataFrame) -> DataFrame:
    """How often each reason occurs, most frequent first."""
    return validated.where(~F.col("valid")).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def confident(score: Column, threshold: int = 5) -> Column:
    """Whether a verdict's confidence, from 0 to 10, reaches the threshold; none doesn't."""
    return F.coalesce(score >= threshold, F.lit(False))


def looks_like_text(size_mb: Column, content: Column, max_mb: float = 10.0) -> Column:
    """Not too large, and at least 10 characters in the first 1000 without the blanks at either end. A null text is empty."""
    head = F.regexp_replace(F.substring(F.coalesce(content, F.lit("")), 1, 1000), r"(?U)^\s+|\s+$", "")
    return (size_mb <= max_mb) & (F.length(head) >= 10)


def has_words(size_mb: Column, content: Column, max_mb: float = 10.0) -> Column:
    """Not too large, and at least 10 characters in the first 1000 that aren't blanks, wherever these stand. Null for a null text."""
    return (size_mb <= max_mb) & (F.length(F.regexp_replace(F.substring(content, 1, 1000), r"[\t\n\f\r ]", "")) >= 10)


def sane_files(files: DataFrame, max_mb: float = 10.0) -> DataFrame:
    """The files of a scan (path, length in bytes, text; see `readers.folder`) that are worth reading."""
    return files.where(looks_like_text(F.col("length") / (1024 * 1024), F.col("text"), max_mb))
