"""Readers of JSON lines, reports, CSV, YAML, folders of files and event logs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import globs
from quarrymill.sources import schemas
from quarrymill.sources.tables import cut


def archive_names(spark: SparkSession, path: str) -> DataFrame:
    """Distinct repository names of an event archive (JSON lines, gzip or not); malformed lines are skipped."""
    events = spark.read.schema(schemas.ARCHIVE_EVENT).option("mode", "DROPMALFORMED").json(path)
    return events.select(F.col("repo.name").alias("name")).where(F.col("name").isNotNull() & (F.col("name") != "")).distinct()


def repositories(spark: SparkSession, path: str, corrupt: bool = False) -> DataFrame:
    """Repository documents from JSON lines. corrupt: also the column `_corrupt_record` of lines that aren't JSON; else they are left out."""
    rows = spark.read.schema(f"{schemas.REPOSITORY}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    # the second half is always true: it keeps a count from reading the corrupt column alone, which Spark refuses
    sound = F.col("_corrupt_record").isNull() & (F.col("name").isNull() | (F.length("name") >= 0))
    return rows if corrupt else rows.where(sound).drop("_corrupt_record")


def flat_repositories(repos: DataFrame) -> DataFrame:
    """The columns that the quality gate reads."""
    return repos.select(
        "name",
        F.col("metadata.created_at").alias("created_at"),
        F.coalesce("metadata.stargazers_count", F.lit(0)).alias("stars"),
        F.coalesce("metadata.size", F.lit(0)).alias("size"),
        F.col("metadata.language").alias("language"),
        F.col("metadata.description").alias("description"),
        F.col("metadata.url").alias("url"),
        F.col("contributors_data").alias("contributors"),
        F.col("file_tree_data").alias("file_tree"),
        F.coalesce("recent_commits_count_3_months", F.lit(0)).alias("recent_commits"),
    )


def contributors(repos: DataFrame) -> DataFrame:
    """One row for each (repository, login): contributions, emails and position in the document."""
    return repos.select("name", F.posexplode(F.map_entries("contributors_data")).alias("position", "e")).select("name", "position", F.col("e.key").alias("login"), F.col("e.value.contributions").alias("contributions"), F.col("e.value.emails").alias("emails"))


def committer_emails(commits: DataFrame) -> DataFrame:
    """repo, login, emails: distinct addresses of each committer (else author) of a repository's commits; nulls dropped."""
    login = F.coalesce("committer_login", "author_login")
    return commits.where(login.isNotNull() & F.col("email").isNotNull()).groupBy("repo", login.alias("login")).agg(F.sort_array(F.collect_set("email")).alias("emails"))


def last_wins(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """The union of files in order; of equal, non-blank keys the last file's row, and in it the last one, stays."""
    both = None
    for n, part in enumerate(parts):
        part = part.withColumn("__seq", F.struct(F.lit(n), F.monotonically_increasing_id()))
        both = part if both is None else both.unionByName(part)
    values = [c for c in both.columns if c not in (key, "__seq")]
    best = both.where(F.trim(F.coalesce(F.col(key), F.lit(""))) != "").groupBy(key).agg(F.max_by(F.struct(*values), "__seq").alias("r"))
    return best.select(key, *(F.col("r")[c].alias(c) for c in values))


def survey(spark: SparkSession, path: str, keys: Sequence[str] = ()) -> DataFrame:
    """A CSV of strings without rows that are all null, or null in all of `keys` (prefixes of column names)."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    some = lambda names: F.coalesce(*(F.col(f"`{c}`") for c in names)).isNotNull()  # noqa: E731  names may have dots
    found = [c for k in keys for c in columns_by_prefix(rows.columns, k)]
    return rows.where(some(rows.columns) & some(found)) if found else rows.where(some(rows.columns))


def columns_by_prefix(columns: Sequence[str], prefix: str) -> list[str]:
    """Columns that begin with the prefix; if none does, those that do in any case."""
    exact = [c for c in columns if c.startswith(prefix)]
    return exact or [c for c in columns if c.lower().startswith(prefix.lower())]


def unpivot_answers(rows: DataFrame, key: str, answers: Sequence[str]) -> DataFrame:
    """key, question, answer."""
    return rows.unpivot([F.col(f"`{key}`")], [F.col(f"`{a}`") for a in answers], "question", "answer")


def reports(spark: SparkSession, path: str) -> DataFrame:
    """Detection reports, one JSON object in each file; a file that isn't one is left out."""
    rows = spark.read.schema(f"{schemas.REPORT}, _corrupt_record string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return rows.withColumn("file", F.input_file_name()).where(F.col("_corrupt_record").isNull() & F.col("summary").isNotNull()).drop("_corrupt_record")


def select_reports(rows: DataFrame, repositories: Sequence[str] | None = None, judge: int | None = None, scheme: str | None = None, run: int | None = None, phase: str | None = None) -> DataFrame:
    """Reports that meet all given criteria."""
    config = "_metadata.reproducibility.configuration"
    wanted = [(judge, F.col(f"{config}.thresholds.judge_confidence")), (scheme, F.col(f"{config}.weight_scheme")), (run, F.col("_metadata.experiment.run_number")), (phase, F.col("_metadata.experiment.phase"))]
    for value, column in wanted:
        if value is not None:
            rows = rows.where(column == value)
    return rows.where(F.col("summary.repository_name").isin(list(repositories))) if repositories is not None else rows


def detections(rows: DataFrame) -> DataFrame:
    """repo, pattern, detected: for each scanned pattern of a report, whether it is among the detected ones."""
    long = rows.select(F.col("summary.repository_name").alias("repo"), F.col("summary.timestamp").alias("ts"), F.coalesce("summary.detected_patterns", F.array()).alias("found"), F.explode(F.map_keys("scanned_files_per_pattern")).alias("pattern"))
    return long.select("repo", "ts", "pattern", F.array_contains("found", F.col("pattern")).alias("detected"))


def scanned_files(rows: DataFrame) -> DataFrame:
    """repo, pattern, file: the files that reports list."""
    pairs = rows.select(F.col("summary.repository_name").alias("repo"), F.explode("scanned_files_per_pattern").alias("pattern", "files"))
    return pairs.select("repo", "pattern", F.explode("files").alias("file"))


def detection_log(spark: SparkSession, path: str) -> DataFrame:
    """A detection log: the wide schema, and `seq`, the order of lines."""
    rows = spark.read.schema(schemas.DETECTION_EVENT).option("mode", "DROPMALFORMED").json(path)
    return rows.withColumn("file_path", F.input_file_name()).withColumn("seq", F.monotonically_increasing_id())


def paired_logs(paths: DataFrame) -> DataFrame:
    """stamp, detection, operations: logs that share the timestamp in their names. paths: path."""
    of = lambda kind: paths.select(F.regexp_extract("path", rf"{kind}_([0-9_\-T]+)\.log$", 1).alias("stamp"), F.col("path").alias(kind)).where("stamp <> ''")
    return of("detection").join(of("operations"), "stamp")


def target_of(log_text: Column) -> Column:
    return F.regexp_extract(log_text, r"(?m)Target:\s+(.+)$", 1)


def folder(spark: SparkSession, path: str, exclude: Sequence[str] = globs.EXCLUDED_PATHS) -> DataFrame:
    """path (relative to the folder), length, text of all files below a folder but the excluded ones.

    Text is UTF-8; bytes that are not are read as Latin-1, which never fails. Excluded paths are filtered before contents are read.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = path.rstrip("/") + "/"
    relative = F.regexp_replace(F.col("path"), "^.*?" + "".join("\\" + c if not c.isalnum() and c not in "/_-" else c for c in root), "")
    kept = rows.withColumn("path", relative).where(~globs.excluded(F.col("path"), tuple(exclude))) if exclude else rows.withColumn("path", relative)
    return kept.select("path", "length", decoded(F.col("content")).alias("text"))


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 if they are, else as Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


#: What a rule may search by.
METHODS = ("keyword", "embedding", "hybrid")


_PATTERN_ROW = "part string, pattern string, description string, rule_no int, glob string, priority string, search_method string, keyword string, kind string, example_index int, text string, problem string"
#: The tables of declared patterns and their columns.
PATTERN_TABLES = {
    "pattern": ("pattern", "description"),
    "rule": ("pattern", "rule_no", "glob", "priority", "search_method"),
    "keyword": ("pattern", "rule_no", "keyword", "kind"),
    "example": ("pattern", "kind", "example_index", "text"),
    "problem": ("pattern", "problem"),
}


def _pattern_rows(name: str, body: str | None) -> Iterator[dict]:
    """The rows that one YAML text declares. name: what it is called if it has no name of its own."""
    import yaml

    try:
        data = yaml.safe_load(body or "") or {}
    except yaml.YAMLError as e:
        data, errors = {}, [f"not YAML: {type(e).__name__}"]
    else:
        errors = pattern_problems(data)
    name = str(data.get("pattern_name") or name) if isinstance(data, dict) else name
    yield from ({"part": "problem", "pattern": name, "problem": e} for e in errors)
    if any(not e.startswith("WARNING") for e in errors):
        return
    yield {"part": "pattern", "pattern": name, "description": str(data["description"])}
    for i, rule in enumerate(data["repository_fingerprint"]["glob_patterns"]):
        yield {"part": "rule", "pattern": name, "rule_no": i, "glob": rule["glob"], "priority": rule.get("analysis_priority") or "low", "search_method": rule["search_method"]}
        for field, kind in (("keywords", "pos"), ("anti_keywords", "anti")):
            yield from ({"part": "keyword", "pattern": name, "rule_no": i, "keyword": str(k), "kind": kind} for k in rule.get(field) or [])
    for kind in ("positive", "negative"):
        yield from ({"part": "example", "pattern": name, "kind": kind, "example_index": i, "text": str(t)} for i, t in enumerate(data.get(f"{kind}_examples") or []))


def patterns_of(files: DataFrame) -> dict[str, DataFrame]:
    """Declared patterns from YAML files (path, text), as `folder` reads them: the tables pattern, rule, keyword, example and problem.

    problem lists what is wrong with each pattern; those that start with WARNING don't keep it out. The others keep the
    whole pattern out of the first four tables. A file without a name of its own goes by its path.
    """
    columns = [c.split()[0] for c in _PATTERN_ROW.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [r for path, text in zip(part["path"], part["text"], strict=True) for r in _pattern_rows(path, text)]
            yield pd.DataFrame([[r.get(c) for c in columns] for r in rows], columns=columns).astype({"rule_no": "Int32", "example_index": "Int32"})

    rows = cut(files.select("path", "text").mapInPandas(run, _PATTERN_ROW))
    return {part: rows.where(F.col("part") == part).select(*names) for part, names in PATTERN_TABLES.items()}


def patterns(spark: SparkSession, texts: Sequence[str]) -> dict[str, DataFrame]:
    """Declared patterns from YAML texts; see `patterns_of`. A text without a name goes by its number."""
    return patterns_of(spark.createDataFrame([(f"#{i}", t) for i, t in enumerate(texts)], "path string, text string"))


def pattern_problems(data: object) -> list[str]:
    """What is wrong with a declared pattern."""
    if not isinstance(data, dict):
        return ["not a mapping"]
    out = [f"missing {k}" for k in ("pattern_name", "description", "repository_fingerprint") if not data.get(k)]
    rules = (data.get("repository_fingerprint") or {}).get("glob_patterns") if isinstance(data.get("repository_fingerprint"), dict) else None
    if not rules:
        out.append("no glob_patterns")
    for i, rule in enumerate(rules or []):
        if not rule.get("glob"):
            out.append(f"rule {i}: no glob")
        if rule.get("search_method") not in METHODS:
            out.append(f"rule {i}: search_method is none of {', '.join(METHODS)}")
        if rule.get("analysis_priority") not in (None, "high", "low"):
            out.append(f"rule {i}: analysis_priority is neither high nor low")
        if rule.get("search_method") in ("keyword", "hybrid") and not rule.get("keywords"):
            out.append(f"WARNING: rule {i}: no keywords")
    for kind in ("positive", "negative"):
        given = data.get(f"{kind}_examples")
        if not given:
            out.append(f"WARNING: no {kind}_examples")
        out += [f"{kind} example {i}: under 20 characters" for i, t in enumerate(given or []) if len(str(t)) < 20]
    return out


def distinct_globs(rules: DataFrame) -> DataFrame:
    return rules.select("glob").distinct()
