"""Whole records, logs, and what is written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import globs, rates
from quarrymill.functions import text as T
from quarrymill.operators import evaluate, quality_gate, relevance, shares, stats
from quarrymill.plans.evaluation import _COUNTS, _O, _RATES, outcome_rows, rounded
from quarrymill.plans.registry import query
from quarrymill.sources import read_table, readers, schemas, sinks
from quarrymill.sources.tables import ensure_checkpoint_dir, spread
from quarrymill.streaming import event_fold


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for what a query writes and reads again, where driver and executors share one."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _text(c: Column) -> Column:
    return c.cast("string")


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as repository documents: up to five contributors, some with addresses that can't be written to, and up to four Python files."""
    k = F.col("c_custkey")
    address = F.when(k % 4 == 0, "noreply@x.org").otherwise(F.concat(F.lit("u"), _text(k), F.lit("@mail.example.com")))
    person = lambda i: F.struct(F.concat(F.lit("u"), _text(i)).alias("key"), F.struct((i * 10).cast("long").alias("contributions"), F.array(address).alias("emails")).alias("value"))
    people = F.map_from_entries(F.transform(F.filter(F.sequence(F.lit(1), F.lit(5)), lambda i: i <= k % 6), person))
    file = lambda i: F.struct(F.concat(F.lit("src/f"), _text(i), F.when(i <= k % 5, ".py").otherwise(".md")).alias("path"), F.lit("blob").alias("type"))
    about = F.struct(F.lit("2020-01-01T00:00:00Z").alias("created_at"), (k % 40).alias("stargazers_count"), F.col("c_acctbal").cast("long").alias("size"), F.col("c_mktsegment").alias("language"), F.lit("words").alias("description"), F.lit("http://x.org").alias("url"))
    return spread(read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), "c_custkey").select(F.concat(F.lit("repo"), _text(k)).alias("name"), about.alias("metadata"), people.alias("contributors_data"), F.transform(F.sequence(F.lit(1), F.lit(6)), file).alias("file_tree_data"), (k % 3).alias("recent_commits_count_3_months"))


CONFIG = quality_gate.GateConfig(as_of="2021-01-01", min_stars=10, min_age_months=6, min_contributors=3, min_recent_commits=1, min_size=0, max_size=5000, min_pattern_files=2, patterns=("**/*.py",))
_REPO = """r AS (SELECT c_custkey AS k, concat('repo', c_custkey) AS name, CAST(trunc(c_acctbal) AS BIGINT) AS size, c_mktsegment AS language FROM customer),
        g AS (SELECT *, k % 40 >= 10 AS f1, k % 6 >= 3 AS f3, k % 3 >= 1 AS f4, size >= 0 AND size <= 5000 AS f5, k % 5 >= 2 AS f6, k % 6 > 0 AND k % 4 <> 0 AS f7 FROM r),
        f AS (SELECT *, array_to_string(list_filter([CASE WHEN NOT f1 THEN 'stars' END, CASE WHEN NOT f3 THEN 'contributors' END, CASE WHEN NOT f4 THEN 'recent_commits' END, CASE WHEN NOT f5 THEN 'size' END,
          CASE WHEN NOT f6 THEN 'file_extensions' END, CASE WHEN NOT f7 THEN 'valid_emails' END], lambda x: x IS NOT NULL), ',') AS failed FROM g)"""


@query(f"WITH {_REPO} SELECT name, failed, CAST(k % 6 AS DOUBLE) AS contributors, CAST(k % 5 AS DOUBLE) AS files, CAST(CASE WHEN f7 THEN 1 ELSE 0 END AS DOUBLE) AS emails FROM f")
def seven_check_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven checks of the gate over repository documents that were written as JSON lines and read again."""
    where = scratch(spark, "repositories")
    repositories(spark, sf_dir).write.json(where)
    audited = quality_gate.audit(readers.flat_repositories(readers.repositories(spark, where)), CONFIG)
    return audited.select("name", F.array_join("failed_filters", ",").alias("failed"), *(F.col(f"filters.{c}.actual").alias(n) for c, n in (("contributors", "contributors"), ("file_extensions", "files"), ("valid_emails", "emails"))))


@query(f"WITH {_REPO} SELECT name, failed AS failed_filters, 'log' AS side FROM f UNION ALL SELECT name, NULL, 'passing' FROM f WHERE failed = ''")
def gate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gate writes - passing records and the decision log - as it reads again."""
    where = scratch(spark, "gate")
    audited = quality_gate.audit(readers.flat_repositories(repositories(spark, sf_dir)), CONFIG)
    sinks.write_gate(audited, f"{where}/passing", f"{where}/log", F.col("name"), ["name", "stars"])
    log = spark.read.schema("repository string, status string, failed_filters array<string>").json(f"{where}/log")
    passing = spark.read.schema("name string, stars bigint").json(f"{where}/passing")
    return log.select(F.col("repository").alias("name"), F.array_join(F.coalesce("failed_filters", F.array().cast("array<string>")), ",").alias("failed_filters"), F.lit("log").alias("side")).union(passing.select("name", F.lit(None).cast("string"), F.lit("passing")))


@query("""SELECT concat('repo', c_custkey) AS name, concat('u', i) AS login, CAST(i * 10 AS BIGINT) AS contributions, CAST(i - 1 AS INTEGER) AS position FROM customer, range(1, 6) r(i) WHERE i <= c_custkey % 6""")
def contributor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.contributors(repositories(spark, sf_dir)).select("name", "login", "contributions", "position")


@query("SELECT DISTINCT concat('r', user_id) AS name FROM events WHERE event_id % 5 <> 0")
def archive_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive of gzip JSON lines: some without a name, some no JSON."""
    where = scratch(spark, "archive")
    n = F.col("event_id")
    line = F.when(n % 10 == 0, "{broken").when(n % 5 == 0, '{"repo": {"name": ""}}').otherwise(F.format_string('{"repo": {"name": "r%s"}, "type": "x"}', _text(F.col("user_id"))))
    read_table(spark, sf_dir, "events").select(line.alias("value")).write.option("compression", "gzip").text(where)
    return readers.archive_names(spark, where)


@query("""WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'yes, "so"' WHEN o_orderkey % 3 = 1 THEN 'no' END AS a, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS b FROM orders),
        u AS (SELECT 'Q1[a]. first' AS question, a AS answer FROM s WHERE a IS NOT NULL OR b IS NOT NULL UNION ALL SELECT 'q1[b]. second', b FROM s WHERE a IS NOT NULL OR b IS NOT NULL)
        SELECT question, answer, CAST(count(*) AS BIGINT) AS n FROM u GROUP BY ALL""")
def survey_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A survey written as CSV, read without empty answers, and turned into rows."""
    where = scratch(spark, "survey")
    n = F.col("o_orderkey")
    rows = read_table(spark, sf_dir, "orders").select(n.alias("id"), F.when(n % 3 == 0, 'yes, "so"').when(n % 3 == 1, "no").alias("Q1[a]. first"), F.when(n % 5 != 0, F.col("o_orderpriority")).alias("q1[b]. second"))
    rows.write.option("header", True).option("escape", '"').csv(where)
    read = readers.survey(spark, where, ["Q1[a]", "q1[b]"])
    answers = [c for k in ("Q1[a]", "Q1[b]") for c in readers.columns_by_prefix(read.columns, k)]
    return readers.unpivot_answers(read, "id", answers).groupBy("question", "answer").agg(F.count("*").alias("n"))


@query("""SELECT concat('repo', s_nationkey) AS repo, concat('p', s_suppkey % 4) AS pattern, bool_or(s_acctbal > 5000) AS detected, CAST(count(DISTINCT s_suppkey) AS BIGINT) AS n_files FROM supplier GROUP BY ALL""")
def nested_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested report for each nation, written as JSON files of one object each, read, and unfolded again."""
    where = scratch(spark, "reports")
    rows = read_table(spark, sf_dir, "supplier").select(F.concat(F.lit("repo"), _text(F.col("s_nationkey"))).alias("repo"), F.concat(F.lit("p"), _text(F.col("s_suppkey") % 4)).alias("pattern"), (F.col("s_acctbal") > 5000).alias("hit"), F.concat(F.lit("f"), _text(F.col("s_suppkey"))).alias("file"))
    detections = rows.groupBy("repo", "pattern").agg(F.bool_or("hit").alias("detected"))
    sinks.nested_reports(detections, rows, "run1", {"weight_scheme": "base"}).write.option("maxRecordsPerFile", 1).json(where)
    reports = readers.reports(spark, where)
    files = readers.scanned_files(reports).groupBy("repo", "pattern").agg(F.count("*").alias("n_files"))
    return readers.detections(reports).select("repo", "pattern", "detected").join(files, ["repo", "pattern"]).select("repo", "pattern", "detected", "n_files")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = scratch(spark, "csv")
    sinks.write_csv(read_table(spark, sf_dir, "nation"), where, ["n_nationkey", "n_name"])
    return spark.read.option("header", True).csv(where)


@query("SELECT concat(rpad(CAST(n_nationkey AS VARCHAR), 4, ' '), rpad(n_name, 10, ' ')) AS value FROM nation")
def fixed_width_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = scratch(spark, "text")
    sinks.fixed_width(read_table(spark, sf_dir, "nation"), {"n_nationkey": 4, "n_name": 10}).write.text(where)
    return spark.read.text(where)


@query("""WITH c AS (SELECT event_id AS claim_id, CASE event_id % 5 WHEN 0 THEN concat('Dir', user_id % 7, '/F', user_id % 31, '.py') WHEN 1 THEN concat('dir', user_id % 7, '/f', user_id % 31, '.py') WHEN 2 THEN concat('f', user_id % 31, '.py')
          WHEN 3 THEN concat('root/dir', user_id % 7, '/f', user_id % 31, '.py') ELSE concat('none', user_id, '.py') END AS claimed FROM events),
        r AS (SELECT concat('dir', p_partkey % 7, '/f', p_partkey % 31, '.py') AS path, min(p_partkey) AS seq FROM part GROUP BY 1), k AS (SELECT DISTINCT claimed FROM c),
        j AS (SELECT claimed, path, seq, CASE WHEN claimed = path THEN 1 WHEN lower(claimed) = path THEN 2 WHEN ends_with(path, concat('/', lower(claimed))) OR ends_with(lower(claimed), concat('/', path)) THEN 3 ELSE 4 END AS stage
          FROM k JOIN r ON lower(regexp_extract(claimed, '[^/]*$')) = regexp_extract(path, '[^/]*$')),
        b AS (SELECT claimed, path, stage FROM j QUALIFY row_number() OVER (PARTITION BY claimed ORDER BY stage, seq) = 1)
        SELECT c.claim_id, c.claimed, b.path, CAST(b.stage AS INTEGER) AS stage FROM c LEFT JOIN b USING (claimed)""")
def claimed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as they were claimed, once for every claim, and those that don't resolve with null."""
    u, n, p = F.col("user_id"), F.col("event_id") % 5, F.col("p_partkey")
    path = lambda head, mid, x: F.concat(F.lit(head), _text(x % 7), F.lit(mid), _text(x % 31), F.lit(".py"))
    claimed = F.when(n == 0, path("Dir", "/F", u)).when(n == 1, path("dir", "/f", u)).when(n == 2, F.concat(F.lit("f"), _text(u % 31), F.lit(".py"))).when(n == 3, path("root/dir", "/f", u)).otherwise(F.concat(F.lit("none"), _text(u), F.lit(".py")))
    real = read_table(spark, sf_dir, "part").groupBy(path("dir", "/f", p).alias("path")).agg(F.min("p_partkey").alias("seq"))
    return relevance.resolve_paths(read_table(spark, sf_dir, "events").select(F.col("event_id").alias("claim_id"), claimed.alias("claimed")), real)


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of 40 logs: sessions with and without a run, and scored files of three patterns."""
    t, n = F.col("event_type"), F.col("event_id")
    kind = F.when(t == "signup", "session_start").when(t == "purchase", "investigation_phase_complete").when(t == "error", "pattern_verdict").otherwise("file_scored")
    return read_table(spark, sf_dir, "events").select(
        F.concat(F.lit("log"), _text(F.col("user_id") % 40)).alias("file_path"), n.alias("seq"), kind.alias("event"), F.when((t == "signup") & (n % 3 != 0), F.concat(F.lit("run"), _text(n))).alias("run_id"),
        F.concat(F.lit("p"), _text(n % 3)).alias("pattern"), F.concat(F.lit("f"), _text(n % 20)).alias("file"), F.floor("value").alias("files_analyzed"), F.lit(0).cast("long").alias("evidence_found"), (F.col("value") > 50).alias("detected"),
    )


_LOG = """l AS (SELECT concat('log', user_id % 40) AS file_path, event_id AS seq, CASE event_type WHEN 'signup' THEN 'session_start' WHEN 'purchase' THEN 'investigation_phase_complete' WHEN 'error' THEN 'pattern_verdict' ELSE 'file_scored' END AS event,
          CASE WHEN event_type = 'signup' AND event_id % 3 <> 0 THEN concat('run', event_id) END AS run_id, concat('p', event_id % 3) AS pattern, concat('f', event_id % 20) AS file, value FROM events),
        w AS (SELECT *, last_value(run_id IGNORE NULLS) OVER (PARTITION BY file_path ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM l)"""


@query(f"WITH {_LOG} SELECT seq, run, concat('repo', CAST(substr(run, 4) AS BIGINT) % 11) AS repo FROM w WHERE run IS NOT NULL AND CAST(substr(run, 4) AS BIGINT) % 2 = 0")
def run_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines with the run that they belong to, joined to the table of runs and repositories; runs that it lacks drop out."""
    n = F.col("event_id")
    runs = read_table(spark, sf_dir, "events").where((n % 3 != 0) & (n % 2 == 0) & (F.col("event_type") == "signup")).select(F.concat(F.lit("run"), _text(n)).alias("run"), F.concat(F.lit("repo"), _text(n % 11)).alias("repo"))
    return event_fold.with_run(log_lines(spark, sf_dir)).select("seq", "run").join(runs, "run").select("seq", "run", "repo")


@query(f"""WITH {_LOG} SELECT run, pattern, CAST(count(*) FILTER (event = 'file_scored') AS INTEGER) AS n_files, coalesce(arg_max(CAST(floor(value) AS BIGINT), seq) FILTER (event = 'investigation_phase_complete'), 0) AS files_analyzed,
        coalesce(arg_max(value > 50, seq) FILTER (event = 'pattern_verdict'), false) AS detected FROM w WHERE run IS NOT NULL GROUP BY ALL""")
def ungated_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold that needs no start of a pattern and keeps repeated files."""
    return event_fold.pattern_reports(event_fold.with_run(log_lines(spark, sf_dir)), gated=False).select("run", "pattern", "n_files", "files_analyzed", "detected")


@query("""SELECT CAST(sum(CASE WHEN value > 50 AND event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN value > 50 AND event_type <> 'error' THEN 1 ELSE 0 END) AS BIGINT) AS fp,
        CAST(sum(CASE WHEN value <= 50 AND event_type <> 'error' THEN 1 ELSE 0 END) AS BIGINT) AS tn, CAST(sum(CASE WHEN value <= 50 AND event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM events""")
def stream_evolution_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that a stream adds up batch by batch, as they are after the last."""
    where = scratch(spark, "evolution")
    found, true = F.col("value") > 50, F.col("event_type") == "error"
    cells = {"tp": found & true, "fp": found & ~true, "tn": ~found & ~true, "fn": ~found & true}
    read_table(spark, sf_dir, "events").select(*(c.cast("long").alias(n) for n, c in cells.items()), (F.col("event_id") % 3).alias("part")).repartition(3, "part").drop("part").write.parquet(f"{where}/in")
    event_fold.stream_evolution(spark, f"{where}/in", "tp long, fp long, tn long, fn long", f"{where}/out", f"{where}/state")
    return event_fold.evolution_so_far(spark, f"{where}/out").agg(*(F.max_by(c, "batch").alias(c) for c in cells))


@query("""SELECT CAST(t AS INTEGER) AS threshold, CAST(count(*) FILTER (floor(value / 10) >= t) AS BIGINT) AS kept FROM events, range(5, 10) r(t) GROUP BY 1""")
def confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many verdicts each of the five thresholds keeps, in one pass."""
    verdicts = read_table(spark, sf_dir, "events").select(F.floor(F.col("value") / 10).alias("confidence_score"))
    return verdicts.agg(*(F.count_if(quality_gate.confident(F.col("confidence_score"), t)).alias(str(t)) for t in range(5, 10))).unpivot([], [str(t) for t in range(5, 10)], "threshold", "kept").select(F.col("threshold").cast("int").alias("threshold"), "kept")


@query("SELECT event_type AS phase, CAST(count(*) AS BIGINT) AS n, round(count(*) * 0.10::DOUBLE, 6) AS cost FROM events GROUP BY 1")
def phase_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(shares.phase_cost(read_table(spark, sf_dir, "events"), "event_type").withColumnRenamed("event_type", "phase"), "cost")


@query(f"""WITH {_O}, c AS (SELECT source, {_COUNTS} FROM o GROUP BY source), m AS (SELECT source, {_RATES} FROM c),
        n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), d AS (SELECT source, max(n * k / t) AS dominance FROM (SELECT source, n::DOUBLE AS n, count(*) OVER (PARTITION BY source) AS k, sum(n) OVER (PARTITION BY source) AS t FROM n) GROUP BY 1),
        p AS (SELECT source, 100 * count(*) FILTER (truth) / count(*)::DOUBLE AS prevalence FROM o GROUP BY 1)
        SELECT source, f1, round(dominance, 6) AS dominance, round(prevalence, 6) AS prevalence FROM m JOIN d USING (source) JOIN p USING (source)""")
def metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, the largest dominance and the prevalence of each source, side by side."""
    rows = outcome_rows(spark, sf_dir)
    f1 = rounded(evaluate.with_rates(evaluate.confusion(rows, ["source"])), "f1").select("source", "f1")
    dominance = stats.dominance(read_table(spark, sf_dir, "documents"), "source", "lang").groupBy("source").agg(F.max("dominance").alias("dominance"))
    prevalence = rows.groupBy("source").agg(rates.percent(F.count_if("truth"), F.count("*")).alias("prevalence"))
    return rounded(evaluate.side_by_side([f1, dominance, prevalence], "source"), "dominance", "prevalence")


@query("""SELECT event_type, CAST(count(*) FILTER (value > 90) AS BIGINT) AS n_evidence, round(count(*) FILTER (value > 90) / (sum(value) / 100)::DOUBLE, 6) AS per_second FROM events GROUP BY 1""")
def evidence_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of evidence for each second that files took."""
    rows = read_table(spark, sf_dir, "events")
    return rounded(shares.evidence_rate(rows, "event_type", F.col("value") > 90, F.col("value") / 100), "per_second")


@query("""WITH t AS (SELECT page_id, concat('a/', CASE page_id % 3 WHEN 0 THEN 'src' WHEN 1 THEN 'test' ELSE 'node_modules' END, '/f', page_id, CASE page_id % 2 WHEN 0 THEN '.py' ELSE '.js' END) AS path FROM pages)
        SELECT page_id, path, page_id % 3 = 2 AS excluded, page_id % 2 = 0 AS matched FROM t""")
def path_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which paths are excluded, and which a reduced glob matches."""
    n = F.col("page_id")
    path = F.concat(F.lit("a/"), F.when(n % 3 == 0, "src").when(n % 3 == 1, "test").otherwise("node_modules"), F.lit("/f"), _text(n), F.when(n % 2 == 0, ".py").otherwise(".js"))
    rows = read_table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return rows.select("page_id", "path", globs.excluded(F.col("path"), ("**/node_modules/**",)).alias("excluded"), globs.matches_reduced(F.col("path"), globs.reduce_glob(F.lit("**/*.py"))).alias("matched"))


@query("""SELECT doc_id, CASE WHEN length(text) > 500 THEN concat(substr(text, 1, 250), '...', substr(text, length(text) - 249)) ELSE text END AS short FROM documents""")
def squeezed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", T.squeeze(F.col("text"), 500, "...").alias("short"))


@query("""SELECT concat('repo', s_suppkey) AS repo, CAST(s_suppkey % 4 AS BIGINT) AS run FROM supplier WHERE s_suppkey % 3 = 1 AND s_suppkey % 4 = 2""")
def selected_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of a folder, one object in each file, by threshold of the judge, scheme, run and phase; those without a summary are none."""
    where = scratch(spark, "reports")
    n = F.col("s_suppkey")
    configuration = F.struct(F.struct((n % 3 + 5).alias("judge_confidence")).alias("thresholds"), F.lit("base").alias("weight_scheme"))
    metadata = F.struct(F.struct((n % 4).alias("run_number"), F.lit("test").alias("phase")).alias("experiment"), F.struct(configuration.alias("configuration")).alias("reproducibility"))
    suppliers = spread(read_table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", each=1000)
    alone = {"maxRecordsPerFile": 1, "mapreduce.fileoutputcommitter.algorithm.version": "2"}  # tasks put their files in place, not the driver one by one
    suppliers.select(F.struct(F.concat(F.lit("repo"), _text(n)).alias("repository_name")).alias("summary"), metadata.alias("_metadata")).write.options(**alone).json(f"{where}/a")
    suppliers.select(n.alias("other")).write.options(**alone).json(f"{where}/b")
    found = readers.select_reports(readers.reports(spark, where), judge=6, scheme="base", run=2, phase="test")
    return found.select(F.col("summary.repository_name").alias("repo"), F.col("_metadata.experiment.run_number").alias("run"))


_EVENT = "['run_summary', 'session_start', 'session_end', 'pattern_analysis_start', 'pattern_analysis_end', 'file_scored', 'prioritization_complete', 'file_investigated', 'evidence_accepted', 'investigation_phase_complete', 'deliberation_start', 'pattern_verdict', 'error', 'warning', 'performance_metric', 'llm_call', 'graph_built', 'graph_stats', 'negative_evidence'][event_id % 19 + 1]"


@query(f"""SELECT {_EVENT} AS event, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS duration, CAST(count(*) FILTER (value > 50) AS BIGINT) AS detected FROM events GROUP BY 1""")
def event_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log with every kind of event, written as JSON lines and read under the one wide schema."""
    where = scratch(spark, "log")
    kind = F.element_at(F.array(*map(F.lit, schemas.EVENT_KINDS)), (F.col("event_id") % len(schemas.EVENT_KINDS) + 1).cast("int"))
    lines = read_table(spark, sf_dir, "events").select(kind.alias("event"), F.col("value").alias("duration_seconds"), (F.col("value") > 50).alias("detected"), F.lit("x").alias("unknown_field"))
    lines.write.json(where)
    return readers.detection_log(spark, where).groupBy("event").agg(F.count("*").alias("n"), F.round(F.sum("duration_seconds"), 4).alias("duration"), F.count_if("detected").alias("detected"))
