"""Small functions and sources that no larger query shows by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import globs, rates
from quarrymill.functions import text as T
from quarrymill.operators import quality_gate, relevance, shares, stats, vectors
from quarrymill.plans.records import scratch
from quarrymill.plans.registry import query
from quarrymill.sources import readers, read_table


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN least(greatest(round(value / 50, 6), 0), 1) WHEN 1 THEN 1 ELSE 0 END AS confidence, printf('%.1f%%', coalesce(100 * (event_id % 3) / nullif(event_id % 7, 0)::DOUBLE, 0)) AS share,
        CASE event_id % 4 WHEN 0 THEN 'llm_dominant' WHEN 1 THEN 'llm_extreme' WHEN 2 THEN 'balanced' ELSE 'custom' END AS scheme,
        CASE WHEN event_id % 5 < 3 THEN 'insufficient' WHEN value / 100 > 0.3::DOUBLE THEN 'high_uncertainty' ELSE 'ok' END AS interval FROM events""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidences given as text, guarded percentages, names of weight schemes, flags of intervals."""
    n, v = F.col("event_id"), F.col("value")
    given = F.when(n % 4 == 0, F.round(v / 50, 6).cast("string")).when(n % 4 == 1, "7.5").when(n % 4 == 2, "-1").otherwise("about half")
    weight = F.when(n % 4 == 0, 0.705).when(n % 4 == 1, 0.90).when(n % 4 == 2, 0.295).otherwise(0.5)
    return read_table(spark, sf_dir, "events").select("event_id", rates.unit_interval(given).alias("confidence"), rates.percent_text(n % 3, n % 7).alias("share"), rates.scheme_name(weight).alias("scheme"), stats.interval_flag(n % 5, F.lit(0.0), v / 100).alias("interval"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('k: ', event_id) WHEN 1 THEN concat('a: ', event_id) WHEN 2 THEN concat('name: x', event_id, chr(10), 'kind: y') END AS block FROM events""")
def yaml_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """YAML in a tagged fence, in a plain one, as lines in prose, and none."""
    n = F.col("event_id").cast("string")
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.concat(F.lit("Here:\n```yaml\nk: "), n, F.lit("\n```\n"))).when(k == 1, F.concat(F.lit("So\n```\na: "), n, F.lit("\n```"))).when(k == 2, F.concat(F.lit("it is\nname: x"), n, F.lit("\nkind: y\n"))).otherwise("nothing of the sort")
    return read_table(spark, sf_dir, "events").select("event_id", T.yaml_block(text).alias("block"))


@query("""SELECT page_id, page_id % 3 = 0 AS by_suffix, page_id % 3 = 1 AS by_name FROM pages""")
def reduced_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths against a suffix and against a file name."""
    k = F.col("page_id") % 3
    path = F.concat(F.lit("d/"), F.when(k == 0, F.concat(F.lit("f"), F.col("page_id").cast("string"), F.lit(".proto"))).when(k == 1, "Dockerfile").otherwise("myDockerfile"))
    one = lambda glob: globs.matches_reduced(path, globs.reduce_glob(F.lit(glob)))
    return read_table(spark, sf_dir, "pages").select("page_id", one("**/*.proto").alias("by_suffix"), one("**/Dockerfile").alias("by_name"))


@query("""SELECT event_id, 1 <= event_id % 300 AND event_id % 300 < 200 AS identifier, event_id % 600 BETWEEN 1 AND 500 AS literal, event_id % 150 > 100 AS match FROM events""")
def length_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    of = lambda size, kind: T.sane_length(F.repeat(F.lit("x"), (n % size).cast("int")), kind)
    return read_table(spark, sf_dir, "events").select("event_id", of(300, "identifier").alias("identifier"), of(600, "literal").alias("literal"), of(150, "match").alias("match"))


@query("""SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL""")
def maps_and_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts as one map for each user, and as rows again."""
    counts = read_table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return shares.as_rows(shares.as_map(counts, "user_id", "event_type", "n", "kinds"), "user_id", "kinds", "event_type", "n")


@query("""SELECT concat('2024-01-', lpad(CAST(n_nationkey AS VARCHAR), 2, '0')) AS stamp, concat('logs/detection_2024-01-', lpad(CAST(n_nationkey AS VARCHAR), 2, '0'), '.log') AS detection, concat('logs/operations_2024-01-', lpad(CAST(n_nationkey AS VARCHAR), 2, '0'), '.log') AS operations,
        concat('/srv/', n_name) AS target FROM nation WHERE n_nationkey % 3 <> 0""")
def log_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of both kinds with one timestamp, and the folder that the second kind names."""
    day = F.lpad(F.col("n_nationkey").cast("string"), 2, "0")
    nations = read_table(spark, sf_dir, "nation")
    name = lambda kind: F.concat(F.lit(f"logs/{kind}_2024-01-"), day, F.lit(".log"))
    paths = nations.select(name("detection").alias("path")).union(nations.where("n_nationkey % 3 <> 0").select(name("operations")))
    target = nations.select(name("operations").alias("operations"), readers.target_of(F.concat(F.lit("INFO start\nINFO Target: /srv/"), "n_name", F.lit("\nend"))).alias("target"))
    return readers.paired_logs(paths).join(target, "operations").select("stamp", "detection", "operations", "target")


#: Two patterns that are sound, one that warns among them, and two that aren't; %1$s is the nation.
_PATTERNS = (
    "pattern_name: gateway%1$s\ndescription: d\nrepository_fingerprint:\n  glob_patterns:\n  - {glob: '**/*.py%1$s', search_method: keyword, keywords: [route, proxy], anti_keywords: [test], analysis_priority: high}\n  - {glob: 'Dockerfile', search_method: embedding}\npositive_examples: ['twenty characters or more of it']\nnegative_examples: ['twenty characters or more of that']\n",
    "pattern_name: warns%1$s\ndescription: d\nrepository_fingerprint: {glob_patterns: [{glob: '*.go', search_method: hybrid}]}\n",
    "pattern_name: wrong%1$s\ndescription: d\nrepository_fingerprint: {glob_patterns: [{glob: '*.go', search_method: guess}]}\n",
    "a: [%1$s",
)


@query("""WITH t(part, pattern, entry) AS (VALUES ('rule', 'gateway', '0 **/*.py@ high keyword'), ('rule', 'gateway', '1 Dockerfile low embedding'), ('rule', 'warns', '0 *.go low hybrid'), ('keyword', 'gateway', '0 proxy pos'), ('keyword', 'gateway', '0 route pos'), ('keyword', 'gateway', '0 test anti'),
        ('example', 'gateway', 'positive 0'), ('example', 'gateway', 'negative 0'), ('problem', '#', 'not YAML: ParserError'), ('problem', 'wrong', 'rule 0: search_method is none of keyword, embedding, hybrid'),
        ('problem', 'warns', 'WARNING: rule 0: no keywords'), ('problem', 'warns', 'WARNING: no positive_examples'), ('problem', 'warns', 'WARNING: no negative_examples'), ('problem', 'wrong', 'WARNING: no positive_examples'), ('problem', 'wrong', 'WARNING: no negative_examples'))
        SELECT part, concat(pattern, n_nationkey) AS pattern, replace(entry, '@', CAST(n_nationkey AS VARCHAR)) AS entry FROM t, nation
        UNION ALL SELECT DISTINCT 'glob', NULL, replace(g, '@', CAST(n_nationkey AS VARCHAR)) FROM (VALUES ('**/*.py@'), ('Dockerfile'), ('*.go')) v(g), nation""")
def declared_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """YAML files of each nation: the tables that their patterns give, and what is wrong with the others."""
    name = F.col("n_nationkey").cast("string")
    texts = F.array(*(F.format_string(t, name) for t in _PATTERNS))
    t = readers.patterns_of(read_table(spark, sf_dir, "nation").select(F.concat(F.lit("#"), name).alias("path"), F.explode(texts).alias("text")))
    rows = lambda part, name, entry: t[part].select(F.lit(name).alias("part"), "pattern", entry.alias("entry"))
    words = lambda *c: F.concat_ws(" ", *(F.col(x).cast("string") for x in c))
    every = rows("rule", "rule", words("rule_no", "glob", "priority", "search_method")).union(rows("keyword", "keyword", words("rule_no", "keyword", "kind"))).union(rows("example", "example", words("kind", "example_index"))).union(rows("problem", "problem", F.col("problem")))
    return every.union(readers.distinct_globs(t["rule"]).select(F.lit("glob"), F.lit(None).cast("string"), "glob"))


@query("""SELECT n_name AS folder, concat('nation ', n_nationkey, chr(10), 'é', chr(10)) AS text FROM nation WHERE n_name NOT IN ('NATION_1', 'NATION_7')""")
def scanned_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written below a folder for each nation, found again but for those of an excluded one."""
    where = scratch(spark, "folder")
    rows = read_table(spark, sf_dir, "nation")
    rows.select(F.col("n_name").alias("folder"), F.concat(F.lit("nation "), F.col("n_nationkey").cast("string"), F.lit("\né")).alias("value")).write.partitionBy("folder").text(where)
    found = readers.folder(spark, where, ["**/folder=NATION_1/**", "**/folder=NATION_7/**"])
    return found.select(F.regexp_extract("path", "folder=([^/]+)/", 1).alias("folder"), "text").where("folder <> ''")


@query("""WITH v AS (SELECT vec_id, label, CASE WHEN vec_id % 7 = 0 THEN 0 ELSE len(embedding) END AS n FROM embeddings) SELECT vec_id, CAST((SELECT max(n) FROM v) AS INTEGER) AS size, vec_id % 7 = 0 AS zero FROM v""")
def checked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with zeros where there is none."""
    rows = read_table(spark, sf_dir, "embeddings")
    size = rows.agg(F.max(F.size("embedding"))).first()[0]
    some = rows.select("vec_id", F.when(F.col("vec_id") % 7 != 0, F.col("embedding")).alias("embedding"))
    return vectors.checked(some, "embedding", size).select("vec_id", F.size("embedding").alias("size"), F.forall("embedding", lambda x: x == 0).alias("zero"))


@query("""WITH e AS (SELECT doc_id, sha256(concat(source, '-', lang, '-', doc_id % 50, '-', substr(coalesce(text, ''), 1, 50))) AS id, n_chars AS v FROM documents),
        s AS (SELECT id, min(v) AS v FROM e WHERE doc_id % 3 <> 0 GROUP BY 1), n AS (SELECT id, max(v) + 1000000 AS v FROM e WHERE doc_id % 2 = 0 GROUP BY 1)
        SELECT coalesce(n.id, s.id) AS id, coalesce(n.v, s.v) AS v FROM s FULL JOIN n ON s.id = n.id""")
def upserted_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples by deterministic ids: stored ones, and new ones that take the place of those with the same id."""
    d = F.col("doc_id")
    rows = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", (d % 50).cast("string").alias("place"), F.coalesce("text", F.lit("")).alias("text"), F.col("n_chars").alias("v"))
    rows = rows.select("doc_id", vectors.upsert_id("source", "lang", "place", "text").alias("id"), "v")
    stored = rows.where(d % 3 != 0).groupBy("id").agg(F.min("v").alias("v"))
    return vectors.upsert(stored, rows.where(d % 2 == 0).groupBy("id").agg((F.max("v") + 1000000).alias("v")))


@query("""SELECT doc_id AS path, CAST(strlen(text) AS BIGINT) AS length FROM documents WHERE strlen(text) / 1048576.0 <= 0.002 AND length(regexp_replace(substr(coalesce(text, ''), 1, 1000), '^\\s+|\\s+$', '', 'g')) >= 10""")
def sane_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a scan would read: not over a size, and with something in them."""
    files = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.octet_length("text").cast("long").alias("length"), "text")
    return quality_gate.sane_files(files, max_mb=0.002).select("path", "length")


@query("""WITH s AS (SELECT s_suppkey AS k FROM supplier)
        SELECT concat('p', k) AS pattern, concat('**/*.x', k % 5) AS high, concat('f', k % 4, '/*') AS low, concat('a', k, ' b', k % 3) AS keywords, concat('c', k % 2) AS anti_keywords, CAST(NULL AS VARCHAR) AS problem FROM s WHERE k % 6 <> 0 AND k % 7 <> 0
        UNION ALL SELECT concat('p', k), NULL, NULL, NULL, NULL, 'rule 1: search_method is none of keyword, embedding, hybrid' FROM s WHERE k % 6 = 0 AND k % 7 <> 0
        UNION ALL SELECT concat('file', k), NULL, NULL, NULL, NULL, 'not YAML: ParserError' FROM s WHERE k % 7 = 0""")
def declared_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A YAML file for each supplier, some of them wrong: what the patterns ask for, and what is wrong with the others."""
    k = F.col("s_suppkey")
    body = F.format_string(
        "pattern_name: p%s\ndescription: d\nrepository_fingerprint:\n  glob_patterns:\n  - {glob: '**/*.x%s', search_method: keyword, analysis_priority: high, keywords: [a%s, b%s], anti_keywords: [c%s]}\n  - {glob: 'f%s/*', search_method: %s}\npositive_examples: ['twenty characters and more']\n",
        *(c.cast("string") for c in (k, k % 5, k, k % 3, k % 2, k % 4)), F.when(k % 6 == 0, "guess").otherwise("embedding"),
    )
    files = read_table(spark, sf_dir, "supplier").select(F.concat(F.lit("file"), k.cast("string")).alias("path"), F.when(k % 7 == 0, "a: [1").otherwise(body).alias("text"))
    t = readers.patterns_of(files)
    found = relevance.hints(t["rule"], t["keyword"]).select("pattern", *(F.array_join(c, " ").alias(c) for c in ("high", "low", "keywords", "anti_keywords")))
    wrong = t["problem"].where(~F.startswith("problem", F.lit("WARNING")))
    return found.withColumn("problem", F.lit(None).cast("string")).unionByName(wrong, allowMissingColumns=True)
