"""Rule matching, relevance scores, queues and text pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import rates
from quarrymill.functions import text as T
from quarrymill.operators import keywords, relevance, shares
from quarrymill.plans.evaluation import rounded
from quarrymill.plans.registry import query
from quarrymill.sources import read_table

RULES = [("fr", 0, "fr/*", "high"), ("fr", 1, "**/fr/[0-9]*", "low"), ("deep", 0, "http:/*/*/*", "low"), ("top", 0, "*/*#top", "high"), ("net", 0, "*.net/*/*", "low")]
_RULE_SQL = "(VALUES ('fr', 0, '(^|/)fr/[^/]*$', 'high'), ('fr', 1, '(^|/)[^/]+/fr/[0-9][^/]*$', 'low'), ('deep', 0, '(^|/)http:/[^/]*/[^/]*/[^/]*$', 'low'), ('top', 0, '(^|/)[^/]*/[^/]*#top$', 'high'), ('net', 0, '(^|/)[^/]*\\.net/[^/]*/[^/]*$', 'low')) r(pattern, rule_no, rx, priority)"


def url_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read_table(spark, sf_dir, "pages").select(F.regexp_replace("url", "//", "/").alias("path"))
    return relevance.match_rules(files, spark.createDataFrame(RULES, "pattern string, rule_no int, glob string, priority string"))


_MATCH = f"m AS (SELECT DISTINCT replace(url, '//', '/') AS path, pattern, rule_no, priority FROM pages, {_RULE_SQL} WHERE regexp_matches(replace(url, '//', '/'), rx))"


@query(f"WITH {_MATCH} SELECT path, pattern, CAST(rule_no AS INTEGER) AS rule_no, priority FROM m")
def glob_rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_matches(spark, sf_dir)


@query(f"WITH {_MATCH} SELECT DISTINCT pattern, path, CAST(CASE WHEN priority = 'high' THEN 1 ELSE 2 END AS INTEGER) AS tier FROM m")
def tier_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relevance.tiers(url_matches(spark, sf_dir))


KEYWORDS = [("law", 0, "rights", "pos"), ("law", 0, "License", "pos"), ("law", 0, "warranty", "anti"), ("talk", 0, "idiot", "pos"), ("talk", 0, "the", "pos"), ("talk", 0, "erth", "anti")]


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pattern, path, keywords, anti_keywords, keyword_score of documents that have any keyword of a pattern; each matches all documents."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    return relevance.keyword_scan(docs, relevance.declared(KEYWORDS))


_HITS = """k(pattern, keyword, kind) AS (VALUES ('law', 'rights', 'pos'), ('law', 'License', 'pos'), ('law', 'warranty', 'anti'), ('talk', 'idiot', 'pos'), ('talk', 'the', 'pos'), ('talk', 'erth', 'anti')),
        h AS (SELECT pattern, doc_id, keyword, kind, lower(text) AS t FROM documents, k WHERE contains(lower(text), lower(keyword)))"""


@query(f"""WITH {_HITS} SELECT pattern, doc_id AS path, coalesce(string_agg(keyword, ',' ORDER BY keyword) FILTER (kind = 'pos'), '') AS keywords, coalesce(string_agg(keyword, ',' ORDER BY keyword) FILTER (kind = 'anti'), '') AS anti_keywords FROM h GROUP BY ALL""")
def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark, sf_dir).select("pattern", "path", F.array_join("keywords", ",").alias("keywords"), F.array_join("anti_keywords", ",").alias("anti_keywords"))


def _score_sql(hits: str) -> str:
    return f"""{hits},
        l AS (SELECT doc_id, unnest(string_split_regex(lower(text), '\\r?\\n')[1:200]) AS line FROM documents),
        w AS (SELECT doc_id, line, CASE WHEN contains(line, 'class ') OR contains(line, 'interface ') OR contains(line, 'struct ') THEN 0.30::DOUBLE
              WHEN contains(line, 'def ') OR contains(line, 'function ') OR contains(line, 'func ') OR contains(line, 'public ') OR contains(line, 'private ') THEN 0.25::DOUBLE
              WHEN contains(line, 'import ') OR contains(line, 'from ') OR contains(line, 'require(') OR contains(line, 'use ') THEN 0.15::DOUBLE
              WHEN regexp_matches(ltrim(line, ' '), '^(#|//|/\\*|\\*|<!--)') THEN 0.05::DOUBLE ELSE 0.10::DOUBLE END AS w FROM l),
        n AS (SELECT h.*, (length(t) - length(replace(t, lower(keyword), ''))) / length(keyword) AS occ,
              (SELECT max(w.w) FROM w WHERE w.doc_id = h.doc_id AND contains(w.line, lower(h.keyword))) AS best FROM h),
        s AS (SELECT pattern, doc_id AS path, coalesce(sum(0.15::DOUBLE + coalesce(best, 0) + least(occ * 0.03::DOUBLE, 0.20::DOUBLE)) FILTER (kind = 'pos'), 0) AS p,
              coalesce(sum(least(occ * 0.08::DOUBLE, 0.30::DOUBLE)) FILTER (kind = 'anti'), 0) AS a, count(*) FILTER (kind = 'pos') AS c FROM n GROUP BY ALL),
        f AS (SELECT pattern, path, CASE WHEN c > 0 THEN least(greatest(p - a, 0) / (c * 0.8::DOUBLE), 1::DOUBLE) ELSE 0::DOUBLE END AS keyword_score FROM s)"""


_SCORE = _score_sql(_HITS)


@query(f"WITH {_SCORE} SELECT pattern, path, round(keyword_score, 6) AS keyword_score FROM f")
def keyword_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scanned(spark, sf_dir).select("pattern", "path", "keyword_score"), "keyword_score")


_WORDS = """b AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{5,}')) AS keyword FROM benchmark),
        k AS (SELECT DISTINCT concat('p', length(keyword) % 3) AS pattern, keyword, CASE WHEN length(keyword) % 5 = 0 THEN 'anti' ELSE 'pos' END AS kind FROM b),
        h AS (SELECT pattern, doc_id, keyword, kind, lower(text) AS t FROM documents, k WHERE contains(lower(text), lower(keyword)))"""


@query(f"""WITH {_score_sql(_WORDS)}, c AS (SELECT pattern, doc_id AS path, CAST(count(*) FILTER (kind = 'pos') AS INTEGER) AS n_keywords, CAST(count(*) FILTER (kind = 'anti') AS INTEGER) AS n_anti FROM h GROUP BY ALL)
        SELECT pattern, path, n_keywords, n_anti, round(keyword_score, 6) AS keyword_score FROM f JOIN c USING (pattern, path)""")
def many_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the benchmark as keywords, by one automaton."""
    length = F.length("keyword")
    words = read_table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), F.lit(0))).alias("keyword")).distinct()
    declared = words.select(F.concat(F.lit("p"), (length % 3).cast("string")).alias("pattern"), "keyword", F.when(length % 5 == 0, "anti").otherwise("pos").alias("kind"))
    found = keywords.scan(read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text"), declared)
    return rounded(found.select("pattern", "path", F.size("keywords").alias("n_keywords"), F.size("anti_keywords").alias("n_anti"), "keyword_score"), "keyword_score")


_QUEUE = f"""{_SCORE}, v AS (SELECT pattern, path, round(0.2::DOUBLE * keyword_score + 0.1::DOUBLE * ((path % 10) / 10::DOUBLE) + 0.7::DOUBLE * CASE path % 3 WHEN 0 THEN 1 WHEN 1 THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END, 9) AS score FROM f),
        q AS (SELECT *, CAST(row_number() OVER (PARTITION BY pattern ORDER BY score DESC, path) AS INTEGER) AS rank, CASE WHEN score >= 0.5::DOUBLE THEN 'high' WHEN score >= 0.3::DOUBLE THEN 'medium' ELSE 'low' END AS tier FROM v WHERE score >= 0.1::DOUBLE QUALIFY rank <= 20)"""


def queued(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.col("path") % 3
    verdict = rates.confidence_value(F.when(third == 0, "high").when(third == 1, "medium").otherwise("low"))
    score = relevance.priority_score(F.col("keyword_score"), (F.col("path") % 10) / 10, F.lit(0.0), verdict)
    return relevance.queue(scanned(spark, sf_dir).select("pattern", "path", "keyword_score").withColumn("score", F.round(score, 9)), ["pattern"])


@query(f"WITH {_QUEUE} SELECT pattern, path, score, rank, tier FROM q")
def priority_ranking_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queued(spark, sf_dir).select("pattern", "path", "score", "rank", "tier")


@query(f"WITH {_QUEUE} SELECT pattern, CAST(count(*) FILTER (tier = 'high') AS BIGINT) AS high, CAST(count(*) FILTER (tier = 'medium') AS BIGINT) AS medium, CAST(count(*) FILTER (tier = 'low') AS BIGINT) AS low FROM q GROUP BY 1")
def queue_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relevance.queue_composition(queued(spark, sf_dir), ["pattern"])


@query(f"""WITH {_QUEUE}, e AS (SELECT q.*, coalesce(l.quality = 1, false) AS ev FROM q LEFT JOIN labels l ON l.doc_id = path)
        SELECT pattern, round(avg(score) FILTER (ev), 6) AS mean_confidence, min(rank) FILTER (ev) AS first_at, max(rank) FILTER (ev) AS last_at, CAST(count(*) FILTER (ev) AS BIGINT) AS n_evidence FROM e GROUP BY 1""")
def evidence_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"), "quality")
    rows = queued(spark, sf_dir).join(labels, "path", "left")
    return rounded(shares.evidence_position(rows, "pattern", "rank", F.coalesce(F.col("quality") == 1, F.lit(False)), F.col("score")), "mean_confidence")


@query("""SELECT source, round(avg(CASE WHEN doc_id % 4 = 0 THEN 0 ELSE n_chars % 7 END), 6) AS mean_hint, CAST(count(*) FILTER (doc_id % 4 <> 0 AND n_chars % 7 <> 0) AS BIGINT) AS non_zero, CAST(count(*) FILTER (n_chars < 1000) AS BIGINT) AS rejected FROM documents GROUP BY 1""")
def hint_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    hint = F.when(F.col("doc_id") % 4 == 0, 0).otherwise(F.col("n_chars") % 7)
    return rounded(shares.hint_usage(read_table(spark, sf_dir, "documents"), "source", hint, F.col("n_chars"), 1000), "mean_hint")


@query("""SELECT doc_id, source FROM documents WHERE n_chars < 1500 QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 10""")
def negative_sample_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 10 rejected of each group in the order of the queue: a report of the feature's own limit."""
    return shares.top_per_group(read_table(spark, sf_dir, "documents").where("n_chars < 1500"), ["source"], [F.desc("n_chars"), F.asc("doc_id")], 10).select("doc_id", "source")


@query("""WITH v AS (SELECT page_id, url AS value FROM pages UNION ALL SELECT page_id, concat('/', regexp_extract(url, '[^/]+/[0-9]+')) FROM pages UNION ALL SELECT page_id, concat('orders.', CASE WHEN page_id % 2 = 0 THEN 'queue' ELSE 'other' END) FROM pages)
        SELECT page_id, value, CASE WHEN regexp_matches(value, '^(https?://|[A-Za-z][A-Za-z0-9+.\\-]*://)') THEN 'url' WHEN regexp_matches(value, '^/[A-Za-z0-9/_\\-{}.]+$') THEN 'endpoint' WHEN regexp_matches(value, '\\w+\\.(queue|topic|exchange|channel)') THEN 'queue' END AS class FROM v""")
def string_literal_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages")
    values = F.array(F.col("url"), F.concat(F.lit("/"), F.regexp_extract("url", "[^/]+/[0-9]+", 0)), F.concat(F.lit("orders."), F.when(F.col("page_id") % 2 == 0, "queue").otherwise("other")))
    return p.select("page_id", F.explode(values).alias("value")).withColumn("class", T.literal_class(F.col("value")))


def _first(table: tuple[tuple[str, float], ...], otherwise: float) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower(name), '{p}') THEN {w}::DOUBLE" for p, w in table) + f" ELSE {otherwise}::DOUBLE END"


_NAMES = "n AS (SELECT concat(p_brand, '/', p_size) AS file, concat(CASE p_size % 5 WHEN 0 THEN 'Order' WHEN 1 THEN 'RestController' WHEN 2 THEN 'ApiGateway' WHEN 3 THEN 'getAll' ELSE 'Kafkalistener' END, p_type) AS name FROM part)"


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 5
    return read_table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("file"), F.concat(F.when(k == 0, "Order").when(k == 1, "RestController").when(k == 2, "ApiGateway").when(k == 3, "getAll").otherwise("Kafkalistener"), "p_type").alias("name"))


@query(f"WITH {_NAMES} SELECT file, round(least(sum({_first(relevance.DECORATOR_WEIGHTS, 0.1)}) / (count(*) * 0.9::DOUBLE), 1), 6) AS decorator_score FROM n GROUP BY 1")
def decorator_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relevance.decorator_score(names(spark, sf_dir)), "decorator_score")


@query(f"WITH {_NAMES} SELECT file, round(least(sum({_first(relevance.CLASS_WEIGHTS, 0.05)}) / (greatest(count(*), 2) * 0.7::DOUBLE), 1), 6) AS class_score FROM n GROUP BY 1")
def class_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relevance.class_score(names(spark, sf_dir)), "class_score")


@query("""WITH v AS (SELECT page_id // 10 AS file, CASE WHEN page_id % 3 = 0 THEN 0.8::DOUBLE WHEN page_id % 3 = 1 THEN 0.7::DOUBLE END AS w FROM pages)
        SELECT CAST(file AS BIGINT) AS file, round(least(sum(w) / (greatest(count(*), 3) * 0.8::DOUBLE), 1), 6) AS string_score FROM v WHERE w IS NOT NULL GROUP BY 1""")
def string_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.col("page_id") % 3
    rows = read_table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 10).alias("file"), F.when(third == 0, F.col("url")).when(third == 1, "/api/v1").otherwise("plain words").alias("value"))
    return rounded(relevance.string_score(rows), "string_score")


@query("""WITH s AS (SELECT concat('f', page_id, CASE page_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.go' WHEN 2 THEN '.sh' ELSE '.xyz' END) AS path, page_id % 4 AS k, (page_id % 10) / 10::DOUBLE AS c, (page_id % 7) / 7::DOUBLE AS d, (page_id % 5) / 5::DOUBLE AS s, (page_id % 3) / 3::DOUBLE AS l FROM pages)
        SELECT path, round(CASE k WHEN 1 THEN (c + s + l) / 3 WHEN 2 THEN (c + s) / 2 ELSE (c + d + s + l) / 4 END, 6) AS parser_score FROM s""")
def parser_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = F.col("page_id"), F.col("page_id") % 4
    path = F.concat(F.lit("f"), p.cast("string"), F.when(k == 0, ".py").when(k == 1, ".go").when(k == 2, ".sh").otherwise(".xyz"))
    rows = read_table(spark, sf_dir, "pages").select(path.alias("path"), ((p % 10) / 10).alias("centrality"), ((p % 7) / 7).alias("decorator_score"), ((p % 5) / 5).alias("string_score"), ((p % 3) / 3).alias("class_score"))
    return rounded(relevance.parser_score(rows).select("path", "parser_score"), "parser_score")


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), i AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l),
        s AS (SELECT doc_id, min(i) AS i, array_to_string(ls[greatest(i - 2, 1):least(i + 2, len(ls))], chr(10)) AS snippet FROM i WHERE contains(lower(ls[i]), 'rights') OR contains(lower(ls[i]), 'license') GROUP BY doc_id, 3)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS pos, snippet FROM s QUALIFY pos < 5""")
def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents").where(F.lower("text").rlike("rights|license"))
    return rows.select("doc_id", F.posexplode(relevance.context_windows(F.col("text"), F.array(F.lit("rights"), F.lit("license")))).alias("pos", "snippet"))


@query()
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of documents by patterns with look-ahead, which the oracle's regular expressions don't have; tests compare with Python's."""
    return read_table(spark, sf_dir, "documents").select("doc_id", F.posexplode(relevance.chunks(F.col("text"))).alias("pos", "chunk"))


@query("""WITH b AS (SELECT event_id, event_id % 5 AS k, CAST(json_extract(props, '$.k') AS BIGINT) AS v FROM events)
        SELECT event_id, CASE WHEN k = 4 THEN NULL ELSE v END AS k FROM b""")
def json_extract_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties as they are, in a tagged fence, with a comma too many, within prose; and what isn't JSON at all."""
    p, n = F.col("props"), F.col("event_id") % 5
    damaged = F.when(n == 0, p).when(n == 1, F.concat(F.lit("Sure:\n```json\n"), p, F.lit("\n```\nDone."))).when(n == 2, F.regexp_replace(p, r"\}", ", }")).when(n == 3, F.concat(F.lit("Here is it: "), p, F.lit(" - ok?"))).otherwise("nothing here")
    rows = read_table(spark, sf_dir, "events").select("event_id", T.json_block(damaged).alias("block"))
    return rows.select("event_id", T.json_repaired(F.col("block"), "k bigint")["k"].alias("k"))


@query("""SELECT event_id, event_type, CAST(CASE WHEN count(*) OVER (PARTITION BY event_type) <= 800 THEN 0 ELSE (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 600 END AS INTEGER) AS batch FROM events""")
def batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relevance.batches(read_table(spark, sf_dir, "events").select("event_id", "event_type"), ["event_id"], ["event_type"])


@query("""SELECT CAST(doc_id // 25 AS BIGINT) AS repo, string_agg(printf('%s (%.2f): %s', source, (doc_id % 25) / 25, substr(coalesce(text, ''), 1, 220)), chr(10) ORDER BY doc_id DESC) AS digest FROM documents GROUP BY 1""")
def evidence_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a piece of evidence of a repository of 25."""
    n = F.col("doc_id")
    rows = read_table(spark, sf_dir, "documents").select(F.floor(n / 25).alias("repo"), ((n % 25) / 25).alias("confidence"), F.col("source").alias("file"), F.coalesce("text", F.lit("")).alias("text"))
    return relevance.evidence_digest(rows, ["repo"])


@query("""WITH e AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages) SELECT page_id, link, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY ALL""")
def link_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = read_table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link"))
    return links.groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT concat('r', page_id % 4) AS repo, page_id AS seq, concat('d', page_id % 11, '/f', page_id, CASE page_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.go' ELSE '.md' END) AS path, (page_id * 37 % 101) / 101::DOUBLE AS c FROM pages),
        s AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY repo ORDER BY seq) <= 50),
        e AS (SELECT repo, regexp_extract(path, '\\.[a-z]+$') AS ext, count(*) AS n FROM s GROUP BY ALL), d AS (SELECT DISTINCT repo, regexp_extract(path, '^[^/]+') AS dir FROM s),
        h AS (SELECT repo, path, c FROM f QUALIFY row_number() OVER (PARTITION BY repo ORDER BY c DESC, path) <= 5), g AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY repo ORDER BY dir) <= 8)
        SELECT repo, (SELECT string_agg(ext, ',' ORDER BY n DESC, ext) FROM e WHERE e.repo = r.repo) AS extensions, (SELECT string_agg(dir, ',' ORDER BY dir) FROM g WHERE g.repo = r.repo) AS dirs,
          (SELECT string_agg(path, ',' ORDER BY c DESC, path) FROM h WHERE h.repo = r.repo) AS hubs FROM (SELECT DISTINCT repo FROM f) r""")
def repository_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = F.col("page_id"), F.col("page_id") % 3
    text = lambda c: c.cast("string")
    files = read_table(spark, sf_dir, "pages").select(F.concat(F.lit("r"), text(p % 4)).alias("repo"), p.alias("seq"), F.concat(F.lit("d"), text(p % 11), F.lit("/f"), text(p), F.when(k == 0, ".py").when(k == 1, ".go").otherwise(".md")).alias("path"), ((p * 37 % 101) / 101).alias("centrality"))
    return relevance.summary(files.drop("centrality"), files.select("path", "centrality"))


@query("""WITH g AS (SELECT concat('p', s_nationkey) AS pattern, s_suppkey AS k, concat('**/', s_name, '/*') AS rule FROM supplier),
        w AS (SELECT concat('p', c_nationkey) AS pattern, c_mktsegment AS word, c_custkey % 3 > 0 AS pos, min(c_custkey) AS first_key FROM customer GROUP BY ALL),
        v AS (SELECT pattern, string_agg(word, ' ' ORDER BY first_key) FILTER (pos) AS keywords, string_agg(word, ' ' ORDER BY first_key) FILTER (NOT pos) AS anti_keywords FROM w GROUP BY 1)
        SELECT pattern, coalesce(string_agg(rule, ' ' ORDER BY k) FILTER (k % 4 = 1), '') AS high, coalesce(string_agg(rule, ' ' ORDER BY k) FILTER (k % 4 <> 1), '') AS low, coalesce(any_value(keywords), '') AS keywords, coalesce(any_value(anti_keywords), '') AS anti_keywords
        FROM g LEFT JOIN v USING (pattern) GROUP BY 1""")
def pattern_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern for each nation, with a rule for each of its suppliers and a keyword for each of its customers."""
    name = lambda c: F.concat(F.lit("p"), F.col(c).cast("string")).alias("pattern")
    k = F.col("s_suppkey")
    rules = read_table(spark, sf_dir, "supplier").select(name("s_nationkey"), k.alias("rule_no"), F.concat(F.lit("**/"), "s_name", F.lit("/*")).alias("glob"), F.when(k % 4 == 1, "high").when(k % 4 == 2, "low").alias("priority"))
    words = read_table(spark, sf_dir, "customer").select(name("c_nationkey"), F.col("c_custkey").alias("rule_no"), F.col("c_mktsegment").alias("keyword"), F.when(F.col("c_custkey") % 3 > 0, "pos").otherwise("anti").alias("kind"))
    return relevance.hints(rules, words).select("pattern", *(F.array_join(c, " ").alias(c) for c in ("high", "low", "keywords", "anti_keywords")))
