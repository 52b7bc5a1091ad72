"""Vectors and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.operators import graph, vectors
from quarrymill.plans.evaluation import rounded
from quarrymill.plans.registry import query
from quarrymill.sources import read_table

_NEAR = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), d AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, i.label, round(1 - list_cosine_similarity(q.e, i.e), 6) AS distance
        FROM v q JOIN v i ON q.vec_id % 10 = 0 AND i.vec_id % 10 <> 0)"""


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every tenth vector as a query, the others as items."""
    rows = read_table(spark, sf_dir, "embeddings")
    return rows.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"), "label"), rows.where("vec_id % 10 <> 0").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("ivec"), "label")


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), d AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, round(1 - list_cosine_similarity(q.e, i.e), 6) AS distance
        FROM v q JOIN v i ON q.label = i.label AND q.vec_id % 10 = 0 AND i.vec_id % 10 <> 0)
        SELECT query_id, item_id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS INTEGER) AS rank FROM d QUALIFY rank <= 5""")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, i = sides(spark, sf_dir)
    return vectors.nearest(q, i, 5, by="label")


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), d AS (SELECT q.vec_id AS query_id, min(round(1 - list_cosine_similarity(q.e, i.e), 6)) AS distance
        FROM v q JOIN v i ON q.label = i.label AND q.vec_id % 10 = 0 AND i.vec_id % 10 <> 0 GROUP BY 1) SELECT query_id, round(1 / (1 + distance), 6) AS score FROM d""")
def embedding_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, i = sides(spark, sf_dir)
    return rounded(vectors.similarity_score(vectors.nearest(q, i, 5, by="label")), "score")


@query(f"""WITH {_NEAR}, b AS (SELECT query_id, 1 - min(distance) FILTER (label % 2 = 0) AS p, 1 - min(distance) FILTER (label % 2 = 1) AS n FROM d GROUP BY 1) SELECT query_id, round(greatest(p - 0.7::DOUBLE * n, 0), 6) AS score FROM b""")
def contrast_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, i = sides(spark, sf_dir)
    q = q.drop("label")
    return rounded(vectors.contrast_score(vectors.nearest(q, i.where("label % 2 = 0"), 3), vectors.nearest(q, i.where("label % 2 = 1"), 3)), "score")


def supply_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers, and an edge from each to the ten that follow its multiple; some have no way out."""
    s = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey")
    n = F.lit(read_table(spark, sf_dir, "supplier").count())
    out = s.where("id % 7 <> 0").select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k")).select("src", (F.pmod(F.col("src") * F.col("k") + F.col("k") * 11, n) + 1).alias("dst"))
    ids = s.select(F.col("id").alias("dst"))
    return s, out.join(ids, "dst", "left_semi").select("src", "dst")


_GRAPH = """n AS (SELECT s_suppkey AS id, s_nationkey FROM supplier), c AS (SELECT count(*) AS n FROM n),
        e AS (SELECT DISTINCT id AS src, (id * k + k * 11) % c.n + 1 AS dst FROM n, c, range(1, 4) r(k) WHERE id % 7 <> 0 AND (id * k + k * 11) % c.n + 1 IN (SELECT id FROM n)),
        g AS (SELECT src, count(*) AS d FROM e GROUP BY 1), r0 AS (SELECT id, 1::DOUBLE / c.n AS rank FROM n, c)"""
_STEP = """, r{b} AS (SELECT n.id, 0.15::DOUBLE / c.n + 0.85::DOUBLE * (coalesce(s.got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{a} WHERE id NOT IN (SELECT src FROM g)) / c.n) AS rank
        FROM n CROSS JOIN c LEFT JOIN (SELECT dst, sum(r{a}.rank / g.d) AS got FROM e JOIN r{a} ON r{a}.id = e.src JOIN g ON g.src = e.src GROUP BY dst) s ON s.dst = n.id)"""
_RANKS = _GRAPH + "".join(_STEP.format(a=i, b=i + 1) for i in range(5))


@query(f"WITH {_RANKS} SELECT id, round(rank, 8) AS rank, round(rank / (SELECT max(rank) FROM r5), 6) AS centrality FROM r5")
def pagerank_fixed_iter(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = supply_graph(spark, sf_dir)
    return rounded(rounded(graph.page_rank(nodes, edges, iterations=5, tolerance=None), "rank", places=8), "centrality")


@query(f"""WITH {_RANKS}, b AS (SELECT id, rank / (SELECT max(rank) FROM r5) AS ce FROM r5), m AS (SELECT src, count(*) AS n, count(*) FILTER (dst IN (SELECT id FROM n WHERE s_nationkey < 8)) AS r FROM e GROUP BY 1)
        SELECT id, round(CASE WHEN m.n IS NULL THEN ce ELSE least(greatest(ce + 0.5::DOUBLE * m.r / m.n - CASE WHEN m.n > 20 AND m.r < 3 THEN 0.25::DOUBLE ELSE 0 END, 0), 1) END, 6) AS centrality FROM b LEFT JOIN m ON m.src = b.id""")
def contextual_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = supply_graph(spark, sf_dir)
    base = graph.page_rank(nodes, edges, iterations=5, tolerance=None).select("id", "centrality")
    return rounded(graph.contextual_centrality(base, edges, nodes.where("s_nationkey < 8").select("id")), "centrality")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.type_histogram(read_table(spark, sf_dir, "events"), "event_type")


@query("""SELECT user_id AS src, event_id % 20 AS dst, arg_max(event_type, event_id) AS type FROM events GROUP BY ALL""")
def one_edge_per_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("src"), (F.col("event_id") % 20).alias("dst"), F.col("event_type").alias("type"), "event_id")
    return graph.one_edge_per_pair(edges, "event_id")


@query("""WITH e AS (SELECT DISTINCT user_id AS a, event_id % 20 AS k, event_type FROM events) SELECT a AS src, k AS dst FROM e WHERE event_type = 'signup' AND a % 3 = 0""")
def successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("src"), (F.col("event_id") % 20).alias("dst"), F.col("event_type").alias("type")).distinct()
    return graph.successors(edges, edges.where("src % 3 = 0").select(F.col("src").alias("id")).distinct(), "signup")


@query(f"""WITH {_GRAPH.replace(", r0 AS (SELECT id, 1::DOUBLE / c.n AS rank FROM n, c)", "")},
        p AS (SELECT least(src, dst) AS first, greatest(src, dst) AS second, src, dst FROM e WHERE src <> dst)
        SELECT first, second, arg_min(src, CASE WHEN src > dst THEN 1 ELSE 0 END) AS src, arg_min(dst, CASE WHEN src > dst THEN 1 ELSE 0 END) AS dst FROM p GROUP BY ALL ORDER BY first, second LIMIT 10""")
def evidence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten pairs of suppliers with an edge: the report's own limit."""
    nodes, edges = supply_graph(spark, sf_dir)
    return graph.evidence_pairs(nodes.select("id", F.col("id").alias("pos")), edges)


@query("""WITH c AS (SELECT event_id AS call_id, CAST(user_id % 10 AS VARCHAR) AS file, concat('m.f', event_id % 30) AS name FROM events),
        d AS (SELECT CAST(p_partkey % 10 AS VARCHAR) AS f, concat(CASE WHEN p_partkey % 4 = 0 THEN 'm.f' ELSE 'f' END, p_partkey % 25) AS n, min(p_partkey) AS seq FROM part GROUP BY ALL),
        k AS (SELECT DISTINCT file, name FROM c),
        j AS (SELECT k.file, k.name, d.f, d.n, CASE WHEN k.file = d.f AND k.name = d.n THEN 1 WHEN k.file = d.f THEN 2 ELSE 3 END AS stage, seq FROM k JOIN d
          ON (k.file = d.f AND d.n IN (k.name, substr(k.name, 3))) OR (k.file <> d.f AND d.n = substr(k.name, 3))),
        b AS (SELECT file, name, concat(f, ':', n) AS target, stage FROM j QUALIFY row_number() OVER (PARTITION BY file, name ORDER BY stage, seq) = 1)
        SELECT c.call_id, CAST(coalesce(b.target, '') AS VARCHAR) AS target, CAST(b.stage AS INTEGER) AS stage FROM c LEFT JOIN b USING (file, name)""")
def call_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: c.cast("string")
    calls = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), text(F.col("user_id") % 10).alias("file"), F.concat(F.lit("m.f"), text(F.col("event_id") % 30)).alias("name"))
    k = F.col("p_partkey")
    defined = read_table(spark, sf_dir, "part").select(text(k % 10).alias("file"), F.concat(F.when(k % 4 == 0, "m.f").otherwise("f"), text(k % 25)).alias("name"), k.alias("seq"))
    return graph.first_dotted(calls, defined)
