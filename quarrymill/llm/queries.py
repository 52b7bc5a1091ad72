"""The catalogue's queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarrymill.llm import alignment, fingerprints, packing, pii, prefix_trie, quality, secrets, simhash, subwords, token_counts, topk, toxicity, url_filter
from quarrymill.sources import read_table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return quality.score_documents(docs, quality.fit(docs, labels), threshold=0.3)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(read_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return toxicity.score_documents(docs, toxicity.fit(docs, labels), threshold=0.5)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return secrets.find(docs, secrets.fit(docs))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subwords.round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), drop=0.1, seed=42)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read_table(spark, sf_dir, "conversations"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"), url_filter.RULES)


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_quality, op3_fingerprints, op4_toxicity, op5_simhash, op6_topk_search, op7_pii, op8_secrets, op9_token_counts, op10_subwords, op11_prefix_trie, op12_token_alignment, op13_url_filter)}
ORACLE_SQL: dict[str, str] = {
    "op6_topk_search": """
        WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
                   FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
             s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
                   FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.n <> q.n AND len(c.e) = len(q.e))
        SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 20
    """,
    "op11_prefix_trie": r"""
        WITH t AS (SELECT conv_id, text, sha256(length(role) || ':' || role || text) AS digest, turn
                   FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
             turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS place FROM t),
             crc AS (SELECT conv_id, xor(4294967295, list_reduce([4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
                         lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) AS crc
                     FROM (SELECT DISTINCT conv_id FROM turns)),
             convs AS (SELECT conv_id, conv_id - conv_id % 20 AS base, crc % 4 AS h FROM crc),
             moved AS (SELECT c.conv_id, place, digest, text FROM turns t JOIN convs c ON t.conv_id = c.base AND place < h
                       UNION ALL SELECT c.conv_id, place, digest, text FROM turns t JOIN convs c ON t.conv_id = c.conv_id AND place >= h),
             paths AS (SELECT *, row_number() OVER p AS depth, count(*) OVER (PARTITION BY conv_id) AS len, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS tokens, string_agg(digest, '') OVER (p ROWS UNBOUNDED PRECEDING) AS prefix FROM moved WINDOW p AS (PARTITION BY conv_id ORDER BY place)),
             occ AS (SELECT conv_id, depth, len, tokens, sha256(prefix) AS node FROM paths
                     UNION ALL SELECT conv_id, 0, (SELECT count(*) FROM moved m WHERE m.conv_id = c.conv_id), 0, '' FROM convs c),
             nodes AS (SELECT node, any_value(depth) AS depth, min(conv_id) AS owner, count(*) AS n_convs, max(len) AS deepest, (count(*) - 1) * any_value(tokens) AS saved,
                              sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = len), '')) AS ends_sha256 FROM occ GROUP BY node),
             below AS (SELECT DISTINCT p.node AS top, q.node FROM occ p JOIN occ q ON p.conv_id = q.conv_id AND q.depth >= p.depth),
             sums AS (SELECT top, sum(n.saved) AS saved_tokens, count(*) FILTER (WHERE n.depth = n.deepest) AS n_leaves, count(*) FILTER (WHERE n.depth = t.depth + 1) AS n_children
                      FROM below b JOIN nodes n ON b.node = n.node JOIN nodes t ON b.top = t.node GROUP BY top),
             above AS (SELECT DISTINCT q.node, p.node AS parent FROM occ p JOIN occ q ON p.conv_id = q.conv_id AND q.depth = p.depth + 1)
        SELECT n.owner AS conv_id, CAST(n.depth AS BIGINT) AS depth, p.owner AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
        FROM nodes n JOIN sums s ON n.node = s.top LEFT JOIN above a ON n.node = a.node LEFT JOIN nodes p ON a.parent = p.node
    """,
    "op13_url_filter": r"""
        WITH u AS (SELECT row_number() OVER () AS n, page_id, coalesce(url, '') AS url, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
             h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
             s AS (SELECT n, page_id, url, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substring(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
             rules(label, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
             fits AS (SELECT n, rhost || rpath AS rule, label FROM s JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
                      QUALIFY row_number() OVER (PARTITION BY n ORDER BY length(rhost || rpath) DESC, rhost || rpath DESC) = 1),
             base AS (SELECT s.*, rule, label, left(md5(url), 1) < '3' AS aside FROM s LEFT JOIN fits ON s.n = fits.n),
             met AS (SELECT n, label, aside, unnest(list_transform(generate_series(1, length(url) + 1), lambda i: substring(repeat(chr(2), 4) || url || chr(3), i, 5))) AS gram FROM base),
             g5 AS (SELECT gram, count(*) FILTER (WHERE label = 'allow' AND NOT aside) AS a, count(*) FILTER (WHERE label = 'block' AND NOT aside) AS b, FROM met GROUP BY gram),
             g4 AS (SELECT substring(gram, 2) AS gram, sum(a) AS a, sum(b) AS b FROM g5 GROUP BY ALL),
             g3 AS (SELECT substring(gram, 2) AS gram, sum(a) AS a, sum(b) AS b FROM g4 GROUP BY ALL),
             g2 AS (SELECT substring(gram, 2) AS gram, sum(a) AS a, sum(b) AS b FROM g3 GROUP BY ALL),
             g1 AS (SELECT substring(gram, 2) AS gram, sum(a) AS a, sum(b) AS b FROM g2 GROUP BY ALL),
             t1 AS (SELECT left(gram, 0) AS context, sum(a) AS n_a, sum(b) AS n_b, count(*) FILTER (WHERE a > 0) AS kinds_a, count(*) FILTER (WHERE b > 0) AS kinds_b FROM g1 GROUP BY ALL),
             p1 AS (SELECT gram, CASE WHEN n_a = 0 THEN q ELSE (a + kinds_a * q) / (n_a + kinds_a) END AS q_a, CASE WHEN n_b = 0 THEN q ELSE (b + kinds_b * q) / (n_b + kinds_b) END AS q_b
                    FROM g1 JOIN t1 ON left(g1.gram, 0) = context CROSS JOIN (SELECT 1.0::DOUBLE / (count(*) + 1) AS q FROM g1)),
             t2 AS (SELECT left(gram, 1) AS context, sum(a) AS n_a, sum(b) AS n_b, count(*) FILTER (WHERE a > 0) AS kinds_a, count(*) FILTER (WHERE b > 0) AS kinds_b FROM g2 GROUP BY ALL),
             p2 AS (SELECT gram, CASE WHEN n_a = 0 THEN q_a ELSE (a + kinds_a * q_a) / (n_a + kinds_a) END AS q_a, CASE WHEN n_b = 0 THEN q_b ELSE (b + kinds_b * q_b) / (n_b + kinds_b) END AS q_b
                    FROM g2 JOIN t2 ON left(g2.gram, 1) = context JOIN (SELECT gram AS suffix, q_a, q_b FROM p1) ON substring(g2.gram, 2) = suffix),
             t3 AS (SELECT left(gram, 2) AS context, sum(a) AS n_a, sum(b) AS n_b, count(*) FILTER (WHERE a > 0) AS kinds_a, count(*) FILTER (WHERE b > 0) AS kinds_b FROM g3 GROUP BY ALL),
             p3 AS (SELECT gram, CASE WHEN n_a = 0 THEN q_a ELSE (a + kinds_a * q_a) / (n_a + kinds_a) END AS q_a, CASE WHEN n_b = 0 THEN q_b ELSE (b + kinds_b * q_b) / (n_b + kinds_b) END AS q_b
                    FROM g3 JOIN t3 ON left(g3.gram, 2) = context JOIN (SELECT gram AS suffix, q_a, q_b FROM p2) ON substring(g3.gram, 2) = suffix),
             t4 AS (SELECT left(gram, 3) AS context, sum(a) AS n_a, sum(b) AS n_b, count(*) FILTER (WHERE a > 0) AS kinds_a, count(*) FILTER (WHERE b > 0) AS kinds_b FROM g4 GROUP BY ALL),
             p4 AS (SELECT gram, CASE WHEN n_a = 0 THEN q_a ELSE (a + kinds_a * q_a) / (n_a + kinds_a) END AS q_a, CASE WHEN n_b = 0 THEN q_b ELSE (b + kinds_b * q_b) / (n_b + kinds_b) END AS q_b
                    FROM g4 JOIN t4 ON left(g4.gram, 3) = context JOIN (SELECT gram AS suffix, q_a, q_b FROM p3) ON substring(g4.gram, 2) = suffix),
             t5 AS (SELECT left(gram, 4) AS context, sum(a) AS n_a, sum(b) AS n_b, count(*) FILTER (WHERE a > 0) AS kinds_a, count(*) FILTER (WHERE b > 0) AS kinds_b FROM g5 GROUP BY ALL),
             p5 AS (SELECT gram, CASE WHEN n_a = 0 THEN q_a ELSE (a + kinds_a * q_a) / (n_a + kinds_a) END AS q_a, CASE WHEN n_b = 0 THEN q_b ELSE (b + kinds_b * q_b) / (n_b + kinds_b) END AS q_b
                    FROM g5 JOIN t5 ON left(g5.gram, 4) = context JOIN (SELECT gram AS suffix, q_a, q_b FROM p4) ON substring(g5.gram, 2) = suffix),
             totals AS (SELECT n, CAST(sum(CAST(round(ln(q_a / q_b) * 1000000) AS BIGINT)) AS BIGINT) AS total FROM met JOIN p5 ON met.gram = p5.gram WHERE label IS NULL OR aside GROUP BY n),
             scored AS (SELECT b.n, label, CAST(floor(total / (2000 * (length(url) + 1))) AS BIGINT) AS step FROM base b JOIN totals t ON b.n = t.n),
             held AS (SELECT greatest(least(step, 5000), -5000) AS step, count(*) FILTER (WHERE label = 'allow') AS good, count(*) FILTER (WHERE label = 'block') AS bad FROM scored WHERE label IS NOT NULL GROUP BY 1),
             edges AS (SELECT step AS upto, least(greatest(0, coalesce(lag(step) OVER (ORDER BY step) + 1, -5000)), step) AS step FROM (SELECT step FROM held UNION ALL SELECT 5001)),
             rated AS (SELECT e.step, coalesce(sum(good) FILTER (WHERE h.step >= e.upto), 0) * sum(bad) + coalesce(sum(bad) FILTER (WHERE h.step < e.upto), 0) * sum(good) AS right_, sum(good) * sum(bad) AS both_ FROM edges e CROSS JOIN held h GROUP BY ALL),
             chosen AS (SELECT coalesce((SELECT step FROM rated WHERE both_ > 0 ORDER BY right_ DESC, abs(step), step LIMIT 1), 0) AS edge, (SELECT coalesce(sum(a), 0) > 0 AND coalesce(sum(b), 0) > 0 FROM g5) AS learned)
        SELECT page_id, host, path, rule, coalesce(b.label, CASE WHEN NOT learned OR s.step >= edge THEN 'allow' ELSE 'block' END) AS verdict
        FROM base b LEFT JOIN scored s ON b.n = s.n CROSS JOIN chosen
    """,
}
