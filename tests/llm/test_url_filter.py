import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quarrymill.llm import queries, url_filter
from quarrymill.llm.url_filter import Rule, grams, host_and_path, judge, rule_of, smoothed, threshold

ODD = [None, "", "no scheme", "https://Sub.WWW.Example.COM/en/x?y#z", "http://com/", "http://com", "http://a.com#/x", "ftp://x?://b.net/es/", "://net/es/1", "http://é.net/fr/😀\x02\x03", "http://notcom/", "http://x.com:80/", "http://a.com/" + "b/" * 2_000, "http://a.com/q", "http://a.com/q"]


def pages(spark, urls, ids=None):
    ids = ids or [None if i % 7 == 3 else i // 2 for i in range(len(urls))]
    return spark.createDataFrame([(i, u, "h", 1, "g", 2) for i, u in zip(ids, urls, strict=True)], "page_id long, url string, html string, row long, gram string, total long")


def sites(n=200):
    """URLs that a rule allows or blocks by their folder, and some without a rule that look like either."""
    return [f"http://s{i % 23}.com/en/good-{i * 7919 % 1000}" for i in range(n)] + [f"http://s{i % 23}.net/es/casino{i * 104729 % 1000}" for i in range(n)] + ["http://s1.org/en/good-17", "http://s2.org/es/casino42"]


def by_sql(spark, df):
    con = duckdb.connect()
    con.register("pages", df.select("page_id", "url").toPandas().convert_dtypes())
    return sorted(con.execute(queries.ORACLE_SQL["op13_url_filter"]).fetchall(), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_parts_and_rules(spark):
    host, path = host_and_path(F.col("url"))
    rule, verdict = rule_of(host, path, url_filter.RULES)
    found = [tuple(r) for r in pages(spark, ODD[:12], list(range(12))).orderBy("page_id").select(host, path, rule, verdict).collect()]
    none = (None, None)
    assert found == [("", "", *none), ("", "", *none), ("", "", *none), ("sub.www.example.com", "/en/x", "www.example.com/en/", "allow"), ("com", "/", "com/", "allow"), ("com", "", *none), ("a.com", "", *none), ("x", "", *none), ("net", "/es/1", "net/es/", "block"), ("é.net", "/fr/😀\x02\x03", "net/fr/", "block"), ("notcom", "/", *none), ("x.com:80", "/", *none)]


def test_grams_are_of_code_points(spark):
    assert spark.range(1).select(grams(F.lit("é😀"))).first()[0] == ["\x02\x02\x02\x02é", "\x02\x02\x02é😀", "\x02\x02é😀\x03"]


def test_smoothing_by_hand(spark):
    """Against the recursion, one gram at a time; probabilities after each context seen add up to less than 1 by the share of the unseen."""
    texts = {"a": ["abab", "abc"], "b": ["bb"]}
    of = lambda t: [("\x02" * 4 + t + "\x03")[i : i + 5] for i in range(len(t) + 1)]
    counts = {x: Counter(g for t in texts[x] for g in of(t)) for x in "ab"}
    asked = set(of("abz")) | set(counts["a"]) | set(counts["b"])
    size = len({g[-1] for g in asked})

    def p(x, gram):
        q = p(x, gram[1:]) if gram else 1 / (size + 1)
        if not gram:
            return q
        k = len(gram)
        after = Counter()
        for g, n in counts[x].items():
            if g[5 - k : 4] == gram[:-1]:
                after[g[-1]] += n
        n, kinds = sum(after.values()), len(after)
        return (after[gram[-1]] + kinds * q) / (n + kinds) if n else q

    df = spark.createDataFrame([(g, counts["a"][g], counts["b"][g]) for g in asked], "gram string, a long, b long")
    for row in smoothed(df).collect():
        assert math.isclose(row["p_a"], p("a", row["gram"])) and math.isclose(row["p_b"], p("b", row["gram"]))


@pytest.mark.parametrize("rows, want", [([("allow", 5), ("allow", 9), ("block", -3)], 0), ([("allow", -7), ("block", -9)], -7), ([("allow", 1)], 0), ([], 0), ([("allow", 9000), ("block", 8000)], 0)])
def test_threshold(spark, rows, want):
    assert threshold(spark.createDataFrame(rows, "label string, step long")) == want


def test_what_no_rule_decides_is_judged_by_likeness(spark):
    out = {r["host"]: r["verdict"] for r in judge(pages(spark, sites(), list(range(402)))).where("rule is null").collect()}
    assert out == {"s1.org": "allow", "s2.org": "block"}


def test_equals_sql_with_odd_rows(spark, monkeypatch):
    df = pages(spark, ODD + sites(60))
    want = by_sql(spark, df)
    assert got(judge(df)) == want
    monkeypatch.setattr(url_filter, "CROWD", 5)
    assert got(judge(df)) == want
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", 0)
    assert got(judge(df)) == want


def test_without_labels_of_both_kinds_nothing_is_refused(spark):
    df = pages(spark, ["http://a.com/x", "http://b.org/", None])
    assert got(judge(df)) == by_sql(spark, df)
    assert {r["verdict"] for r in judge(df, (Rule("block", "com", "/"),)).where("rule is null").collect()} == {"allow"}


def test_no_rows(spark):
    assert judge(pages(spark, ODD).where("false")).collect() == []


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    out = queries.op13_url_filter(spark, sf_dir)
    want = con.execute(queries.ORACLE_SQL["op13_url_filter"])
    assert out.columns == [d[0] for d in want.description]
    assert got(out) == sorted(want.fetchall(), key=str)
