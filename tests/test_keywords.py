"""Very many keywords by one automaton, and globs by an index of rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import globs
from quarrymill.operators import keywords, relevance

WORDS = [("p", "aa", "pos"), ("p", "aba", "anti"), ("q", "A", "pos"), ("q", "", "anti"), ("r", "x\ny", "pos"), ("r", "É", "pos"), ("p", "Class ", "pos"), ("s", "never there", "pos"), ("q", "a", "anti")]
TEXTS = [(1, "aaaa ababa\nclass aaa"), (2, None), (3, ""), (4, "x\ny\r\nimport é"), (5, "def aa\n" * 300 + "ab"), (6, "# aba"), (6, "# aba"), (None, "AA")]


def shown(df):
    return sorted((r["pattern"], str(r["path"]), r["keywords"], r["anti_keywords"], round(r["keyword_score"], 12)) for r in df.collect())


def test_the_automaton_gives_the_rows_of_the_scan(spark):
    files = spark.createDataFrame(TEXTS, "path long, text string")
    declared = spark.createDataFrame(WORDS, "pattern string, keyword string, kind string")
    got = keywords.scan(files, declared)
    assert shown(got) == shown(relevance.keyword_scan(files, relevance.declared([(p, 0, k, kind) for p, k, kind in WORDS])))
    assert keywords.scan(files.where("false"), declared).collect() == [] == keywords.scan(files, declared.where("false")).collect()
    with pytest.raises(ValueError):
        keywords.compiled(declared, limit=3)


@pytest.mark.parametrize("seed", range(3))
def test_occurrences_are_those_of_count(spark, seed):
    draw = random.Random(seed)
    words = {"".join(draw.choice("ab ") for _ in range(draw.randint(1, 5))) for _ in range(40)}
    keys = keywords.compiled(spark.createDataFrame([("p", w, "pos") for w in words], "pattern string, keyword string, kind string"))
    for _ in range(50):
        text = "".join(draw.choice("ab \n") for _ in range(draw.randint(0, 80)))
        assert {keys.spelled[i][0][2]: n for i, n in keywords.occurrences(text, keys).items()} == {w: text.count(w) for w in words if w in text}


def test_ten_thousand_keywords_in_one_pass(spark):
    files = spark.range(200).select(F.col("id").alias("path"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(20_000))))).alias("text"))
    declared = spark.range(10_000).select(F.lit("p").alias("pattern"), F.concat(F.lit(" w"), "id", F.lit(" ")).alias("keyword"), F.lit("pos").alias("kind"))
    got = {r["path"]: r["keywords"] for r in keywords.scan(files, declared).collect()}
    words = [f" w{i} " for i in range(10_000)]
    for r in files.where("path % 50 = 0").collect():
        assert got[r["path"]] == sorted(w for w in words if w in r["text"])


def random_globs(draw, n):
    part = lambda: draw.choice(["*", "**", "a", "b", "*.py", "a*", "?", "[ab]c", "[!a]*", "x*y", "*.tar.gz", "a.b", "*b*", "ab?"])
    return [draw.choice(["", "", "", "/"]) + "/".join(part() for _ in range(draw.randint(1, 4))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_the_index_of_globs_is_each_of_them(seed):
    draw = random.Random(seed)
    listed = random_globs(draw, 120)
    index = globs.GlobIndex(listed)
    name = lambda: draw.choice(["a", "b", "ab", "ac", "bc", "x.py", "xy", "xzy", "a.b", "abc", "q.tar.gz", ""])
    for _ in range(300):
        path = "/".join(name() for _ in range(draw.randint(1, 5)))
        want = [i for i, g in enumerate(listed) if component_wise(path, g)]
        assert index.matches(path) == want, path


def component_wise(path, glob):
    parts, names = [p for p in glob.split("/") if p], path.split("/")
    if len(parts) > len(names) or (glob.startswith("/") and len(parts) != len(names)):
        return False
    return all(re.search(globs.match_regex(p).replace("(?:^|/)", "^"), n) is not None for p, n in zip(parts, names[len(names) - len(parts) :], strict=True))


def test_a_path_meets_few_of_many_rules(spark):
    listed = [f"src/**/part{i}/*.x{i % 500}" for i in range(5000)] + [f"*.y{i}" for i in range(5000)] + ["**/*.x7"]
    index = globs.GlobIndex(listed)
    assert index.matches("src/a/part7/main.x7") == [7, 10_000] and index.matches("z.y44") == [5044]
    assert index.tried < 10
    rules = spark.createDataFrame([("p", i, g, "high") for i, g in enumerate(listed)], "pattern string, rule_no int, glob string, priority string")
    files = spark.createDataFrame([("src/a/part7/main.x7",), ("src/a/part7/main.x7",), (None,), ("",)], "path string")
    found = relevance.match_rules(files, rules)
    assert sorted(r["rule_no"] for r in found.collect()) == [7, 10_000]
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        relevance.match_rules(files, rules, limit=10)
