"""Boundaries of the operators on literal rows, golden values, and properties."""

import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrymill.functions import dates, globs, rates
from quarrymill.functions import text as T
from quarrymill.operators import dedup, evaluate, graph, quality_gate, relevance, shares, stats, vectors


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_golden_rates(spark):
    row = evaluate.with_rates(spark.createDataFrame([(114, 116, 1246, 234)], "tp long, fp long, tn long, fn long")).first()
    assert [round(row[c], 10) for c in ("precision", "recall", "accuracy", "f1")] == [0.4956521739, 0.3275862069, 0.7953216374, 0.3944636678]
    none = evaluate.with_rates(spark.createDataFrame([(0, 0, 9, 0)], "tp long, fp long, tn long, fn long")).first()
    assert (none["precision"], none["recall"], none["accuracy"], none["f1"]) == (0, 0, 1, 0)


def test_ages(spark):
    d = lambda s: F.to_date(F.lit(s))
    assert round(value(spark, dates.age_months(d("2024-01-15"), d("2025-01-31"))), 6) == round(382 / 30.44, 6)
    assert value(spark, dates.age_months_floor(d("2024-01-15"), d("2025-01-31"))) == 12
    assert value(spark, dates.age_months(F.lit(None).cast("date"), d("2025-01-31"))) is None
    assert value(spark, dates.iso_timestamp(F.lit("no date"))) is None


@pytest.mark.parametrize("glob,reduced", [("src/**/docker-compose.yaml", ".yaml"), ("**/*.proto", ".proto"), ("src/**/Dockerfile", "Dockerfile"), ("**/.gitignore", ".gitignore"), ("**/*", None), ("*.y*ml", ".y*ml")])
def test_reduced_globs(spark, glob, reduced):
    assert value(spark, globs.reduce_glob(F.lit(glob))) == reduced


@pytest.mark.parametrize("glob,path,match,whole", [("**/Dockerfile", "Dockerfile", False, True), ("**/Dockerfile", "a/b/Dockerfile", True, True), ("*.py", "a/b.py", True, False), ("a/*.py", "x/a/b.py", True, False), ("**/x/**/*.json", "p/x/q/r.json", True, True), ("**/.git/**", ".git/config", False, True), ("**/.*", "a/.env", True, True), ("**/*.min.js", "x/y.min.js", True, True), ("a?[bc].txt", "axb.txt", True, True)])
def test_glob_dialects(glob, path, match, whole):
    assert bool(re.search(globs.match_regex(glob), path)) == match
    assert bool(re.search(globs.path_regex(glob), path)) == whole


def test_paths_and_counts(spark):
    assert value(spark, T.suffix(F.lit("a/b.tar.gz"))) == ".gz" and value(spark, T.suffix(F.lit("a/.env"))) == "[no ext]"
    assert value(spark, T.occurrences(F.lit("aaaa"), F.lit("aa"))) == 2 and value(spark, T.occurrences(F.lit("a"), F.lit(""))) == 0
    assert value(spark, T.parent(F.lit("a/b/c"))) == "a/b" and value(spark, T.first_dir(F.lit("c"))) == ""
    assert value(spark, T.is_generic_email(F.lit("not an address"))) and not value(spark, T.is_generic_email_lenient(F.lit("not an address")))
    assert value(spark, T.is_generic_email(F.lit("x@users.noreply.github.com"))) and value(spark, T.is_generic_email(F.lit(None).cast("string")))
    assert value(spark, T.squeeze(F.lit("abcdefghij"), 4, "-")) == "ab-ij"
    assert value(spark, rates.unit_interval(F.lit("bad"))) == 0 and value(spark, rates.unit_interval(F.lit("3"))) == 1


@pytest.mark.parametrize("raw,k", [('{"k": 1}', 1), ('x ```json\n{"k": 2}\n``` y', 2), ('{"k": 3,}', 3), ('Here is {"k": 4} done', 4), ("none", None)])
def test_json_repair(spark, raw, k):
    assert value(spark, T.json_repaired(T.json_block(F.lit(raw)), "k long")["k"]) == k


def test_keyword_and_other_scores(spark):
    score = relevance.keyword_score(F.lit("class Eureka:"), F.array(F.lit("eureka")), F.array().cast("array<string>"))
    assert round(value(spark, score), 6) == 0.6
    assert value(spark, relevance.keyword_score(F.lit("x"), F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0
    assert round(value(spark, relevance.priority_score(F.lit(0.5), F.lit(0.2), F.lit(0.9), F.lit(1.0))), 6) == 0.82
    one = relevance.class_score(spark.createDataFrame([("f", "OrderService")], "file string, name string")).first()
    assert round(one["class_score"], 6) == 0.571429
    url = relevance.string_score(spark.createDataFrame([("f", "http://x.org"), ("f", "words")], "file string, value string")).first()
    assert round(url["string_score"], 6) == 0.333333
    plan = spark.range(1).select(score)._jdf.queryExecution().toString()
    assert "Python" not in plan


def python_chunks(text, size=2000):
    patterns = [r"(?:class|interface|struct)\s+\w+.*?(?=\n(?:class|interface|struct)\s|\Z)", r"(?:def|function|func|public|private)\s+\w+\s*\([^)]*\).*?(?=\n(?:def|function|func|public|private)\s|\Z)", r"@\w+.*?\n(?:def|function|async\s+function)\s+\w+.*?(?=\n(?:def|function|@)\s|\Z)"]
    out = [m[:size] for p in patterns for m in re.findall(p, text, re.S | re.M | re.I) if len(m) > 100]
    if not out and len(text) > 500:
        third = min(len(text) // 3, 5000)
        out = [text[:size], text[third : third + size]] + ([text[-size:]] if len(text) > size else [])
    return out[:10]


@pytest.mark.parametrize("text", ["", "short", "x" * 600, "line\n" * 900, "class A:\n" + "    pass\n" * 30 + "\nclass B:\n" + "    pass\n" * 3, "def f(x):\n" + "    return 1\n" * 20 + "\ndef g():\n" + "  y = 2\n" * 40])
def test_chunks(spark, text):
    assert value(spark, relevance.chunks(F.lit(text))) == python_chunks(text)


def walk(rows):
    taken, out = set(), []
    for repo, position, member, emails in sorted(rows):
        for e in emails:
            e = e.strip().lower()
            if e not in taken and re.match(T.EMAIL_FORM, e) and "noreply" not in e:
                taken.add(e)
                out.append((repo, position, member, e))
                break
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_claim_is_the_walk(spark, seed):
    random.seed(seed)
    rows = [(random.randrange(8), i, f"m{i}", [random.choice([f"u{random.randrange(25)}@x.org", "noreply@x.org", "bad", f"U{random.randrange(25)}@X.org "]) for _ in range(random.randrange(4))]) for i in range(60)]
    got = dedup.claim(spark.createDataFrame(rows, "repo int, position int, member string, emails array<string>"), "repo", "position", "member", "emails")
    assert sorted(map(tuple, got.collect())) == walk(rows)
    two = spark.createDataFrame([(1, 0, "a", ["a@x.org", "b@x.org"]), (2, 0, "b", ["b@x.org"])], "repo int, position int, member string, emails array<string>")
    assert sorted(r["claimed"] for r in dedup.claim(two, "repo", "position", "member", "emails").collect()) == ["a@x.org", "b@x.org"]


def test_gate_boundaries(spark):
    config = quality_gate.GateConfig(as_of="2025-01-31", min_stars=5, min_age_months=1, min_contributors=1, min_size=10, max_size=20, patterns=("**/Dockerfile", "*.proto"))
    schema = "name string, stars long, created_at string, contributors map<string, struct<contributions:long, emails:array<string>>>, recent_commits long, size long, file_tree array<struct<path:string, type:string>>"
    good = ("g", 5, "2024-01-01", {"u": (1, ["u@x.org"])}, 1, 20, [("a/Dockerfile", "blob")])
    rows = [good, ("null age", 5, None, {"u": (1, ["u@x.org"])}, 1, 10, [("x.proto", "blob")]), ("bare", None, "2025-01-30", None, None, 21, [("xDockerfile", "blob")]), ("generic", 5, "2024-01-01", {"u": (1, ["noreply@x.org", None])}, 1, 15, [("Dockerfile", "blob")])]
    got = {r["name"]: r for r in quality_gate.audit(spark.createDataFrame(rows, schema), config).collect()}
    assert got["g"]["status"] == "PASS" and got["null age"]["failed_filters"] == ["age_months"] and got["generic"]["failed_filters"] == ["valid_emails"]
    assert got["bare"]["failed_filters"] == list(quality_gate.CHECKS)


def test_page_rank(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "id long")
    pairs = [(0, 1), (1, 2), (2, 0), (3, 2), (4, 2)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    r = [1 / 6] * 6
    for _ in range(60):
        lost = r[5]
        new = [0.15 / 6 + 0.85 * lost / 6] * 6
        for s, d in pairs:
            new[d] += 0.85 * r[s] / sum(a == s for a, _ in pairs)
        r = new
    got = {x["id"]: x for x in graph.page_rank(nodes, edges).collect()}
    assert all(abs(got[i]["rank"] - r[i]) < 1e-4 for i in range(6)) and max(x["centrality"] for x in got.values()) == 1
    assert graph.page_rank(nodes.where("false"), edges).count() == 0


def test_statistics(spark):
    f1 = [(0.0870, 1.0), (0.4667, 2.0), (0.2424, 1.5), (0.4167, 2.5)]
    rows = spark.createDataFrame(f1, "y double, x double")
    z = [r["z"] for r in stats.residuals(rows, "x", "y").collect()]
    assert abs(sum(x * x for x in z) / 4 - 1) < 1e-9
    assert stats.spearman(rows, "x", "y").first()["rho"] == pytest.approx(0.8)
    assert stats.correlation_p_value(0.5, 12) == pytest.approx(0.0979, abs=2e-3)
    assert stats.f_p_value(4.0, 2, 20) == pytest.approx(0.0346, abs=2e-3)
    assert tuple(stats.bootstrap_mean(rows.limit(2), "y", "x").first())[1:] == (0, 0, 0)
    d = stats.dominance(spark.createDataFrame([("p", "a"), ("p", "a")] + [("p", f"n{i}") for i in range(54 - 1)] + [("p", "n0")], "p string, f string"), "p", "f").where("rank = 1").first()
    assert d["dominance"] == pytest.approx(2 * 54 / 56)


def test_vectors(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "query_id long, qvec array<double>")
    i = spark.createDataFrame([(k, [math.cos(k), math.sin(k)]) for k in range(9)], "item_id long, ivec array<double>")
    got = vectors.nearest(q, i, 2, block=4).where("query_id = 1").orderBy("rank").collect()
    assert [r["item_id"] for r in got] == [0, 6]
    new = vectors.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string"), spark.createDataFrame([(2, "c")], "id int, t string"))
    assert sorted(map(tuple, new.collect())) == [(1, "a"), (2, "c")]


def test_prices_by_first_prefix(spark):
    calls = spark.createDataFrame([("op", "m-1-mini", 10**6, 0), ("op", "zzz", 5, 5)], "operation string, model string, tokens_in long, tokens_out long")
    prices = spark.createDataFrame([(1, "m-1", 2.0, 0.0), (2, "m-1-mini", 9.0, 0.0)], "ord int, prefix string, price_in double, price_out double")
    assert shares.cost_ledger(calls, prices).first()["cost"] == 2.0
    calls = spark.createDataFrame([("a", "é-1", 10**6, 0), ("b", "", 10**6, 0), ("c", None, 10**6, 0), ("d", "e", 10**6, 0)], "operation string, model string, tokens_in long, tokens_out long")
    priced = lambda rows: {r["operation"]: r["cost"] for r in shares.cost_ledger(calls, spark.createDataFrame(rows, prices.schema), (1.0, 1.0)).collect()}
    assert priced([(2, "", 5.0, 0.0), (1, "é-", 3.0, 0.0)]) == {"a": 3.0, "b": 5.0, "c": 1.0, "d": 5.0}
    assert priced([]) == {"a": 1.0, "b": 1.0, "c": 1.0, "d": 1.0}


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.booleans()), min_size=1, max_size=30))
def test_counts_add_up(rows):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    r = evaluate.confusion(spark.createDataFrame(rows, "truth boolean, detected boolean"), []).first()
    assert sum(r) == len(rows) and r["tp"] == sum(a and b for a, b in rows)


def test_resolution_stages(spark):
    real = spark.createDataFrame([("src/A.py", 1), ("lib/b.py", 2), ("c/b.py", 3)], "path string, seq int")
    claims = spark.createDataFrame([(1, "src/A.py"), (2, "SRC/a.PY"), (3, "A.py"), (4, "x/b.py"), (5, "none.py")], "claim_id int, claimed string")
    got = {r["claim_id"]: (r["path"], r["stage"]) for r in relevance.resolve_paths(claims, real).collect()}
    assert got == {1: ("src/A.py", 1), 2: ("src/A.py", 2), 3: ("src/A.py", 3), 4: ("lib/b.py", 4), 5: (None, None)}


def test_decorators_and_hints(spark):
    marks = spark.createDataFrame([("f", "@a", 10), ("f", "@b", 300), ("f", "@c", 900)], "file string, name string, stop int")
    defined = spark.createDataFrame([("f", "K", "class", 12), ("f", "g", "function", 60), ("f", "L", "class", 310), ("f", "h", "function", 1000)], "file string, name string, type string, start int")
    got = {r["decorator"]: r["target"] for r in graph.attached_decorators(marks, defined).collect()}
    assert got == {"@a": "g", "@b": "L"}
    rules = spark.createDataFrame([("p", 1, "b", "high"), ("p", 0, "a", "high"), ("p", 2, "c", None)], "pattern string, rule_no int, glob string, priority string")
    words = spark.createDataFrame([("p", 1, "y", "pos", 0), ("p", 0, "x", "pos", 1), ("p", 0, "z", "pos", 0), ("p", 2, "x", "pos", 0)], "pattern string, rule_no int, keyword string, kind string, seq int")
    row = relevance.hints(rules, words).first()
    assert (row["high"], row["low"], row["keywords"], row["anti_keywords"]) == (["a", "b"], ["c"], ["z", "x", "y"], [])


def test_settings():
    from quarrymill.config import Settings

    assert Settings().problems() == []
    for wrong in ({"llm_weight": 0.9}, {"medium": 0.6}, {"judge_confidence": 11}, {"keyword_weight": -0.1, "embedding_weight": 0.4}):
        with pytest.raises(ValueError):
            Settings(**wrong)


def test_claim_query_is_the_walk(spark, sf_dir):
    from quarrymill.plans.curation import email_claim_dedup
    from quarrymill.sources import read_table

    address = lambda x: f"u{x}@mail.example.com"
    rows = [(r["event_id"] % 97, r["event_id"], f"m{r['event_id']}", [address(r["user_id"]), address((r["user_id"] * 7 + r["event_id"]) % 400), address(r["user_id"] % 31)]) for r in read_table(spark, sf_dir, "events").collect()]
    assert sorted(map(tuple, email_claim_dedup(spark, sf_dir).collect())) == walk(rows)


def test_chunks_query_is_pythons(spark, sf_dir):
    from quarrymill.plans.ranking import chunks
    from quarrymill.sources import read_table

    got = {}
    for r in chunks(spark, sf_dir).collect():
        got.setdefault(r["doc_id"], []).append((r["pos"], r["chunk"]))
    texts = {r["doc_id"]: r["text"] or "" for r in read_table(spark, sf_dir, "documents").collect()}
    assert {i: [c for _, c in sorted(v)] for i, v in got.items()} == {i: c for i, t in texts.items() if (c := python_chunks(t))}


def python_bodies(text, names):
    """Bodies by hand: from each opening word before a listed name to the line before the next opening word."""
    opens, following = ("def", "function", "func", "class", "interface", "public", "private"), ("def", "function", "func", "class", "public", "private")
    out = []
    for name in names:
        at = 0
        while True:
            places = [m for w in opens for m in [re.compile(rf"{w}\s+{re.escape(name)}\s*[({{]", re.I).search(text, at)] if m]
            if not places:
                break
            first = min(places, key=lambda m: m.start())
            ends = [m.start() for w in following for m in re.finditer(rf"\n{w}\s", text[first.end() :], re.I)]
            end = first.end() + min(ends) if ends else len(text)
            out.append(text[first.start() : end])
            at = end
    return [b[:3000] for b in out if len(b) > 100][:10]


def test_function_chunks_query(spark, sf_dir):
    from quarrymill.plans.code import function_chunks, source_files

    got = {}
    for r in function_chunks(spark, sf_dir).collect():
        got.setdefault(r["path"], []).append((r["pos"], r["chunk"]))
    for r in source_files(spark, sf_dir).collect():
        text = r["text"] + "# more of it\n" * 12
        names = re.findall(r"(?m)^(?:def|class) (\w+)", text)
        want = python_bodies(text, names) or python_chunks(text)
        assert [c for _, c in sorted(got.get(r["path"], []))] == want


def test_function_chunks_cut_and_fall_back(spark):
    long = "def go(a):\n" + "    x = 1\n" * 500 + "\nclass Other:\n    pass\n"
    names = F.array(F.lit("go"), F.lit("a.b+c"), F.lit("gone"))
    assert value(spark, relevance.function_chunks(F.lit(long), names)) == python_bodies(long, ["go"]) == [long[:3000]]
    assert value(spark, relevance.function_chunks(F.lit("z" * 600), names)) == python_chunks("z" * 600)


@pytest.mark.parametrize("seed", range(3))
def test_call_resolution_against_all_definitions(spark, seed):
    random.seed(seed)
    calls = [(i, f"f{random.randrange(4)}", random.choice(["", "m."]) + f"g{random.randrange(6)}") for i in range(60)]
    defined = [(f"f{random.randrange(4)}", random.choice(["", "", "m."]) + f"g{random.randrange(6)}", i) for i in range(25)]
    want = {}
    for i, file, name in calls:
        base = name.split(".")[-1]
        found = [(1, s, f, n) for f, n, s in defined if f == file and n == name] + [(2, s, f, n) for f, n, s in defined if f == file and n == base] + [(3, s, f, n) for f, n, s in defined if f != file and n == base]
        want[i] = (f"{min(found)[2]}:{min(found)[3]}", min(found)[0]) if found else ("", None)
    got = graph.first_dotted(spark.createDataFrame(calls, "call_id int, file string, name string"), spark.createDataFrame(defined, "file string, name string, seq int")).collect()
    assert {r["call_id"]: (r["target"], r["stage"]) for r in got} == want


def test_running_total_is_that_of_one_order(spark):
    from quarrymill.operators.order import running_total

    random.seed(1)
    rows = [(i, random.randrange(9)) for i in range(500)]
    got = running_total(spark.createDataFrame(rows, "k int, w int").repartition(5), ["k"], F.col("w"), "before").collect()
    assert {r["k"]: r["before"] for r in got} == {k: sum(w for j, w in rows if j < k) for k, _ in rows}
    assert running_total(spark.createDataFrame([], "k int, w int"), ["k"], F.col("w"), "before").collect() == []


def test_keywords_of_matching_rules_only(spark):
    files = spark.createDataFrame([("a.py", "def Route():\n    test proxy proxy"), ("b.go", "proxy"), ("c.md", None)], "path string, text string")
    matches = spark.createDataFrame([("gate", "a.py", 0), ("gate", "b.go", 1), ("gate", "c.md", 0), ("other", "a.py", 0)], "pattern string, path string, rule_no int")
    words = [("gate", 0, "route", "pos"), ("gate", 0, "proxy", "pos"), ("gate", 0, "test", "anti"), ("gate", 1, "nothing", "pos"), ("other", 0, "absent", "pos"), ("other", 0, "test", "anti")]
    table = spark.createDataFrame(words, "pattern string, rule_no int, keyword string, kind string")
    got, shuffled = ({(r["pattern"], r["path"]): (r["keywords"], r["anti_keywords"], round(r["keyword_score"], 9)) for r in relevance.keyword_hits(files, matches, table, broadcast_rows=n).collect()} for n in (100_000, 1))
    assert got == shuffled
    # route: 0.15 + 0.25 in a line that defines + 0.03; proxy: 0.15 + 0.10 + 0.06; test takes 0.08; two keywords
    assert got == {("gate", "a.py"): (["proxy", "route"], ["test"], round((0.43 + 0.31 - 0.08) / 1.6, 9)), ("other", "a.py"): ([], ["test"], 0.0)}
    everywhere = relevance.keyword_scan(files, relevance.declared(words)).where("path = 'b.go'").collect()
    assert [(r["pattern"], r["keywords"], r["anti_keywords"]) for r in everywhere] == [("gate", ["proxy"], [])]


def one_component(members, seed):
    """Members of one chain: each shares an address with the next, and all have some of a few."""
    draw = random.Random(seed)
    return [(i % 7, i, f"m{i}", draw.sample([f"c{i}@x.org", f"c{i + 1}@x.org", f"h{draw.randrange(9)}@x.org", f"r{draw.randrange(members)}@x.org", " ", "noreply@x.org"], 4)) for i in range(members)]


@pytest.mark.parametrize("members", [1, 40, 400])
def test_claim_in_rounds_is_the_walk(spark, members):
    rows = one_component(members, members)
    rows += rows[:2]  # equal rows are members each
    claim = dedup.claim(spark.createDataFrame(rows, "repo int, position int, member string, emails array<string>").repartition(3), "repo", "position", "member", "emails")
    assert sorted(map(tuple, claim.collect())) == walk(rows)
    plan = claim._jdf.queryExecution().toString()
    assert "Pandas" not in plan and "Arrow" not in plan


def test_claim_of_nothing(spark):
    empty = spark.createDataFrame([(1, 1, "m", None), (1, 2, "n", []), (1, 3, "o", ["noreply@x.org"])], "repo int, position int, member string, emails array<string>")
    assert dedup.claim(empty, "repo", "position", "member", "emails").collect() == []
    assert dedup.claim(empty.where("false"), "repo", "position", "member", "emails").collect() == []


def large_group(spark):
    """One group of most rows, a small one and that of null."""
    random.seed(5)
    rows = [(g, i, random.choice([None, float(random.randrange(50)), random.random()])) for i, g in enumerate(["big"] * 900 + ["small"] * 3 + [None] * 20)]
    random.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, k int, x double").repartition(6)


def windows_of(df):
    return re.findall(r"Window \[.*?\], \[(.*?)\]", df._jdf.queryExecution().toString())


def test_running_totals_carry_a_group_over_ranges(spark):
    from quarrymill.operators.order import running_totals, with_sizes

    rows, df = large_group(spark)
    got = running_totals(df, ["g"], ["k"], {"place": F.lit(1), "sum": F.coalesce(F.col("k"), F.lit(0))}).collect()
    for g in ("big", "small", None):
        mine = sorted(k for h, k, _ in rows if h == g)
        assert {r["k"]: (r["place"], r["sum"]) for r in got if r["g"] == g} == {k: (i, sum(mine[:i])) for i, k in enumerate(mine)}
    sizes = {(r["g"], r["n"]) for r in with_sizes(df, ["g"], "n", broadcast_rows=0).collect()}
    assert sizes == {("big", 900), ("small", 3), (None, 20)}
    assert running_totals(df.where("false"), ["g"], ["k"], {"place": F.lit(1)}).collect() == []


def test_percentiles_by_places_are_numpys(spark):
    rows, df = large_group(spark)
    found = stats.describe(df, "x", ["g"])
    for r in found.collect():
        mine = np.array([x for g, _, x in rows if g == r["g"] and x is not None])
        assert r["n"] == len(mine)
        assert [r["p25"], r["median"], r["p75"]] == pytest.approx(np.percentile(mine, [25, 50, 75]).tolist() if len(mine) else [None] * 3)
    every = np.array([x for *_, x in rows if x is not None])
    assert stats.describe(df, "x", []).first()["median"] == pytest.approx(np.median(every))
    assert stats.describe(df.where("x is null"), "x", ["g"]).where("g = 'big'").first()["median"] is None
    assert "percentile" not in found._jdf.queryExecution().toString()


def test_splits_and_batches_have_no_window_of_a_group(spark):
    from quarrymill.operators import sampling

    rows, df = large_group(spark)
    split = sampling.stratified_split(df, "g", "k")
    assert {r["g"]: r["count"] for r in split.where("part = 'train'").groupBy("g").count().collect()} == {"big": 630, "small": 2, None: 14}
    batched = relevance.batches(df, ["k"], ["g"], size=100, threshold=50)
    of_big = sorted((r["k"], r["batch"]) for r in batched.where("g = 'big'").collect())
    assert [b for _, b in of_big] == [i // 100 for i in range(900)] and batched.where("g = 'small' and batch <> 0").isEmpty()
    for df in (split, batched):
        # by range and group, or over the table of one row for each range
        assert windows_of(df) and all("__part" in w or w.startswith("__last") for w in windows_of(df)), windows_of(df)


@pytest.mark.parametrize("part", [7, 50, 10_000])
def test_bootstrap_by_counts_is_a_bootstrap(spark, part):
    draw = np.random.default_rng(3)
    x = draw.exponential(10, 173)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(999, None)], "k int, x double")
    got = stats.bootstrap_by_counts(df, "x", "k", resamples=1500, part=part).first()
    again = stats.bootstrap_by_counts(df.repartition(7), "x", "k", resamples=1500, part=part).first()
    assert tuple(got) == pytest.approx(tuple(again), rel=1e-12)  # sums are added up in any order
    means = x[draw.integers(len(x), size=(20_000, len(x)))].mean(axis=1)
    lo, hi = np.percentile(means, [2.5, 97.5])
    assert got["n"] == 173 and got["mean"] == pytest.approx(x.mean())
    assert got["lo"] == pytest.approx(lo, abs=0.2) and got["hi"] == pytest.approx(hi, abs=0.2)


def test_bootstrap_by_counts_makes_n_draws_in_all(spark):
    ones = spark.range(1003).select("id", F.lit(1.0).alias("x"))
    assert tuple(stats.bootstrap_by_counts(ones, "x", "id", resamples=50, part=10).first()) == (1003, 1.0, 1.0, 1.0)
    assert tuple(stats.bootstrap_by_counts(ones.limit(2), "x", "id").first()) == (2, 0.0, 0.0, 0.0)


def test_files_worth_reading(spark):
    rows = [("a", 5, "0123456789"), ("b", 5, "  0123 5678\t\n\u00a0"), ("c", 11 * 1024 * 1024, "0123456789"), ("d", 5, None), ("e", 5, " " * 1000 + "0123456789"), ("f", 5, " 0 23 567 9 ")]
    df = spark.createDataFrame(rows, "path string, length long, text string")
    assert sorted(r["path"] for r in quality_gate.sane_files(df).collect()) == ["a", "f"]
