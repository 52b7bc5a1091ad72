"""Readers, parsers, sinks and stream folds on small files."""

import gzip
import json

from pyspark.sql import functions as F

from quarrymill.operators import quality_gate
from quarrymill.sources import parsers, readers, sinks
from quarrymill.streaming import event_fold


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_archive(spark, tmp_path):
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        f.write('{"repo": {"name": "x/y"}}\nbroken\n{"repo": {"name": "x/y"}}\n{"repo": {"name": ""}}\n{"other": 1}\n')
    assert [r["name"] for r in readers.archive_names(spark, str(tmp_path / "a.json.gz")).collect()] == ["x/y"]


def test_repositories_gate_and_sinks(spark, tmp_path):
    doc = {"name": "o/r", "metadata": {"created_at": "2020-01-01T00:00:00Z", "stargazers_count": 50, "size": 9, "language": "Go", "description": None, "url": "u"}, "contributors_data": {"a": {"contributions": 3, "emails": ["a@x.org"]}, "b": {"contributions": 1, "emails": []}}, "file_tree_data": [{"path": "Dockerfile", "type": "blob"}], "recent_commits_count_3_months": 4}
    path = write(tmp_path / "repos.jsonl", json.dumps(doc) + "\nnot json\n")
    repos = readers.repositories(spark, path)
    assert repos.count() == 1 and readers.repositories(spark, path, corrupt=True).count() == 2
    assert readers.contributors(repos).count() == 2
    audited = quality_gate.audit(readers.flat_repositories(repos), quality_gate.GateConfig("2025-01-01", min_contributors=2, patterns=("**/Dockerfile",)))
    assert audited.first()["status"] == "PASS"
    sinks.write_gate(audited, str(tmp_path / "pass"), str(tmp_path / "log"), F.col("name"), ["name", "stars"])
    assert spark.read.json(str(tmp_path / "pass")).count() == 1 and spark.read.json(str(tmp_path / "log")).first()["status"] == "PASS"
    sinks.write_csv(repos.select("name", F.lit("x").alias("other")), str(tmp_path / "csv"), ["name"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["name"]


def test_reports(spark, tmp_path):
    write(tmp_path / "r/a.json", json.dumps({"summary": {"repository_name": "a", "detected_patterns": ["p"]}, "patterns": {"p": True, "q": False}, "scanned_files_per_pattern": {"p": ["f"], "q": []}}, indent=1))
    write(tmp_path / "r/sub/b.json", json.dumps({"summary": {"repository_name": "b", "detected_patterns": []}, "patterns": {}, "scanned_files_per_pattern": {}}))
    write(tmp_path / "r/bad.json", "{nothing")
    rows = readers.reports(spark, str(tmp_path / "r"))
    assert rows.count() == 2
    assert sorted((r["pattern"], r["detected"]) for r in readers.detections(rows).collect()) == [("p", True), ("q", False)]
    assert readers.scanned_files(rows).count() == 1
    assert readers.select_reports(rows, repositories=["b"]).count() == 1 and readers.select_reports(rows, judge=7).count() == 0
    nested = sinks.nested_reports(readers.detections(rows).select("repo", "pattern", "detected"), readers.scanned_files(rows), "run1", {"k": "v"}).first()
    assert nested["summary"]["detected_patterns"] == ["p"] and nested["patterns"] == {"p": True, "q": False}


def test_patterns(spark):
    good = "pattern_name: P\ndescription: d\nrepository_fingerprint:\n  glob_patterns:\n  - {glob: '**/*.py', search_method: keyword, analysis_priority: high, keywords: [a, b], anti_keywords: [c]}\npositive_examples: ['twenty characters and more']\n"
    bad = "pattern_name: Q\ndescription: d\nrepository_fingerprint:\n  glob_patterns:\n  - {glob: x, search_method: magic}\n"
    t = readers.patterns(spark, [good, bad, "a: [", ""])
    assert t["pattern"].count() == 1 and t["rule"].first()["priority"] == "high" and t["keyword"].count() == 3
    assert {r["pattern"] for r in t["problem"].where("problem not like 'WARNING%'").collect()} == {"Q", "#2", "#3"}


def test_patterns_of_a_folder(spark, tmp_path):
    for k in range(5):
        write(tmp_path / f"patterns/p{k}.yaml", f"pattern_name: P{k}\ndescription: d\nrepository_fingerprint:\n  glob_patterns:\n  - {{glob: '*.x{k}', search_method: keyword, keywords: [a, {k}]}}\n")
    write(tmp_path / "patterns/bad.yaml", "- a list")
    t = readers.patterns_of(readers.folder(spark, str(tmp_path / "patterns")))
    assert sorted((r["pattern"], r["rule_no"], r["glob"], r["priority"]) for r in t["rule"].collect()) == [(f"P{k}", 0, f"*.x{k}", "low") for k in range(5)]
    assert {r["keyword"] for r in t["keyword"].where("pattern = 'P3'").collect()} == {"a", "3"}
    assert {r["pattern"] for r in t["problem"].where("problem not like 'WARNING%'").collect()} == {"bad.yaml"}
    assert all(t[k].columns == list(c) for k, c in readers.PATTERN_TABLES.items())


def test_folder(spark, tmp_path):
    write(tmp_path / "in/a.py", "x = 1")
    write(tmp_path / "in/node_modules/b.js", "y")
    (tmp_path / "in/c.txt").write_bytes(b"caf\xe9")
    rows = {r["path"]: r["text"] for r in readers.folder(spark, str(tmp_path / "in")).collect()}
    assert rows == {"a.py": "x = 1", "c.txt": "café"}


def test_graph_of_files(spark):
    files = [
        ("svc/Dockerfile", "FROM python:3\nEXPOSE 80\nexpose 81"),
        ("package.json", '{"dependencies": {"a": "1"}, "devDependencies": {"b": "2"}}'),
        ("main.tf", 'resource "aws_x" "one" {}\nmodule "net" {}'),
        ("pom.xml", "<dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId></dependency></dependencies>"),
        ("docker-compose.yml", "services:\n  web: {depends_on: [db]}\n  db: {}\n"),
        ("k.yaml", "apiVersion: v1\nkind: Service\nmetadata: {name: s}\nspec: {ports: [{port: 8080}]}\n"),
        ("i.yaml", "apiVersion: v1\nkind: Ingress\nmetadata: {name: i}\nspec: {rules: [{http: {paths: [{backend: {service: {name: s}}}]}}]}\n"),
        ("app.py", "import os\nclass OrderService:\n    def run(self):\n        return 'http://x.org'\n"),
        ("run.lua", "function go()\nend"),
        ("empty.yaml", None),
    ]
    nodes, edges = parsers.build_graph(spark.createDataFrame(files, "path string, text string"))
    found = {(r["src"], r["dst"], r["type"]) for r in edges.collect()}
    for e in [
        ("svc/Dockerfile", "service:svc:80", "defines_service"), ("svc/Dockerfile", "docker_image:python:3", "uses_base_image"), ("package.json", "npm:b", "requires"), ("main.tf", "terraform:aws_x.one", "defines_resource"),
        ("main.tf", "terraform:module.net", "uses_module"), ("pom.xml", "maven:g:a", "requires"), ("service:web", "service:db", "depends_on"), ("k8s_service:s", "k8s_endpoint:s:8080", "exposes_port"), ("k8s_ingress:i", "k8s_service:s", "routes_to"),
        ("app.py", "app.py:OrderService", "defines"), ("app.py", "app.py:run", "defines"), ("app.py", "dep:os", "imports"), ("app.py", "str:http://x.org", "uses_string"), ("run.lua", "run.lua:go", "defines"),
    ]:
        assert e in found, e
    assert nodes.where("type = 'file'").count() == len(files)


def test_log_fold(spark, tmp_path):
    lines = [{"event": "pattern_analysis_start", "pattern": "early"}, {"event": "session_start", "session_id": "s"}, {"event": "session_start", "run_id": "r"}, {"event": "file_scored", "pattern": "p", "file": "before"}, {"event": "pattern_analysis_start", "pattern": "p"}, {"event": "file_scored", "pattern": "p", "file": "f"}, {"event": "file_scored", "pattern": "p", "file": "f"}, {"event": "investigation_phase_complete", "pattern": "p", "files_analyzed": 3}, {"event": "pattern_analysis_end", "pattern": "p", "detected": True}]
    path = write(tmp_path / "log/detection_1.log", "\n".join(map(json.dumps, lines)) + "\n{broken\n")
    log = event_fold.with_run(readers.detection_log(spark, path))
    got = event_fold.pattern_reports(log).collect()
    assert [(r["run"], r["pattern"], r["files"], r["files_analyzed"], r["detected"]) for r in got] == [("r", "p", ["f"], 3, True)]
    assert event_fold.pattern_reports(log, gated=False).first()["n_files"] == 3
    counts = event_fold.stream_pattern_counts(spark, str(tmp_path / "log"), str(tmp_path / "counts"), str(tmp_path / "state"))
    assert counts.where("event = 'file_scored'").first()["n"] == 3


def test_stream_evolution(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k, 1, 0, 2)], "tp long, fp long, tn long, fn long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    event_fold.stream_evolution(spark, str(tmp_path / "in"), "tp long, fp long, tn long, fn long", str(tmp_path / "out"), str(tmp_path / "state"))
    last = event_fold.evolution_so_far(spark, str(tmp_path / "out")).orderBy(F.desc("batch")).first()
    assert (last["tp"], last["fp"], last["fn"]) == (3, 3, 6)


def test_survey_and_last_wins(spark, tmp_path):
    path = write(tmp_path / "s.csv", "id,G01Q04[SQ001]. a,g01q04[SQ002]. b\n1,yes,no\n,,\n2,,\n")
    rows = readers.survey(spark, path)
    assert rows.count() == 2 and readers.columns_by_prefix(rows.columns, "G01Q04[SQ002]") == ["g01q04[SQ002]. b"]
    assert readers.unpivot_answers(rows, "id", rows.columns[1:]).count() == 4
    a = spark.createDataFrame([("x", 1), ("x", 2), ("", 9)], "k string, v int").coalesce(1)
    b = spark.createDataFrame([("y", 3), ("x", 4)], "k string, v int").coalesce(1)
    assert sorted(map(tuple, readers.last_wins([a, b], "k").collect())) == [("x", 4), ("y", 3)]


def test_code_of_every_language(spark):
    files = [
        ("a/x.java", "import java.util.List;\n@Service\npublic class Shop {\n    @Get\n    public int price(int a) {\n        return count(a);\n    }\n}\n"),
        ("a/x.cs", "using System.Text;\n[HttpGet]\npublic class Cart {\n    public void Fill(int a) { }\n}\n"),
        ("a/x.php", "<?php\nuse App\\Thing;\n#[Route]\nfunction show($a) { }\n"),
        ("a/x.rs", "use std::fs;\n#[test]\nfn probe() { }\n"),
        ("a/x.go", 'import "fmt"\nfunc Run(a int) {\n}\ntype Box struct {\n}\n'),
        ("a/x.rb", "require 'json'\ndef go(a)\nend\nclass Cat\nend\n"),
        ("a/x.sh", "source lib.sh\nstart() {\n}\n"),
        ("a/b/x.js", "const y = require('../z')\nfunction f(a) { return g(a) }\n"),
        ("a/z.ts", "import q from '../w/index'\nfunction g(a) { return 1 }\n"),
        ("w/index.js", "function h() { }\n"),
        ("a/p.py", "from .q import x\nfrom ..w.r import y\n"),
        ("a/q.py", ""),
        ("w/r.py", ""),
    ]
    nodes, edges = parsers.build_graph(spark.createDataFrame(files, "path string, text string"))
    found = {(r["src"], r["dst"], r["type"]) for r in edges.collect()}
    for e in [
        ("a/x.java", "a/x.java:Shop", "defines"), ("a/x.java", "a/x.java:price", "defines"), ("a/x.java", "dep:java.util.List", "imports"), ("a/x.cs", "a/x.cs:Cart", "defines"), ("a/x.cs", "a/x.cs:Fill", "defines"), ("a/x.cs", "dep:System.Text", "imports"),
        ("a/x.php", "a/x.php:show", "defines"), ("a/x.php", "dep:App\\Thing", "imports"), ("a/x.rs", "a/x.rs:probe", "defines"), ("a/x.rs", "dep:std::fs", "imports"), ("a/x.go", "a/x.go:Run", "defines"), ("a/x.go", "a/x.go:Box", "defines"), ("a/x.go", "dep:fmt", "imports"),
        ("a/x.rb", "a/x.rb:go", "defines"), ("a/x.rb", "a/x.rb:Cat", "defines"), ("a/x.rb", "dep:json", "imports"), ("a/x.sh", "a/x.sh:start", "defines"), ("a/x.sh", "dep:lib.sh", "imports"),
        ("a/b/x.js", "a/z.ts", "imports"), ("a/z.ts", "w/index.js", "imports"), ("a/p.py", "a/q.py", "imports"), ("a/p.py", "w/r.py", "imports"), ("a/b/x.js:f", "a/z.ts:g", "calls"),
    ]:
        assert e in found, e
    assert not any(d.startswith("dep:.") for _, d, _ in found)
    marks = {r["id"]: r["decorators"] for r in nodes.where("decorators IS NOT NULL").collect()}
    # a function that begins soon after goes before a class
    assert marks == {"a/x.java:price": ["@Get", "@Service"], "a/x.cs:Fill": ["[HttpGet"], "a/x.php:show": ["#[Route"], "a/x.rs:probe": ["#[test"]}


def test_yaml_of_other_shapes(spark):
    files = [
        ("list.yaml", "- a\n- b\n"),
        ("bad.yaml", "a: [1\n b: {"),
        ("named.yaml", "apiVersion: v1\nkind: Custom\nmetadata: {}\n"),
        ("odd.yaml", "apiVersion: v1\nkind: Service\nmetadata: {name: 7}\nspec: {ports: [{port: 80}, {name: x}], rules: 3}\n"),
        ("old.yaml", "apiVersion: v1\nkind: Ingress\nmetadata: {name: i}\nspec: {rules: [{http: {paths: [{backend: {serviceName: s}}]}}, {host: h}]}\n"),
        ("map.yml", "services:\n  a: {depends_on: {b: {condition: up}}}\n  c:\n"),
        ("date.yml", "when: 2020-01-01\n"),
    ]
    found = {(r["src"], r["dst"], r["type"]) for r in parsers.yaml_files(spark.createDataFrame(files, "path string, text string")).collect()}
    assert found == {
        ("named.yaml", "k8s_resource:unknown", "defines_resource"),
        ("odd.yaml", "k8s_service:7", "defines_resource"),
        ("k8s_service:7", "k8s_endpoint:7:80", "exposes_port"),
        ("old.yaml", "k8s_ingress:i", "defines_resource"),
        ("k8s_ingress:i", "k8s_service:s", "routes_to"),
        ("map.yml", "service:a", "defines_service"),
        ("map.yml", "service:c", "defines_service"),
    }
