"""What keeps queries in bounds on larger tables, seen on small ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarrymill.llm import near_copies
from quarrymill.operators import quality_gate, relevance, vectors
from quarrymill.plans import code, records
from quarrymill.sources import parsers, scopes, tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", ["code_graph_nodes", "import_targets", "decorator_targets", "function_bodies", "function_chunks"])
def test_no_table_of_files_is_broadcast(spark, sf_dir, query):
    assert "Broadcast" not in plan(getattr(code, query)(spark, sf_dir))


def test_calls_are_resolved_without_broadcasts(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(parsers, "cut", lambda df, parts=None: df)
    assert "Broadcast" not in plan(parsers.call_edges(scopes.items(code.source_files(spark, sf_dir))))


@pytest.mark.parametrize("made", [code.source_files, code.nested_files, code.config_files, records.repositories])
def test_files_are_made_in_many_parts(spark, sf_dir, made):
    assert made(spark, sf_dir).rdd.getNumPartitions() >= 8


def test_rows_are_spread_whole(spark):
    rows = tables.spread(spark.range(1000), "id", each=50)
    assert rows.rdd.getNumPartitions() == 20 and sorted(r["id"] for r in rows.collect()) == list(range(1000))


def test_yaml_is_read_once(spark, sf_dir):
    assert "ArrowEvalPython" not in plan(parsers.yaml_files(code.config_files(spark, sf_dir)))


def test_yaml_is_parsed_where_files_were_dealt(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(parsers, "cut", lambda df, parts=None: seen.append(plan(df)) or df)
    parsers.yaml_files(spark.createDataFrame([("a.yaml", "kind: x")], "path string, text string").repartition(3))
    assert "ArrowEvalPython" not in seen[0].split("Exchange", 1)[1]


@pytest.mark.parametrize("made", [code.source_files, code.nested_files, code.config_files])
def test_conditions_on_files_stay_where_files_were_dealt(spark, sf_dir, made):
    assert "Exchange" not in plan(made(spark, sf_dir).where("path LIKE '%a' AND length(text) > 3"))


@pytest.mark.parametrize("query", ["decorator_targets", "scoped_calls", "function_bodies"])
def test_parts_go_by_rows(spark, sf_dir, query, monkeypatch):
    monkeypatch.setattr(code, "parts_for", lambda rows, each=0: 23)
    assert getattr(code, query)(spark, sf_dir).rdd.getNumPartitions() == 23


def test_blocks_are_searched_once(spark):
    rows = spark.createDataFrame([("def f(): pass", ["f"])], "text string, names array<string>").repartition(2)
    assert plan(rows.select(relevance.chunks(F.col("text")).alias("c"))).count("regexp_extract_all") == 3
    assert plan(rows.select(relevance.function_chunks(F.col("text"), F.col("names")).alias("c"))).count("regexp_extract_all") == 4


def test_blanks_inside_do_not_count(spark):
    rows = spark.createDataFrame([("Onhaha sh.",), ("Onhahaxsh.",), (None,)], "text string")
    assert [r[0] for r in rows.select(quality_gate.has_words(F.lit(0.0), F.col("text"))).collect()] == [False, True, None]


def test_a_claim_meets_one_path_of_each_key(spark):
    real = spark.range(2000).select(F.concat(F.lit("D"), F.col("id").cast("string"), F.lit("/x/")).alias("path"), F.col("id").alias("seq"))
    claims = spark.range(2000).select(F.col("id").alias("claim_id"), F.concat(F.lit("d"), F.col("id").cast("string"), F.lit("/X/")).alias("claimed"))
    found = relevance.resolve_paths(claims, real)
    assert all((r["path"], r["stage"]) == (f"D{r['claim_id']}/x/", 2) for r in found.collect())
    assert "Window" not in plan(found)  # no row for each path of a file name


def test_few_distances_are_held_at_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((400, 8))
    rows = spark.createDataFrame(pd.DataFrame({"id": range(400), "v": v.tolist()}))
    q, i = rows.where("id % 4 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("qvec")), rows.where("id % 4 <> 0").select(F.col("id").alias("item_id"), F.col("v").alias("ivec"))
    whole = vectors.nearest(q, i, 3, size=8).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(vectors, "AT_ONCE", 50)
    monkeypatch.setattr(vectors, "ROWS", 7)
    assert [len(range(400)[s]) for s in vectors._slices(400, 10)] == [5] * 80
    assert vectors.nearest(q, i, 3, size=8).orderBy("query_id", "rank").collect() == whole


def test_fingerprints_propose(spark):
    rows = spark.createDataFrame([(1, 0), (2, 0), (3, 3), (4, -1)], "label long, fp long")
    assert {tuple(r) for r in near_copies._by_print(rows).collect()} == {(1, 2), (1, 3)}
