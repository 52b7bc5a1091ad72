import random

import pytest

import corpus_pipeline
from quarrymill.llm import near_copies


def sets(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def texts(seed, groups=8, size=14):
    """Groups of texts with a few words changed in each, chains among them."""
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(3000)}"
    out = []
    for _ in range(groups):
        base = [word() for _ in range(draw.randrange(60, 300))]
        for _ in range(size):
            own = list(base)
            for _ in range(draw.randrange(0, 5)):
                own[draw.randrange(len(own))] = word()
            out.append(" ".join(own))
            if draw.random() < 0.3:
                base = own
    return out


def brute(rows):
    """The least id that links reach, of each id."""
    of = {i: i for i, _ in rows}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    found = {i: sets(t) for i, t in rows}
    for i in found:
        for j in found:
            if i < j and similar(found[i], found[j]):
                a, b = sorted((root(i), root(j)))
                of[b] = a
    return {i: root(i) for i in of}


@pytest.mark.parametrize("crowd", [1, 4, 32])
def test_components_are_those_of_all_pairs(spark, crowd):
    rows = list(enumerate(texts(crowd)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["id"]: r["component"] for r in near_copies.near_copies(docs, crowd=crowd).collect()}
    least = {}
    for i in sorted(got):
        least.setdefault(got[i], i)
    assert {i: least[c] for i, c in got.items()} == brute(rows)


def test_stage_keeps_no_two_near_copies(spark, sf_dir):
    rows = list(enumerate(texts(7)))
    stage = dict(corpus_pipeline.STAGES)["simhash"]
    kept = {r["doc_id"] for r in stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir).collect()}
    assert kept == set(brute(rows).values())


def test_keep_one_of_odd_documents(odd, none):
    kept = near_copies.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [-3, 1, 2, 5, 6, 2**40]
    assert kept.where("doc_id is null").count() == 2
    assert near_copies.keep_one(none).collect() == []


def test_columns_of_any_name_are_kept(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, "a", "b", "c", 4), (2, text, "d", "e", "f", 5), (3, "other words", "g", "h", "i", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __mark string, `__ID` string, `x.y` string, component long")
    assert sorted(map(tuple, near_copies.keep_one(docs).collect())) == [rows[0], rows[2]]


def test_the_driver_has_few_tasks_to_keep(spark):
    rows = list(enumerate(texts(5)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spark.sparkContext.setJobGroup("few-tasks", "")
    try:
        kept = {r["doc_id"] for r in near_copies.keep_one(docs).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert kept == set(brute(rows).values())
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("few-tasks") for s in tracker.getJobInfo(j).stageIds}
    ran = [i.numTasks for i in map(tracker.getStageInfo, stages) if i and i.numCompletedTasks]
    assert 0 < sum(ran) < 500  # with 4 partitions; 711 before a shuffle's result was put together where it is made
