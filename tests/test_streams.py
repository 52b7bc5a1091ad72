"""Detection logs as a stream, against the fold of the whole log."""

import random

import pytest
from pyspark.sql import functions as F

from quarrymill.streaming import event_fold, pattern_stream

KINDS = ["file_scored", "file_scored", "pattern_analysis_start", "investigation_phase_complete", "pattern_analysis_end", "pattern_verdict", "error", "session_start"]


def lines(seed, n=300):
    draw = random.Random(seed)
    upto, out = {}, []
    for _ in range(n):
        log = f"l{draw.randrange(3)}"
        seq = upto[log] = upto.get(log, -1) + 1
        event = draw.choice(KINDS)
        out.append((log, seq, event, draw.choice([f"{log}r{draw.randrange(3)}", None]) if event == "session_start" else None, draw.choice(["p", "q", None]), draw.choice(["a", "b", "c", "d", None]), draw.choice([None, 1, 2]), draw.choice([None, 3]), draw.choice([None, True, False])))
    return out


def whole(spark, rows):
    log = spark.createDataFrame(rows, pattern_stream.LINE).withColumnRenamed("log", "file_path")
    return sorted(map(str, event_fold.pattern_reports(event_fold.with_run(log)).collect()))


def streamed(df):
    return sorted(map(str, df.select("run", "pattern", "files", "n_files", "files_analyzed", "evidence_found", "detected").collect()))


def deliver(spark, rows, path, parts, seed):
    """The lines in files of no order, some of them twice."""
    draw = random.Random(seed)
    rows = rows + draw.sample(rows, min(len(rows), 10))
    draw.shuffle(rows)
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], pattern_stream.LINE).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("parts", [1, 4])
def test_reports_do_not_depend_on_how_lines_arrive(spark, tmp_path, parts):
    rows = lines(parts)
    deliver(spark, rows, str(tmp_path / "in"), parts, 1)
    got = pattern_stream.stream_reports(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert streamed(got) == whole(spark, rows)


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    rows = lines(7)
    where = [str(tmp_path / x) for x in ("in", "out", "state")]
    deliver(spark, rows[:150], where[0], 2, 1)
    assert streamed(pattern_stream.stream_reports(spark, *where)) == whole(spark, rows[:150])
    deliver(spark, rows[150:], where[0], 2, 2)
    assert streamed(pattern_stream.stream_reports(spark, *where)) == whole(spark, rows)


def test_a_line_waits_for_its_turn(spark, tmp_path):
    where = [str(tmp_path / x) for x in ("in", "out", "state")]
    rows = [("l", 0, "session_start", "r", None, None, None, None, None), ("l", 1, "pattern_analysis_start", None, "p", None, None, None, None), ("l", 2, "file_scored", None, "p", "a", None, None, None), ("l", 3, "pattern_analysis_end", None, "p", None, None, None, True)]
    deliver(spark, [rows[0], rows[1], rows[3]], where[0], 1, 1)
    first = pattern_stream.stream_reports(spark, *where).first()
    assert (first["n_files"], first["detected"], first["ended"]) == (0, False, False)
    deliver(spark, [rows[2]], where[0], 1, 1)
    last = pattern_stream.stream_reports(spark, *where).first()
    assert (last["files"], last["detected"], last["ended"], last["version"]) == (["a"], True, True, 3)


def test_updates_are_written_out_and_not_to_the_driver(spark, tmp_path):
    spark.range(10).select((F.col("id") % 3).alias("user_id"), F.col("id").alias("event_id"), F.lit("error").alias("event_type"), F.lit(1.0).alias("value"), F.current_timestamp().alias("ts")).repartition(3).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    got = event_fold.stream_user_fold(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "state"))
    assert {r["user_id"]: r["errors"] for r in got.collect()} == {0: 4, 1: 3, 2: 3}
    assert len(list((tmp_path / "out").glob("batch=*"))) == 3
