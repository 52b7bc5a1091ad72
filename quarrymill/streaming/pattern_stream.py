"""Detection logs folded into reports as they arrive.

Lines are keyed by their log. The state of a log has the run that it is in, what each pattern has come to since it was
started, and lines that came before their turn: lines have numbers, so they are taken in their order however they are
split into files and batches. After every batch the reports that it changed are written; state that has been idle goes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarrymill.streaming.event_fold import latest, write_updates

LINE = "log string, seq bigint, event string, run_id string, pattern string, file string, files_analyzed bigint, evidence_found bigint, detected boolean"
REPORT = "log string, run string, pattern string, files array<string>, n_files int, files_analyzed bigint, evidence_found bigint, detected boolean, ended boolean, version bigint"
#: next: the number of the line whose turn it is; waiting: later lines by number; reports: by run and pattern. The last two as JSON.
_STATE = "next bigint, run string, waiting string, reports string"
_VERDICTS = ("pattern_analysis_end", "pattern_analysis_complete", "pattern_verdict")
_FIELDS = ("event", "run_id", "pattern", "file", "files_analyzed", "evidence_found", "detected")


def _take(line: dict, run: str | None, reports: dict[str, dict]) -> tuple[str | None, str | None]:
    """The run after a line, and the key of the report that it changes, if any."""
    event, pattern = line["event"], line["pattern"]
    if event == "session_start" and line["run_id"] is not None:
        return line["run_id"], None
    if run is None or pattern is None:
        return run, None
    key = json.dumps([run, pattern])
    if event == "pattern_analysis_start":
        reports.setdefault(key, {"files": [], "analyzed": 0, "evidence": 0, "detected": False, "ended": False})
        return run, key
    report = reports.get(key)
    if report is None:
        return run, None  # not started
    if event == "file_scored" and line["file"] is not None and line["file"] not in report["files"]:
        report["files"] = sorted([*report["files"], line["file"]])
    elif event == "investigation_phase_complete":
        report["analyzed"], report["evidence"] = line["files_analyzed"] or 0, line["evidence_found"] or 0
    elif event in _VERDICTS and line["detected"] is not None:
        report["detected"], report["ended"] = line["detected"], True
    return run, key


def reports(lines: DataFrame, idle_hours: float = 24) -> DataFrame:
    """Reports (see `REPORT`) of a stream of lines (see `LINE`) as they change; version grows with every line of a log.

    seq: the number of a line in its log, from 0. A line that comes before its turn waits; one that comes again is left out.
    A log that gets no line for `idle_hours` is closed by the next batch: what waits is taken in order, gaps or not, and its
    state goes. Time is that of arrival, so no line is late; as event time it asks for no batches of its own while nothing comes.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turn, run, waiting, kept = state.get if state.exists else (0, None, "{}", "{}")
        waiting, kept, changed = {int(k): v for k, v in json.loads(waiting).items()}, json.loads(kept), {}

        def take(number: int) -> None:
            nonlocal run
            run, report = _take(waiting.pop(number), run, kept)
            if report is not None:
                changed[report] = number

        if state.hasTimedOut:
            for number in sorted(waiting):
                take(number)
            state.remove()
        else:
            now = pd.Timestamp(0)
            for part in parts:
                now = max(now, part["arrived"].max())
                part = part.astype(object).where(part.notna(), None)
                for seq, *values in zip(part["seq"], *(part[f] for f in _FIELDS), strict=True):
                    if seq is not None and int(seq) >= turn:
                        line = dict(zip(_FIELDS, values, strict=True))
                        line |= {f: None if line[f] is None else int(line[f]) for f in ("files_analyzed", "evidence_found")}
                        waiting[int(seq)] = line | {"detected": None if line["detected"] is None else bool(line["detected"])}
            while turn in waiting:
                take(turn)
                turn += 1
            state.update((turn, run, json.dumps(waiting), json.dumps(kept)))
            state.setTimeoutTimestamp(int(now.timestamp() * 1000 + idle_hours * 3_600_000))
        rows = [(key[0], *json.loads(k), r["files"], len(r["files"]), r["analyzed"], r["evidence"], r["detected"], r["ended"], n) for k, n in changed.items() for r in [kept[k]]]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in REPORT.split(", ")])

    timed = lines.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", "0 seconds")
    return timed.groupBy("log").applyInPandasWithState(fold, REPORT, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def stream_reports(spark: SparkSession, path: str, out: str, checkpoint: str, files: int = 1) -> DataFrame:
    """The reports of logs in a folder of Parquet files (see `LINE`), read as a stream until what is there has been read and written to `out`.

    Called again with the same checkpoint it goes on with files that are new.
    """
    stream = spark.readStream.schema(LINE).option("maxFilesPerTrigger", files).parquet(path)
    write_updates(reports(stream), out, checkpoint)
    return latest(spark, out, ["log", "run", "pattern"], ["version"])
