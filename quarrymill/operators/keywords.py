"""Very many keywords in texts, in one pass over each text.

The declared keywords become one automaton (Aho and Corasick), made once on the driver and sent to the workers; a text is
read once, whatever their number. For a few keywords `relevance.keyword_scan` stays within the JVM and gives the same rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.functions import text as T
from quarrymill.operators.relevance import line_weight


class Keywords(NamedTuple):
    """automaton: folded keyword -> its number; spelled: number -> (pattern, kind, keyword as declared)s; blank: number of the empty keyword."""

    automaton: ahocorasick.Automaton
    spelled: list[list[tuple[str, str, str]]]
    sizes: list[int]
    blank: int | None


def compiled(keywords: DataFrame, limit: int = 1_000_000) -> Keywords:
    """The automaton of declared keywords (pattern, keyword, kind 'pos' or 'anti'); more than `limit` of them are refused."""
    rows = keywords.select("pattern", "kind", "keyword", F.lower("keyword").alias("folded")).where("keyword IS NOT NULL").distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} keywords")
    spelled: dict[str, list[tuple[str, str, str]]] = defaultdict(list)
    for r in rows:
        spelled[r["folded"]].append((r["pattern"], r["kind"], r["keyword"]))
    automaton = ahocorasick.Automaton()
    for i, word in enumerate(spelled):
        if word:
            automaton.add_word(word, i)
    if len(automaton):
        automaton.make_automaton()
    return Keywords(automaton, list(spelled.values()), [len(w) for w in spelled], next((i for i, w in enumerate(spelled) if not w), None))


def occurrences(text: str, keys: Keywords) -> dict[int, int]:
    """How often each keyword is in a folded text, occurrences of one not overlapping, from the left."""
    found: dict[int, int] = {} if keys.blank is None else {keys.blank: 0}
    upto: dict[int, int] = {}
    for end, i in keys.automaton.iter(text) if len(keys.automaton) else ():
        start = end + 1 - keys.sizes[i]
        if start >= upto.get(i, 0):
            found[i] = found.get(i, 0) + 1
            upto[i] = end + 1
    return found


def scored(text: str, lines: list[str], weights: list[float], keys: Keywords) -> Iterator[tuple[str, list[str], list[str], float]]:
    """(pattern, keywords, anti-keywords, score) of each pattern that a folded text has a keyword of; see `relevance.keyword_score`."""
    found = occurrences(text, keys)
    if not found:
        return
    best: dict[int, float] = {}
    for line, weight in zip(lines, weights, strict=True):
        for i in occurrences(line, keys):
            best[i] = max(best.get(i, 0.0), weight)
    of: dict[str, dict[str, list[tuple[str, int]]]] = defaultdict(lambda: {"pos": [], "anti": []})
    for i in found:
        for pattern, kind, keyword in keys.spelled[i]:
            of[pattern][kind].append((keyword, i))
    for pattern, kinds in of.items():
        good, bad = sorted(kinds["pos"]), sorted(kinds["anti"])
        plus = minus = 0.0
        for _, i in good:
            plus += 0.15 + best.get(i, 0.0) + min(found[i] * 0.03, 0.20)
        for _, i in bad:
            minus += min(found[i] * 0.08, 0.30)
        score = min(max(plus - minus, 0.0) / (len(good) * 0.8), 1.0) if good else 0.0
        yield pattern, [k for k, _ in good], [k for k, _ in bad], score


def scan(files: DataFrame, keywords: DataFrame, path: str = "path", text: str = "text", limit: int = 1_000_000) -> DataFrame:
    """pattern, path, keywords, anti_keywords, keyword_score of files that have any keyword of a pattern: the rows of `relevance.keyword_scan`.

    keywords: pattern, keyword, kind. An empty keyword is in every text, a null one in none; a null text is empty. Texts are
    folded and cut into lines by Spark, and no row is shuffled.
    """
    keys = files.sparkSession.sparkContext.broadcast(compiled(keywords, limit))
    names = ["pattern", path, "keywords", "anti_keywords", "keyword_score"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for start in range(0, len(part), 256):
                some = part.iloc[start : start + 256]
                rows = [(p, file, good, bad, score) for file, t, ls, ws in zip(some["p"], some["t"], some["ls"], some["ws"], strict=True) for p, good, bad, score in scored(t, list(ls), list(ws), keys.value)]
                yield pd.DataFrame(rows, columns=names)

    folded = files.select(F.col(path).alias("p"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("t")).withColumn("ls", T.lines(F.col("t"), 200))
    lined = folded.withColumn("ws", F.transform("ls", line_weight))
    kind = files.schema[path].dataType.simpleString()
    return lined.mapInPandas(run, f"pattern string, `{path}` {kind}, keywords array<string>, anti_keywords array<string>, keyword_score double")
