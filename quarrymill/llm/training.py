"""Bounded training samples of labelled documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import held_out
from quarrymill.sources.tables import cut


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int, id_col: str = "doc_id", text_col: str = "text") -> pd.DataFrame:
    """text and y (0 or 1) of at most `per_class` labelled training documents of each class and at most `max_chars` characters.

    Which ones is decided by a hash of the id, so any order or layout of the input gives the same sample. Of an id's texts
    the one of the least hash counts, before anything is gathered, so the driver gets no more rows than the bound says.
    Rows that are held out (see `common.held_out`), unlabelled or of a null id are never in the sample. An id that is
    labelled more than once counts as 1 if at least half of its labels do. A text that doesn't fit the rest of the
    budget is skipped; only if no text of a class fits, its shortest one is taken all the same.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("y"))
    rank = F.xxhash64("doc_id", F.lit(2025))
    ids = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).select("doc_id", "y", rank.alias("r")).orderBy("r", "doc_id").limit(per_class)
        ids = part if ids is None else ids.union(part)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # at most 2 * per_class ids, so broadcast; read once, kept in the shared folder
    found = rows.join(F.broadcast(ids), "doc_id").groupBy("r", "doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    found = cut(found.select("r", "doc_id", "y", F.col("t.text").alias("text"), F.char_length("t.text").alias("n")))
    # the budget of characters is spent in the order of the hash, half of it by each class and then the rest; a text beyond it is left out, never shortened
    sizes = found.select("r", "doc_id", "n", "y").toPandas().sort_values(["r", "doc_id"])
    chosen = _fitting(list(zip(sizes["r"].tolist(), sizes["n"].tolist(), sizes["y"].tolist(), strict=True)), max_chars)
    if not chosen:
        return pd.DataFrame({"text": pd.Series(dtype=str), "y": pd.Series(dtype=int)})
    of = docs.sparkSession.createDataFrame([(r,) for r in chosen], "r long")
    got = found.join(F.broadcast(of), "r").toPandas().sort_values(["r", "doc_id"])
    return got[["text", "y"]].reset_index(drop=True)


def _fitting(texts: list[tuple[int, int, int]], max_chars: int) -> list[int]:
    """The keys of those of the texts (key, characters, class) that the budget takes, in the order given."""
    chosen: set[int] = set()
    left = max_chars
    for y in (0, 1):
        half = max_chars // 2
        for key, n, of in texts:
            if of == y and n <= half:
                chosen.add(key)
                half, left = half - n, left - n
    for key, n, _ in texts:
        if key not in chosen and n <= left:
            chosen.add(key)
            left -= n
    for y in (0, 1):
        own = [(n, i, key) for i, (key, n, of) in enumerate(texts) if of == y]
        if own and not any(key in chosen for _, _, key in own):
            chosen.add(min(own)[2])
    return [key for key, _, _ in texts if key in chosen]
