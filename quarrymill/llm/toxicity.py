"""Toxicity by a character n-gram linear classifier on naive Bayes features.

Features are the character n-grams (n = 3, 4, 5 over lower-cased text) that a document has, hashed to
2**BITS buckets. Each is scaled by its naive Bayes log-count ratio: how much likelier it is in toxic than in
other training documents. A logistic regression is fitted on the scaled features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import by_text, give_back, held_out
from quarrymill.llm.training import labelled_sample

BITS = 20
ORDERS = (3, 4, 5)
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B))


@dataclass
class ToxicityModel:
    """weights: what the presence of a bucket adds to the log-odds; bias: the log-odds without any."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        row, bucket = buckets(texts, keep=self.weights != 0)
        out = self.bias + np.bincount(row, weights=self.weights[bucket], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def buckets(texts: list[str], keep: np.ndarray | None = None, chars: int = 300_000) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the n-grams of each text, each bucket once for a text. keep: only buckets that it marks.

    Some `chars` characters are worked on at once; a longer text marks what it has in one bit set, piece by piece.
    """
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (size == 0 or size + len(texts[end]) <= chars):
            size += len(texts[end]) + 8
            end += 1
        row, bucket = _of_long(texts[start], keep, chars) if size > chars + 8 else _of_several(texts[start:end], keep)
        rows.append(row + start)
        found.append(bucket)
        start = end
    return np.concatenate(rows), np.concatenate(found)


def _of_several(texts: list[str], keep: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    lowered = [f"  {t.lower()}  " for t in texts]
    row = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) for t in lowered])
    found = [np.zeros(0, np.int64)]
    for n, b in _hashed("".join(lowered)):
        at = row[: len(b)]
        ok = at == row[n - 1 :]
        if keep is not None:
            ok &= keep[b]
        found.append((at[ok] << BITS) | b[ok].astype(np.int64))
    pairs = np.unique(np.concatenate(found))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _of_long(text: str, keep: np.ndarray | None, chars: int) -> tuple[np.ndarray, np.ndarray]:
    lowered = f"  {text.lower()}  "
    has = np.zeros(1 << BITS, bool)
    for low in range(0, len(lowered), chars):
        # the next piece's first characters complete the n-grams that begin in this one
        for _, b in _hashed(lowered[low : low + chars + max(ORDERS) - 1]):
            has[b] = True
    bucket = np.flatnonzero(has if keep is None else has & keep)
    return np.zeros(len(bucket), np.int64), bucket


def _hashed(text: str) -> Iterator[tuple[int, np.ndarray]]:
    """(n, bucket of the n-gram at each place) of each order that the text is long enough for."""
    flat = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    h = flat * _MIX[0]
    for n in range(2, min(max(ORDERS), len(flat)) + 1):
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * _MIX[1] + flat[n - 1 :] * _MIX[0]
        if n in ORDERS:
            yield n, (h ^ (h >> np.uint32(13))) >> np.uint32(32 - BITS)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 4000, max_chars: int = 24_000_000, min_z: float = 5.0, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """A model from labelled training rows that aren't held out.

    per_class and max_chars bound the sample (see `training.labelled_sample`). min_z: a bucket is used if the
    difference of its shares in the two classes is at least so many standard errors. With labels of one class
    only, every score is near that class; without labels it is 0.5.
    """
    sample = labelled_sample(docs, labels, label, per_class, max_chars, id_col, text_col)
    size = 1 << BITS
    y = sample["y"].to_numpy()
    n1, n0 = int(y.sum()), int((1 - y).sum())
    bias0 = float(np.log((n1 + 0.5) / (n0 + 0.5)))
    if not n1 or not n0:
        return ToxicityModel(np.zeros(size, np.float32), bias0)
    texts, step = sample["text"].tolist(), 200
    count = [np.zeros(size), np.zeros(size)]
    for i in range(0, len(texts), step):
        row, bucket = buckets(texts[i : i + step])
        toxic = y[i : i + step][row] == 1
        count[1] += np.bincount(bucket[toxic], minlength=size)
        count[0] += np.bincount(bucket[~toxic], minlength=size)
    ratio = log_count_ratio(count[1], count[0])
    s1, s0 = count[1] / n1, count[0] / n0
    mean = (count[1] + count[0]) / (n1 + n0)
    z = (s1 - s0) / np.sqrt(np.maximum(mean * (1 - mean), 1e-12) * (1 / n1 + 1 / n0))
    used = np.abs(z) >= min_z
    if not used.any():
        return ToxicityModel(np.zeros(size, np.float32), bias0)
    place = np.cumsum(used) - 1
    rows, cols = [], []
    for i in range(0, len(texts), step):
        row, bucket = buckets(texts[i : i + step], keep=used)
        rows.append(row + i)
        cols.append(place[bucket])
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    n, ratio = len(texts), ratio[used]
    del sample, texts, count, s1, s0, mean, z, place
    give_back()
    weight, bias = _logistic(rows, cols, ratio, y.astype(float), n)
    out = np.zeros(size, np.float32)
    out[used] = weight * ratio
    del rows, cols
    give_back()
    # back from the balanced sample to the true share of the classes is not wanted here: the threshold is 0.5 on equal odds
    return ToxicityModel(out, bias)


def log_count_ratio(toxic: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Naive Bayes: log of the ratio of the smoothed, normalised counts of each bucket in the two classes."""
    p, q = toxic + 1, other + 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def _logistic(rows: np.ndarray, cols: np.ndarray, scale: np.ndarray, y: np.ndarray, n: int, steps: int = 300, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights of the scaled features and the bias, by Adam on the whole (class-balanced, penalised) likelihood."""
    d = len(scale)
    value = scale[cols]
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, b = np.zeros(d), 0.0
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for t in range(1, steps + 1):
        out = np.bincount(rows, weights=value * w[cols], minlength=n) + b
        e = share * (1 / (1 + np.exp(-np.clip(out, -40, 40))) - y)
        g = np.append(np.bincount(cols, weights=value * e[rows], minlength=d) + penalty * w, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def score(text: Column, model: ToxicityModel) -> Column:
    """The score of a text from 0 to 1; null counts as empty."""

    return by_text(lambda part: model.scores([t or "" for t in part]), "double")(text)


def score_documents(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text, row by row.

    Null and empty texts get the score of a text without n-grams of the model. Repeated rows give repeated
    results, an empty table an empty one; a null id is held out, as crc32('') is 0. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), score(F.col(text_col), model).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose score is below the threshold. A model without weights, as one without labels of both classes, rejects none."""
    if not model.weights.any():
        return docs
    return docs.where(score(F.col(text_col), model) < threshold)
