"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes. Every passage is encoded to a vector of character, byte-pair
and repetition statistics; a gated attention layer weighs the passages,

    a_k = softmax_k( w . ( tanh(V h_k) * sigmoid(U h_k) ) ),   z = sum_k a_k h_k,   score = sigmoid(c . z + b),

and all of it is learned from labels of documents alone (Ilse, Tomczak and Welling, 2018).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import by_text, give_back, held_out
from quarrymill.llm.training import labelled_sample

PASSAGE = 512
_PAIRS = 128
PIECE = 512 * PASSAGE  # bytes whose passages are encoded at once
_BACK = 12  # a word repeats if it equals one of so many before it


def _classes() -> np.ndarray:
    """Byte -> class: each ASCII letter (both cases of it), upper case apart, digits, each ASCII mark, blanks, line ends, others."""
    of = np.full(256, 63, np.int64)
    for b in range(26):
        of[97 + b] = of[65 + b] = b
    of[48:58] = 26
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    of[marks] = 27 + np.arange(len(marks))
    of[[32, 9]], of[[10, 13]] = 59, 60
    of[128:] = 61
    return of


_CLASS = _classes()
_BLANK = np.isin(np.arange(256), [32, 10, 9, 13])
_HASH = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
WIDTH = 64 + _PAIRS + 7


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of all passages, passages of each text). A text has one passage at least; an empty one is zeros.

    Work space is that of PIECE bytes, however long a text is; only the vectors themselves grow with the texts.
    """
    made: list[np.ndarray] = [np.zeros((0, WIDTH), np.float32)]
    bags: list[np.ndarray] = [np.zeros(0, np.int64)]
    for raw in _groups([t.encode("utf-8", "replace") for t in texts]):
        if len(raw[0]) > PIECE:
            vectors = list(_long(raw[0]))
            made += vectors
            bags.append(np.array([sum(map(len, vectors))], np.int64))
        else:
            vectors, sizes = _together(raw)
            made.append(vectors)
            bags.append(sizes)
    return np.concatenate(made), np.concatenate(bags)


def _groups(raw: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in order, in groups of PIECE bytes at most; a longer text is a group of its own."""
    group, size = [], 0
    for r in raw:
        if group and size + len(r) > PIECE:
            yield group
            group, size = [], 0
        group.append(r)
        size += len(r) + PASSAGE
    if group:
        yield group


def _together(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and passages of several texts at once."""
    lengths = np.array([len(r) for r in raw], dtype=np.int64)
    bags = np.maximum(1, -(-lengths // PASSAGE))
    flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
    first = np.concatenate([[0], np.cumsum(bags)[:-1]])
    total = int(bags.sum())
    if not len(flat):
        return np.zeros((total, WIDTH), np.float32), bags
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    doc = np.repeat(np.arange(len(raw)), lengths)
    part = first[doc] + (np.arange(len(flat)) - starts[doc]) // PASSAGE
    # words: runs without blanks; a hash of each, and whether it stood shortly before
    inside = ~_BLANK[flat]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | (doc[1:] != doc[:-1])
    at = np.flatnonzero(begin)
    counts = np.zeros((3, total))
    if len(at):
        place = np.arange(len(flat)) - at[np.maximum(np.cumsum(begin) - 1, 0)]
        code = np.add.reduceat(np.where(inside, _mixed(flat, place), np.uint64(0)), at)
        counts = _repeats(code, doc[at], part[at], total)
    return _vectors(flat, part, total, counts), bags


def _long(raw: bytes) -> Iterator[np.ndarray]:
    """Vectors of one text's passages, PIECE bytes of it at once; they are those that `_together` gives."""
    flat = np.frombuffer(raw, dtype=np.uint8)
    total = -(-len(flat) // PASSAGE)
    counts = np.zeros((3, total), np.int32)
    last = np.zeros(0, np.uint64)
    opened: tuple[np.ndarray, int, int] | None = None  # code, length and passage of a word that the piece's end cuts
    for low in range(0, len(flat), PIECE):
        piece = flat[low : low + PIECE]
        inside = ~_BLANK[piece]
        code, part = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        head = 0
        if opened is not None:
            head = len(piece) if inside.all() else int(np.argmin(inside))
            more = _mixed(piece[:head], opened[1] + np.arange(head)).sum(dtype=np.uint64, keepdims=True)
            opened = (opened[0] + more, opened[1] + head, opened[2])
            if head < len(piece):
                code, part, opened = opened[0], np.array([opened[2]]), None
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        begin[:head] = False
        at = np.flatnonzero(begin)
        if len(at):
            place = np.arange(len(piece)) - at[np.maximum(np.cumsum(begin) - 1, 0)]
            own, of = np.add.reduceat(np.where(inside, _mixed(piece, place), np.uint64(0)), at), (low + at) // PASSAGE
            if inside[-1]:
                opened = (own[-1:], len(piece) - int(at[-1]), int(of[-1]))
                own, of = own[:-1], of[:-1]
            code, part = np.concatenate([code, own]), np.concatenate([part, of])
        last = _tell(last, code, part, counts)
    if opened is not None:
        _tell(last, opened[0], np.array([opened[2]]), counts)
    for low in range(0, len(flat), PIECE):
        piece = flat[low : low + PIECE]
        part = np.arange(len(piece)) // PASSAGE
        from_ = low // PASSAGE
        size = int(part[-1]) + 1
        yield _vectors(piece, part, size, counts[:, from_ : from_ + size])


def _tell(last: np.ndarray, code: np.ndarray, part: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Add the words of a piece, of one text, to its counts; returns the codes that the next words look back to."""
    if not len(code):
        return last
    low, n = int(part[0]), int(part[-1] - part[0]) + 1
    every = np.concatenate([last, code])
    counts[:, low : low + n] += _repeats(every, None, part - low, n, len(last)).astype(counts.dtype)
    return every[-_BACK:]


def _mixed(flat: np.ndarray, place: np.ndarray) -> np.ndarray:
    """What bytes at places within their words add to the words' hashes."""
    return _HASH[flat] * ((np.minimum(place, 62).astype(np.uint64) << np.uint64(1)) + np.uint64(1))


def _repeats(code: np.ndarray, doc: np.ndarray | None, part: np.ndarray, total: int, skip: int = 0) -> np.ndarray:
    """By passage: words, those that equal one of _BACK before them in their text, those that equal the one before.

    doc: the text of each word, None for one text. The first `skip` words are looked back to only; `part` has none for them.
    """
    seen, next_same = np.zeros(len(code), bool), np.zeros(len(code), bool)
    for k in range(1, min(_BACK, len(code) - 1) + 1):
        equal = code[k:] == code[:-k]
        if doc is not None:
            equal &= doc[k:] == doc[:-k]
        seen[k:] |= equal
        if k == 1:
            next_same[1:] = equal
    return np.stack([np.bincount(part, minlength=total), np.bincount(part, weights=seen[skip:], minlength=total), np.bincount(part, weights=next_same[skip:], minlength=total)])


def _vectors(flat: np.ndarray, part: np.ndarray, total: int, counts: np.ndarray) -> np.ndarray:
    """Vectors of passages: part is the passage of each byte, counts what `_repeats` gives."""
    out = np.zeros((total, WIDTH), np.float32)
    size = np.bincount(part, minlength=total).astype(np.float64)
    per = np.maximum(size, 1)
    out[:, :64] = np.bincount(part * 64 + _CLASS[flat], minlength=total * 64).reshape(total, 64) / per[:, None]
    upper = (flat >= 65) & (flat <= 90)
    out[:, 64] = np.bincount(part, weights=upper, minlength=total) / per
    same = part[1:] == part[:-1]
    pair = (flat[:-1].astype(np.uint32) * np.uint32(257) + flat[1:]) * np.uint32(2654435761)
    many = np.bincount(part[1:][same] * 1024 + (pair[same] >> np.uint32(22)).astype(np.int64), minlength=total * 1024).reshape(total, 1024)
    share = many / np.maximum(many.sum(axis=1, keepdims=True), 1)
    out[:, 65] = np.sqrt((share**2).sum(axis=1))
    out[:, 66] = (many > 0).sum(axis=1) / np.minimum(per, 1024)
    out[:, 67] = -(share * np.log(np.maximum(share, 1e-9))).sum(axis=1) / 7
    folded = many.reshape(total, _PAIRS, 1024 // _PAIRS).sum(axis=2)
    out[:, 71:] = np.sqrt(folded / np.maximum(folded.sum(axis=1, keepdims=True), 1))
    words = np.maximum(counts[0], 1)
    out[:, 68], out[:, 69] = counts[1] / words, counts[2] / words
    out[:, 70] = np.minimum(size / words / 20, 3)
    return out


@dataclass
class QualityModel:
    """Weights of the attention layer and of the classifier; mean and scale of the passage vectors."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def logits(self, vectors: np.ndarray, bags: np.ndarray) -> np.ndarray:
        return _forward(self.p, (vectors - self.mean) / self.scale, bags)["logit"]

    def scores(self, texts: list[str]) -> np.ndarray:
        logits = []
        for raw in _groups([t.encode("utf-8", "replace") for t in texts]):
            logits.append(np.array([self._long_logit(raw[0])]) if len(raw[0]) > PIECE else self.logits(*_together(raw)))
        # rounded: sums in another order, with other texts in the batch, may differ in the last digits
        return np.round(1 / (1 + np.exp(-np.clip(np.concatenate([np.zeros(0), *logits]), -40, 40))), 9)

    def _long_logit(self, raw: bytes) -> float:
        """The logit of one text: attention over its pieces, rescaled to the greatest weight so far."""
        top, total, weighted = -np.inf, 0.0, np.zeros(WIDTH)
        for vectors in _long(raw):
            h = (vectors - self.mean) / self.scale
            s, _, _ = _attention(self.p, h)
            now = max(top, float(s.max()))
            e, before = np.exp(s - now), np.exp(top - now)
            total, weighted, top = total * before + e.sum(), weighted * before + e @ h, now
        return float(weighted / total @ self.p["c"] + self.p["b"][0])


def _attention(p: dict[str, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the gated layer gives each passage, and its two factors."""
    t = np.tanh(h @ p["V"])
    g = 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
    return (t * g) @ p["w"], t, g


def _forward(p: dict[str, np.ndarray], h: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
    starts = np.concatenate([[0], np.cumsum(bags)[:-1]])
    bag = np.repeat(np.arange(len(bags)), bags)
    s, t, g = _attention(p, h)
    e = np.exp(s - np.maximum.reduceat(s, starts)[bag])
    a = e / np.add.reduceat(e, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return {"t": t, "g": g, "a": a, "z": z, "bag": bag, "starts": starts, "logit": z @ p["c"] + p["b"][0]}


def _gradients(p: dict[str, np.ndarray], h: np.ndarray, bags: np.ndarray, y: np.ndarray, penalty: float) -> dict[str, np.ndarray]:
    f = _forward(p, h, bags)
    d = (1 / (1 + np.exp(-np.clip(f["logit"], -30, 30))) - y) / len(y)
    dz = d[:, None] * p["c"]
    da = np.einsum("kd,kd->k", dz[f["bag"]], h)
    ds = f["a"] * (da - np.add.reduceat(f["a"] * da, f["starts"])[f["bag"]])
    dtg = ds[:, None] * p["w"]
    return {
        "c": f["z"].T @ d + penalty * p["c"],
        "b": np.array([d.sum()]),
        "w": (f["t"] * f["g"]).T @ ds,
        "V": h.T @ (dtg * f["g"] * (1 - f["t"] ** 2)) + penalty * p["V"],
        "U": h.T @ (dtg * f["t"] * f["g"] * (1 - f["g"])) + penalty * p["U"],
    }


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 2500, max_chars: int = 12_000_000, units: int = 24, epochs: int = 12, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """A model from labelled training rows that aren't held out.

    per_class and max_chars bound the sample (see `training.labelled_sample`): the passages of 12 million characters
    are some 25,000 vectors. With labels of one class only, every score is near that class; without labels it is 0.5.
    """
    sample = labelled_sample(docs, labels, label, per_class, max_chars, id_col, text_col)
    y = sample["y"].to_numpy().astype(float)
    rng = np.random.default_rng(seed)
    p = {"V": rng.normal(0, WIDTH**-0.5, (WIDTH, units)), "U": rng.normal(0, WIDTH**-0.5, (WIDTH, units)), "w": rng.normal(0, units**-0.5, units), "c": np.zeros(WIDTH), "b": np.array([np.log((y.sum() + 0.5) / ((1 - y).sum() + 0.5))])}
    if not len(y) or y.min() == y.max():
        return QualityModel(np.zeros(WIDTH), np.ones(WIDTH), p)
    texts = sample["text"].tolist()
    vectors, bags = encode(texts)
    model = QualityModel(vectors.mean(axis=0), vectors.std(axis=0) + 0.02, p)
    h = ((vectors - model.mean) / model.scale).astype(np.float32)
    starts = np.concatenate([[0], np.cumsum(bags)])
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), 64):
            rows = order[i : i + 64]
            h_rows = np.concatenate([h[starts[r] : starts[r + 1]] for r in rows])
            g = _gradients(p, h_rows, bags[rows], y[rows], 1e-4)
            step += 1
            rate = 0.005 * (1 - epoch / (epochs + 1))
            for k, x in g.items():
                m[k], v[k] = 0.9 * m[k] + 0.1 * x, 0.99 * v[k] + 0.01 * x * x
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    del sample, texts, vectors, h, h_rows
    give_back()
    return model


def score(text: Column, model: QualityModel) -> Column:
    """The score of a text from 0 to 1; null counts as empty."""

    return by_text(lambda part: model.scores([t or "" for t in part]), "double")(text)


def score_documents(docs: DataFrame, model: QualityModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text, row by row.

    Null and empty texts are one passage of zeros. Repeated rows give repeated results, an empty table an empty
    one. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), score(F.col(text_col), model).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose score is at least the threshold. A model without weights, as one without labels of both classes, rejects none."""
    if not model.p["c"].any():
        return docs
    return docs.where(score(F.col(text_col), model) >= threshold)
