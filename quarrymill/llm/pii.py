"""Personal data by weak supervision.

Base rules find e-mail addresses, IP addresses, card and phone numbers. Beyond them, looser patterns propose
candidates: obfuscated addresses, numbers in other formats, numbers that a rule dropped. Labelers of three sorts -
regular expressions, gazetteers, context - vote on each candidate or abstain. The votes of all candidates of the
corpus are counted by pattern; expectation-maximisation over these counts estimates how reliable each labeler is
and how likely each pattern is personal data. A logistic classifier is then trained on these likelihoods and decides
which candidates are added. It sees more than the votes: the shape of the span and the words around it. It learns each
candidate once with its votes and once without, and none from candidates on which all labelers abstain, so that shape
and words carry weight of their own and decide where there are no votes. Spans of the base rules always stay.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import by_text, slices, texts_of
from quarrymill.llm.spans import Span, covered, digest, joined, ordered, outside, replaced
from quarrymill.sources.tables import cut

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Possessive: a run of digits is never entered in its middle, so the time is linear in the text.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    found, after, at = [], 0, text.find("@")
    while at >= 0:
        head = text[after:at]
        start = at - (len(head) - len(head.rstrip(_LOCAL)))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append(("email", start, domain.end()))
        # a local part can't go back over an @, and a match that ended may not be entered again
        after = domain.end() if domain else at + 1
        at = text.find("@", after)
    return found


def base_spans(text: str) -> list[Span]:
    """Spans of the base rules, leftmost and non-overlapping for each kind."""
    found = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in m.groups()):
                found.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() and c.isascii() for c in m.group()) <= 15:
                    found.append(("phone", m.start(), m.end()))
    return ordered(found, KINDS)


# Candidates beyond the base rules: (kind, pattern). All are anchored at a separator, so none enters a token in its middle.
_LOOSE = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\s?[\[({<]\s?(?:at|AT|arroba|@)\s?[\])}>]\s?[A-Za-z0-9-]{1,63}(?:\s?[\[({<]?\s?(?:\.|dot|DOT|punto|punkt)\s?[\])}>]?\s?[A-Za-z0-9-]{2,63}){1,4}")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("card", re.compile(r"(?<![0-9.\-])[0-9]{4}(?:[ .\-/]?[0-9]{4}){2}[ .\-/]?[0-9]{1,7}(?![0-9.\-])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z.+(\-])(?:00[1-9][0-9]{0,2}[ .\-]?)?\(?[0-9]{2,4}\)?[ .\-/]{1,2}[0-9]{3}[ .\-/][0-9]{3,4}(?![0-9.\-])")),
)
#: Gazetteers, all lower case.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io de fr es it uk us eu ch at nl be pl pt ru br mx ca au jp cn in".split())
MAIL_WORDS = frozenset("mail email e-mail correo courriel contact contacto kontakt write reply escriba".split())
PHONE_WORDS = frozenset("phone tel telephone call mobile cell fax telefon telefono teléfono téléphone appel handy ruf".split())
CARD_WORDS = frozenset("card visa mastercard amex credit debit karte tarjeta carte account konto cuenta compte payment".split())
IP_WORDS = frozenset("ip host server address login client addr adresse servidor".split())
WORDS = {"email": MAIL_WORDS, "phone": PHONE_WORDS, "card": CARD_WORDS, "ip": IP_WORDS}
AGAINST = frozenset("page isbn issn order invoice version ref no number nr version chapter section id part lot seite página numéro".split())
#: First digits of payment cards.
CARD_HEADS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "36", "38", "35")
_BEFORE = re.compile(r"[\w-]+")


def candidates(text: str, base: list[Span]) -> list[tuple[Span, tuple[int, ...], tuple[int, ...]]]:
    """(span, votes, columns) of what looser patterns find outside the base spans. A vote is 1, -1 or 0 (abstains); columns: see `_columns`."""
    if not _DIGIT.search(text) and "(" not in text and "[" not in text and "{" not in text and "<" not in text:
        return []
    out, taken = [], list(base)
    for kind, pattern in _LOOSE:
        mine = outside(((kind, m.start(), m.end()) for m in pattern.finditer(text)), covered(taken))
        taken += mine
        out += [(span, *_judge(kind, text, span[1], span[2])) for span in mine]
    return out


def _judge(kind: str, text: str, a: int, b: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    body = text[a:b]
    digits = "".join(c for c in body if c.isdigit() and c.isascii())
    before = [w.lower() for w in _BEFORE.findall(text[max(0, a - 48) : a])[-4:]]
    glued = (a > 0 and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum())
    near = text[max(0, a - 12) : a] + text[b : b + 12]
    # regular expressions: is the format whole?
    if kind == "card":
        form = 1 if luhn(digits) and 13 <= len(digits) <= 19 else -1
    elif kind == "phone":
        form = 1 if 9 <= len(digits) <= 15 else -1 if len(digits) < 7 else 0
    elif kind == "email":
        form = 1 if re.search(r"[\[({<]", body) else 0
    else:
        form = 1
    # gazetteers
    if kind == "email":
        gazetteer = 1 if re.split(r"[^A-Za-z0-9]+", body.rstrip(")]}>"))[-1].lower() in TOP_DOMAINS else -1
    elif kind == "card":
        gazetteer = 1 if digits.startswith(CARD_HEADS) else -1
    elif kind == "phone":
        gazetteer = -1 if digits[:1] == "0" and digits[1:2] == "0" and len(digits) < 11 else 0
    else:
        gazetteer = 0
    # context: words before, what touches the span, digits around it
    word = 1 if WORDS[kind].intersection(before) else 0
    against = -1 if AGAINST.intersection(before) else 0
    crowd = -1 if sum(c.isdigit() for c in near) >= 6 else 0
    edge = -1 if glued else 0
    same = -1 if digits and len(set(digits)) <= 2 else 0
    votes = (form, gazetteer, word, against, crowd, edge, same)
    after = _BEFORE.search(text, b, min(len(text), b + 24))
    return votes, _columns(kind, body, len(digits), before[-3:], after.group().lower() if after else "", votes)


N_VOTES = 7
_DIGITS, _LETTERS = re.compile(r"[0-9]"), re.compile(r"[^\W\d_]+")
#: Where the columns of a sort begin; shapes and words are hashed into what lies between.
_SIZE, _BRACKETS, _SHAPE, _PIECE, _WORD, _NEXT, _VOTE = 4, 10, 11, 267, 331, 843, 971
WIDTH = _VOTE + 2 * N_VOTES


def _hashed(low: int, high: int, *words: str) -> int:
    return low + zlib.crc32(" ".join(words).encode("utf-8", "replace")) % (high - low)


def _columns(kind: str, body: str, digits: int, before: list[str], after: str, votes: tuple[int, ...]) -> tuple[int, ...]:
    """The classifier's columns that are 1 for a candidate, ascending.

    Kind, length class, brackets, shape (digits as 9, runs of letters as a) as a whole and its first and last piece, the
    words before and the one after (digits as 9), and each vote as for, against.
    """
    shape = _DIGITS.sub("9", _LETTERS.sub("a", body))
    pieces = re.findall("[9a]+", shape) or [""]
    out = {KINDS.index(kind), _SIZE + min(digits, 20) // 4, _hashed(_SHAPE, _PIECE, kind, shape), _hashed(_PIECE, _WORD, kind, "first", pieces[0]), _hashed(_PIECE, _WORD, kind, "last", pieces[-1])}
    if "(" in body or ")" in body:
        out.add(_BRACKETS)
    out.update(_hashed(_WORD, _NEXT, kind, _DIGITS.sub("9", w)) for w in before)
    out.add(_hashed(_NEXT, _VOTE, kind, _DIGITS.sub("9", after)))
    out.update(_VOTE + 2 * j + (v < 0) for j, v in enumerate(votes) if v)
    return tuple(sorted(out))


@dataclass
class PiiModel:
    """reliability: share of right votes of each labeler; weights (of columns), bias: the span classifier."""

    reliability: list[float]
    prior: float
    weights: list[float]
    bias: float = 0.0
    threshold: float = 0.5

    def likelihood(self, columns: tuple[int, ...]) -> float:
        odds = self.bias + math.fsum(map(self.weights.__getitem__, columns))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """(base spans, all spans) of a text."""
        base = base_spans(text)
        more = [s for s, _, c in candidates(text, base) if self.likelihood(c) >= self.threshold]
        return base, ordered([*base, *more], KINDS)


def candidate_counts(docs: DataFrame, text_col: str = "text", held: int = 50_000) -> DataFrame:
    """How many candidates of the corpus have the same votes and columns: `votes`, `columns`, `n`.

    Each task adds up its own before the shuffle, and hands on what it has whenever that is more than `held` rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[tuple[int, ...], tuple[int, ...]], int] = {}

        def told() -> pa.RecordBatch:
            arrays = [pa.array([list(v) for v, _ in found], pa.list_(pa.int32())), pa.array([list(c) for _, c in found], pa.list_(pa.int32())), pa.array(list(found.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["votes", "columns", "n"])

        for batch in slices(batches):
            for text in texts_of(batch):
                for _, v, c in candidates(text, base_spans(text)):
                    found[v, c] = found.get((v, c), 0) + 1
                    if len(found) > held:
                        yield told()
                        found.clear()
        yield told()

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "votes array<int>, columns array<int>, n bigint")
    return counts.groupBy("votes", "columns").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text_col: str = "text", rounds: int = 50, threshold: float = 0.5, most: int = 10_000) -> PiiModel:
    """Reliabilities, from the votes on all candidates of the corpus, and the span classifier.

    At most 3**7 patterns of votes reach the driver. The classifier is fitted on at most `most` combinations of columns,
    each weighted by how many candidates have it; which ones is decided by a hash, so any layout of the input gives the
    same. Without candidates nothing is learned, and nothing is added to the base spans.
    """
    counts = cut(candidate_counts(docs, text_col))
    rows = sorted((tuple(r["votes"]), r["n"]) for r in counts.groupBy("votes").agg(F.sum("n").alias("n")).collect())
    if not rows:
        return PiiModel([0.5] * N_VOTES, 0.5, [0.0] * WIDTH, bias=-30.0, threshold=threshold)
    votes, n = np.array([v for v, _ in rows], dtype=float), np.array([c for _, c in rows], dtype=float)
    reliability, prior, p = _reliabilities(votes, n, rounds)
    likely = {v: float(q) for (v, _), q in zip(rows, p, strict=True)}
    taught = counts.where(F.exists("votes", lambda v: v != 0)).orderBy(F.xxhash64("columns"), "columns").limit(most).collect()
    weights, bias = _classifier([(tuple(r["columns"]), likely[tuple(r["votes"])], r["n"]) for r in taught])
    return PiiModel(reliability.tolist(), prior, weights, bias, threshold)


def _reliabilities(votes: np.ndarray, n: np.ndarray, rounds: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Reliability of each labeler, the prior, and how likely each pattern of votes is personal data, by expectation-maximisation."""
    # one reliability for each labeler: P(vote agrees with the truth | it votes); a weak prior of 7 in 10 keeps them identified
    reliability, prior, p = np.full(N_VOTES, 0.7), 0.3, np.zeros(len(n))
    for _ in range(rounds):
        odds = np.log(reliability / (1 - reliability))
        p = 1 / (1 + np.exp(-np.clip(votes @ odds + math.log(prior / (1 - prior)), -30, 30)))
        right = np.where(votes > 0, p[:, None], np.where(votes < 0, 1 - p[:, None], 0.0))
        cast = (votes != 0).astype(float)
        # the prior counts as a tenth of the votes, so it matters as much in a large corpus as in a small one
        strength = 0.1 * n.sum() + 10
        reliability = np.clip((n @ right + 0.7 * strength) / (n @ cast + strength), 0.55, 0.99)
        prior = float(np.clip((n @ p + 3) / (n.sum() + 10), 0.05, 0.9))
    return reliability, prior, p


def _classifier(rows: list[tuple[tuple[int, ...], float, int]], steps: int = 300, penalty: float = 1e-4) -> tuple[list[float], float]:
    """Weights and bias of a logistic regression on (columns, likelihood, count), by Adam; each row once with its votes and once without. Without rows nothing is likely."""
    if not rows:
        return [0.0] * WIDTH, -30.0
    every = [(c, p, n) for columns, p, n in rows for c in (columns, tuple(i for i in columns if i < _VOTE))]
    at = np.repeat(np.arange(len(every)), [len(c) for c, _, _ in every])
    column = np.array([i for c, _, _ in every for i in c], dtype=np.int64)
    target, share = np.array([p for _, p, _ in every]), np.array([n for _, _, n in every], dtype=float)
    share /= max(share.sum(), 1.0)
    w, m, v = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)
    for t in range(1, steps + 1):
        odds = np.bincount(at, weights=w[column], minlength=len(every)) + w[-1]
        e = share * (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - target)
        g = np.append(np.bincount(column, weights=e[at], minlength=WIDTH) + penalty * w[:-1], e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:-1].tolist(), float(w[-1])


def find(docs: DataFrame, model: PiiModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (spans of the base rules), base_sha256 and spans (all) of every whole text.

    Null and empty texts have none. Repeated rows give repeated results, an empty table an empty one. Other
    columns are not read. The time is linear in the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [model.spans(t) for t in texts_of(batch)]
            counts = [pa.array([sum(s[0] == kind for s in base) for base, _ in found], pa.int64()) for kind in KINDS]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array([digest(base) for base, _ in found], pa.string()), pa.array([joined(every) for _, every in found], pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, {', '.join(f'n_{k} bigint' for k in KINDS)}, base_sha256 string, spans string"
    return rows.mapInArrow(run, schema)


def redacted(text: Column, model: PiiModel) -> Column:
    """The text with every span replaced by its kind in brackets; null stays null."""

    return by_text(lambda part: [None if t is None else replaced(t, model.spans(t)[1]) for t in part], "string")(text)
