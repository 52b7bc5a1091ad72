"""Secrets by grammar inference.

Base rules find assignments of credentials, access keys and long hexadecimal strings. The strings they find are
labelled credentials: a bounded sample of each kind is turned into a prefix tree whose statistically compatible
states are merged into a probabilistic automaton (see `automata`). Two more are inferred from samples of other tokens, with
digits and without: the backgrounds. Every candidate token of every text is then scored by how much likelier its
format is under a credential automaton than under the likelier background, and added if that is enough.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.automata import Automaton, infer
from quarrymill.llm.common import by_text, slices, texts_of
from quarrymill.llm.spans import Span, covered, digest, joined, ordered, outside, replaced
from quarrymill.sources.tables import cut

KINDS = ("assign", "access", "hex")

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_DIGIT = re.compile(r"[0-9]")
#: Candidates: whole tokens of credential characters, dots within and '=' at the end included, as long as the shortest
#: credential at least. What is on the left of ':' or '=' is a token of its own. Names and hosts of addresses aren't tokens.
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_@-])(?<![A-Za-z0-9+/_@-]\.)[A-Za-z0-9+/_-]++(?:\.[A-Za-z0-9+/_-]++)*+(?:={1,2}+(?![A-Za-z0-9+/_=-]))?+(?!@)")
LEAST = 8
#: Tokens that samples are drawn from are no longer than this; what is scored has no limit.
SAMPLED = 256
_WORDS = re.compile(r"(?ai:passw|secret|token|api_?key)")


def base_spans(text: str) -> list[tuple[Span, str]]:
    """(span, the credential in it) of the base rules, leftmost and non-overlapping for each kind."""
    found = []
    if ("=" in text or ":" in text) and _WORDS.search(text):
        found += [(("assign", m.start(), m.end()), m.group(2)) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        found += [(("access", m.start(), m.end()), m.group()) for m in _ACCESS.finditer(text) if len(m.group()) >= 16]
    found += [(("hex", m.start(), m.end()), m.group()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0][1], KINDS.index(x[0][0]), x[0][2]))


def candidates(text: str, base: list[Span]) -> list[tuple[int, int, str]]:
    """(start, end, token) of what may be a credential outside the base spans."""
    found = [("", m.start(), m.end()) for m in _TOKEN.finditer(text) if m.end() - m.start() >= LEAST]
    return [(a, b, text[a:b]) for _, a, b in outside(found, covered(base))]


@dataclass
class SecretModel:
    """One automaton for each kind that has a sample, the backgrounds', and the gain in nats for each symbol that is needed."""

    kinds: dict[str, Automaton]
    backgrounds: list[Automaton]
    gain: dict[str, float]
    memo: dict[str, str] = field(default_factory=dict)

    def kind_of(self, token: str) -> str:
        """The kind whose format the token has, or ''."""
        if token in self.memo:
            return self.memo[token]
        other = max(b.log_likelihood(token) for b in self.backgrounds)
        gains = {k: (a.log_likelihood(token) - other) / (len(token) + 1) for k, a in self.kinds.items()}
        best = max(gains, key=gains.get, default="")
        kind = best if best and gains[best] >= self.gain[best] else ""
        if len(token) <= SAMPLED:
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[token] = kind
        return kind

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """(base spans, all spans) of a text."""
        base = [s for s, _ in base_spans(text)]
        more = [(kind, a, b) for a, b, token in candidates(text, base) if (kind := self.kind_of(token))]
        return base, ordered([*base, *more], KINDS)


def samples(docs: DataFrame, per_kind: int, text_col: str = "text") -> dict[str, list[str]]:
    """At most `per_kind` distinct credentials of each kind, and as many other tokens with digits ('other') and without ('plain'), the least by hash.

    Each task keeps the least of its own, so no more than `per_kind` a kind and task are shuffled, and the driver
    gets that many a kind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        least: dict[str, dict[str, int]] = {k: {} for k in (*KINDS, "other", "plain")}

        def offer(kind: str, token: str) -> None:
            mine = least[kind]
            mine[token] = xxhash.xxh64_intdigest(token.encode("utf-8"), 7) >> 1
            if len(mine) >= 4 * per_kind:
                least[kind] = dict(sorted(mine.items(), key=lambda x: (x[1], x[0]))[:per_kind])

        for batch in slices(batches):
            for text in texts_of(batch):
                found = base_spans(text)
                for (kind, _, _), token in found:
                    if len(token) <= SAMPLED:
                        offer(kind, token)
                for _, _, token in candidates(text, [s for s, _ in found]):
                    if len(token) <= SAMPLED:
                        offer("other" if _DIGIT.search(token) else "plain", token)
        rows = [(k, t, h) for k, mine in least.items() for t, h in sorted(mine.items(), key=lambda x: (x[1], x[0]))[:per_kind]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["kind", "token", "h"])

    found = cut(docs.select(F.col(text_col).alias("text")).mapInArrow(run, "kind string, token string, h bigint"))
    out = {}
    for kind in (*KINDS, "other", "plain"):
        rows = found.where(F.col("kind") == kind).groupBy("token").agg(F.min("h").alias("h")).orderBy("h", "token").limit(per_kind).collect()
        out[kind] = [r["token"] for r in rows]
    return out


def cross_scored(strings: list[str], alpha: float, folds: int = 4) -> list[float]:
    """For each symbol the log-likelihood of each string by the automaton of the others' folds; alone, by its own."""
    folds = min(folds, len(strings)) if len(strings) >= 4 * folds else len(strings)
    parts = [[t for j, t in enumerate(strings) if j % folds != i] or strings for i in range(folds)]
    automata = [infer(p, alpha) for p in parts]
    return [automata[j % folds].log_likelihood(t) / (len(t) + 1) for j, t in enumerate(strings)]


def fit(docs: DataFrame, per_kind: int = 400, alpha: float = 0.01, margin: float = 0.35, text_col: str = "text") -> SecretModel:
    """Automata from the labelled credentials of the corpus, however few of a kind there are.

    per_kind bounds the sample of each kind; a kind without any credential has no automaton. The gain that a candidate
    needs is what all but 2 % of the kind's credentials reach under automata that were inferred without them, `margin` at
    least. Of few credentials the automaton is a general one, since states of few strings are compatible: then they
    reach little themselves, and what is asked of others is `margin` and a format as likely as theirs.
    """
    sample = samples(docs, per_kind, text_col)
    kinds = {k: infer(sample[k], alpha) for k in KINDS if sample[k]}
    scores = {k: cross_scored(sample[k], alpha) for k in kinds}
    typical = {k: float(np.quantile(x, 0.02)) for k, x in scores.items()}
    backgrounds = [infer(purified(sample[k][: per_kind * 3 // 4], kinds, typical, alpha), alpha) for k in ("other", "plain")]
    gain = {}
    for kind in kinds:
        reached = [x - max(b.log_likelihood(t) for b in backgrounds) / (len(t) + 1) for x, t in zip(scores[kind], sample[kind], strict=True)]
        gain[kind] = max(margin, float(np.quantile(reached, 0.02)))
    return SecretModel(kinds, backgrounds, gain)


def purified(tokens: list[str], kinds: dict[str, Automaton], typical: dict[str, float], alpha: float, rounds: int = 5) -> list[str]:
    """The tokens of a background sample without those that credentials outside the base rules put there.

    Each half of the sample is scored by the automaton of the other half. A token goes if it is likelier under the
    automaton of a kind of credentials, and as likely for each symbol as credentials of that kind are (all but 2 %), until
    none does. A format that makes up a share of the background has that share of its likelihood there, so it is found as
    long as the share is below 1.
    """

    def credential(token: str, background: Automaton) -> bool:
        other = background.log_likelihood(token)
        return any((x := a.log_likelihood(token)) > other and x >= typical[k] * (len(token) + 1) for k, a in kinds.items())

    for _ in range(rounds):
        halves = [infer(tokens[i::2], alpha) for i in (0, 1)]
        kept = [t for i, t in enumerate(tokens) if not credential(t, halves[1 - i % 2])]
        if len(kept) == len(tokens):
            break
        tokens = kept
    return tokens


def find(docs: DataFrame, model: SecretModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex (spans of the base rules), base_sha256 and spans (all) of every whole text.

    Null and empty texts have none. Repeated rows give repeated results, an empty table an empty one. Other
    columns are not read.
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


def redacted(text: Column, model: SecretModel) -> Column:
    """The text with every span replaced by its kind in brackets; null stays null."""

    return by_text(lambda part: [None if t is None else replaced(t, model.spans(t)[1]) for t in part], "string")(text)
