"""Token counts by the whole-token shortcut.

Before any text is read, each string of the vocabulary is put through the merges once: it is *whole*
if it is a single pre-token and its merges end in one token. A pre-token that is whole counts 1 without
any merging; only the others are merged, all those of a batch at once. Counts of blank-separated
chunks are remembered in a bounded table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.bpe import Merger, lowest_first
from quarrymill.llm.common import slices, texts_of

#: Fixed value: the pre-token pattern of this kind of vocabulary. White space is the Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_UNSAFE = -(10**12)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary -> the byte.

    Printable bytes of Latin-1 stand for themselves; the others take code points from 256 on, in order.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenCounter:
    #: Chunks remembered; when there are more, all but those of the current batch are forgotten.
    CACHE = 500_000

    def __init__(self, path: str, whole: frozenset[str] | None = None):
        """whole: the strings of the vocabulary that are proved whole; they are proved here if it is None."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        alphabet = byte_alphabet()
        self.base = np.zeros(256, np.int64)
        for char, byte in alphabet.items():
            self.base[byte] = vocab[char]
        split = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.merger = Merger(lowest_first([(vocab[a], vocab[b], vocab[a + b]) for a, b in split]))
        self.pattern = regex.compile(PATTERN)
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))) if self.specials else None
        self.whole = self._prove(vocab, alphabet) if whole is None else whole
        self.cache: dict[str, int] = {}

    def _prove(self, vocab: dict[str, int], alphabet: dict[str, int]) -> frozenset[str]:
        """The strings of the vocabulary that are one pre-token and encode alone as one token."""
        strings = []
        for token in vocab:
            if token in self.specials:
                continue
            try:
                text = bytes(alphabet[c] for c in token).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if self.pattern.fullmatch(text) and self.pattern.findall(text) == [text]:
                strings.append(text)
        return frozenset(s for s, n in zip(strings, self.merged_lengths(strings), strict=True) if n == 1)

    def merged_lengths(self, words: list[str]) -> list[int]:
        """Tokens of each pre-token by its merges alone."""
        raw = [w.encode("utf-8") for w in words]
        symbols = self.base[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        return [len(x) for x in self.merger.merge(symbols, np.array([len(r) for r in raw], dtype=np.int64))]

    def _count_all(self, texts: list[str]) -> list[int]:
        """Tokens of each text, by its pre-tokens."""
        whole = self.whole
        counts, rest = [0] * len(texts), {}
        places: list[tuple[int, str]] = []
        for i, text in enumerate(texts):
            for token in self.pattern.findall(text):
                if token in whole:
                    counts[i] += 1
                else:
                    rest[token] = 0
                    places.append((i, token))
        words = list(rest)
        lengths = dict(zip(words, self.merged_lengths(words), strict=True))
        for i, token in places:
            counts[i] += lengths[token]
        return counts

    def _learn(self, chunks: set[str]) -> None:
        """Remember each chunk with the blank before it. A chunk that the blanks around it could change is marked."""
        safe = [c for c in chunks if c and not c[0].isspace() and not c[-1].isspace()]
        self.cache.update(dict.fromkeys(chunks, _UNSAFE))
        self.cache.update(zip(safe, self._count_all([" " + c for c in safe]), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text, as the library counts them without added tokens at either end."""
        out, plain, at = [0] * len(texts), [], []
        for i, text in enumerate(texts):
            if self.special is not None and self.special.search(text):
                parts = self.special.split(text)
                out[i] += len(parts) - 1
            else:
                parts = [text]
            for part in parts:
                if part:
                    plain.append(part)
                    at.append(i)
        split = [p.split(" ") for p in plain]
        missing = set(chain.from_iterable(s[1:] for s in split)).difference(self.cache)
        if len(self.cache) + len(missing) > self.CACHE:
            now = set(chain.from_iterable(s[1:] for s in split)) - missing
            self.cache = {c: self.cache[c] for c in now}
        if missing:
            self._learn(missing)
        look = self.cache.__getitem__
        first, slow = [], []
        for k, words in enumerate(split):
            total = sum(map(look, words[1:]))
            head = words[0]
            if total < 0 or (len(words) > 1 and (not head or head[-1].isspace())):
                slow.append(k)
            else:
                out[at[k]] += total
                first.append((k, head))
        for (k, _), n in zip(first, self._count_all([h for _, h in first]), strict=True):
            out[at[k]] += n
        for k, n in zip(slow, self._count_all([plain[k] for k in slow]), strict=True):
            out[at[k]] += n
        return out


_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str, whole: frozenset[str] | None = None) -> TokenCounter:
    """One counter for each process and vocabulary."""
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path, whole)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens) of every whole text.

    path: a byte-level BPE vocabulary file. Null and empty texts have 0 bytes and 0 tokens. Repeated rows
    give repeated results, an empty table an empty one; other columns, whatever their names, are not read.
    The work is row by row: no shuffle, and one batch of bounded size in memory.
    """
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    whole = counter(path).whole  # proved once, on the driver

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(path, whole)
        for batch in slices(batches):
            tokens = tool.count(texts_of(batch))
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    schema = f"doc_id {id_type.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return rows.mapInArrow(run, schema)
