"""Best-fit packing planned on the histogram of lengths.

Documents are tokenized once; only (id, piece, start, length, checksum) is kept of them. How many pieces
have each length is all that planning needs: best fit, longest first, places whole counts of equal pieces
into whole groups of equally filled sequences. The plan lists slots: "the pieces of length L with ranks
a to b go to sequences s, s+1, ..., k in each, from place o". A piece takes its slot by its rank within its length.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarrymill.llm.bpe import Merger, lowest_first
from quarrymill.llm.common import Recent, slices, texts_of
from quarrymill.llm.token_counts import byte_alphabet
from quarrymill.sources.tables import cut

#: Fixed value: the pre-token pattern of this kind of vocabulary, for one word of normalised text.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Words whose normal form is their lower case, letter by letter: printable ASCII without "<", and composed Latin letters.
PLAIN = re.compile("[!-;=-~\u00c0-\u012f\u0131-\u0148\u014a-\u017e]+")
PLAIN_TEXT = re.compile("[ \n\t\r!-;=-~\u00c0-\u012f\u0131-\u0148\u014a-\u017e]*")
#: A comma or full stop that ends a longer run of marks.
MARKS = re.compile(r"[!-/:-@\[-`{-~][,.](?:[ \n]|$)")


class WordTokenizer:
    """Ids of texts under a vocabulary that drops white space, with a bounded memory of words."""

    #: A worker remembers twice as many words at most (see `Recent`): some 80 MB.
    WORDS = 250_000

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.words = Recent(self.WORDS)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        end = spec["model"]["end_of_word_suffix"]
        self.inner, self.last = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for char, byte in byte_alphabet().items():
            self.inner[byte], self.last[byte] = vocab[char], vocab[char + end]
        split = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.merger = Merger(lowest_first([(vocab[a], vocab[b], vocab[a + b]) for a, b in split]))
        self.pattern = regex.compile(WORD_PATTERN)

    def _merge(self, tokens: list[str]) -> list[bytes]:
        """Ids of pre-tokens by their merges."""
        if not tokens:
            return []
        raw = [t.encode("utf-8") for t in tokens]
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        lengths = np.array([len(r) for r in raw], dtype=np.int64)
        symbols = self.inner[flat]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[flat[ends]]
        return [ids.astype("<u4").tobytes() for ids in self.merger.merge(symbols, lengths)]

    def _learn(self, words: set[str]) -> None:
        """Remember the ids of words.

        Those of plain letters and marks are cut here; a part alone has the ids that it has in the word, so parts are
        remembered as words are. The others are left to the library.
        """
        parts, far, marked = set(), [], {}
        for w in words:
            if not PLAIN.fullmatch(w):
                far.append(w)
            elif w.isalpha() and w.islower():
                parts.add(w)
            else:
                marked[w] = self.pattern.findall(w.lower())
        parts.update(chain.from_iterable(marked.values()))
        missing = list(self.words.unknown(parts))
        known = self.words.now
        known.update(zip(missing, self._merge(missing), strict=True))
        look = known.__getitem__
        known.update((w, b"".join(map(look, c))) for w, c in marked.items())
        known.update(zip(far, self._encode(far), strict=True))

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        White space ends a word whatever stands around it, so words are encoded alone and remembered; those of
        plain letters in lower case, which is how they are encoded.
        A text with other white space than blank, tab and line ends is encoded whole.
        """
        words, plain = [], []
        for t in texts:
            if PLAIN_TEXT.fullmatch(t):
                t = t.lower()
                if not MARKS.search(t):  # a mark after a letter or digit is a pre-token of its own, so it may be a word of its own
                    t = t.replace(", ", " , ").replace(". ", " . ").replace(".\n", " . ")
                words.append(t.split())
                plain.append(True)
            else:
                words.append(t.split())
                plain.append(sum(map(len, words[-1])) + sum(map(t.count, " \n\t\r")) == len(t))
        used = [w for w, p in zip(words, plain, strict=True) if p]
        self.words.age()
        self._learn(self.words.unknown(set(chain.from_iterable(used))))
        look = self.words.now.__getitem__
        out = [b"".join(map(look, w)) if p else b"" for w, p in zip(words, plain, strict=True)]
        odd = [i for i, p in enumerate(plain) if not p]
        for i, ids in zip(odd, self._encode([texts[i] for i in odd]), strict=True):
            out[i] = ids
        return out


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One for each worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(path)


def pieces(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece: a document's ids and `end_id`, cut every `size` ids."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = word_tokenizer(path)
        for batch in slices(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(tool.encode(texts_of(batch))):
                ids += end
                for k, a in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[a : a + 4 * size]
                    row.append(i)
                    piece.append(k)
                    start.append(a // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            ids = batch.column("doc_id").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint")


def plan(histogram: dict[int, int], size: int = 2048) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, end rank, first sequence, pieces in each sequence, place in the sequence).

    Best fit over counts, longest first: the pieces of a length go to the fullest sequences that hold one,
    as many into each as fit, before the next emptier ones; new sequences are opened last.
    """
    slots: list[tuple[int, int, int, int, int, int]] = []
    rooms: list[int] = []  # free places that open sequences have, ascending
    open_: dict[int, list[tuple[int, int]]] = {}  # free places -> runs of (first sequence, how many)
    opened = 0

    def put(room: int, run: tuple[int, int]) -> None:
        if room:
            if room not in open_:
                bisect.insort(rooms, room)
                open_[room] = []
            open_[room].append(run)

    for length in sorted((n for n in histogram if histogram[n]), reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                first, have, room = opened, -(-left // (size // length)), size
                opened += have
            else:
                room = rooms[at]
                first, have = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            each = room // length
            full = min(have, left // each)
            if full:
                slots.append((length, rank, rank + full * each, first, each, size - room))
                put(room - each * length, (first, full))
                rank, left = rank + full * each, left - full * each
                first, have = first + full, have - full
            if have and left:  # fewer than `each` are left: one more sequence takes them
                slots.append((length, rank, rank + left, first, left, size - room))
                put(room - left * length, (first, 1))
                first, have, left = first + 1, have - 1, 0
            if have:
                put(room, (first, have))
    return slots


def pack(docs: DataFrame, path: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", part_rows: int = 512, broadcast_rows: int = 100_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece of every document in a sequence of at most `size` tokens.

    A null or empty text is the end id alone. Documents longer than `size` are cut into pieces. Repeated
    rows, also with one id, are packed each on its own; an empty table gives none. Other columns are not read.
    The driver gets the histogram (at most `size` rows) and the plan, no row of a document.

    Ranks within a length are counted in parts, as many as give a part some `part_rows` pieces, so a length that many
    documents share is not one task's work, nor is a row that is repeated often: parts are dealt by a piece's place in the
    written table of pieces, whatever it holds. Slots meet pieces by length and by the thousand that their ranks are in,
    so a piece is tried against the slots of its thousand, not against all of its length.
    """
    # numbered as written, so a task that runs again gives a piece the same number
    found = cut(pieces(docs, path, size, id_col=id_col, text_col=text_col)).withColumn("at", F.monotonically_increasing_id())
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    session = docs.sparkSession
    # one row for each length, `size` at most, so broadcast
    dealt = F.broadcast(session.createDataFrame([(n, -(-k // part_rows)) for n, k in histogram.items()], "length bigint, parts bigint"))
    salted = found.join(dealt, "length").withColumn("salt", F.pmod(F.xxhash64("at"), F.col("parts"))).drop("parts")
    counts = cut(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).select("length", "salt", "before")
    within = Window.partitionBy("length", "salt").orderBy("at")
    ranked = salted.withColumn("k", F.row_number().over(within) - 1).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("k"))
    slots = plan(histogram, size)
    thousand = lambda rank: F.shiftright(rank, 10)
    table = session.createDataFrame(slots, "length bigint, a bigint, b bigint, first bigint, each bigint, place bigint")
    table = table.withColumn("thousand", F.explode(F.sequence(thousand(F.col("a")), thousand(F.col("b") - 1))))
    rows = sum((b - 1 >> 10) - (a >> 10) + 1 for _, a, b, *_ in slots)
    table = F.broadcast(table) if rows <= broadcast_rows else table
    at = F.col("rank") - F.col("a")
    return (
        ranked.withColumn("thousand", thousand(F.col("rank")))
        .join(table, ["length", "thousand"])
        .where((F.col("rank") >= F.col("a")) & (F.col("rank") < F.col("b")))
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"), (F.col("place") + F.pmod(at, F.col("each")) * F.col("length")).alias("offset"))
    )
