"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

A candidate merge - a pair of neighbouring pieces at a place in a chunk - is skipped when a hash of
(seed, document, place of the chunk, chunk, place, left piece, right piece) falls under the dropout share. There
is no random state: the same seed gives the same segmentation on any executor and on any retry. Every occurrence
of a word has a key of its own, so it varies within documents and across them. What is remembered of a chunk is
free of dropout: its symbols, its ids and the candidates that lead to them. An occurrence that skips none of
these has these ids; any other is merged by itself. With share 0 the ids are those of the library.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.bpe import NONE, Merger, mix, spread
from quarrymill.llm.common import slices, texts_of

BLANK = "▁"
#: What a literal BLANK in a text becomes while chunks are cut: a lone surrogate, which no text has. It is written as
#: the three bytes of BLANK, so decoding gives it back.
LITERAL = "\udc00"
_CHUNK = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


class _Recorder(Merger):
    """Merges without dropout and notes each candidate: the word's number and the place in one integer, and the pair."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        super().__init__(pairs)
        self.seen: list[tuple[np.ndarray, np.ndarray]] = []

    def _salt(self, word_key, offset):
        return (word_key << np.uint64(32)) | offset.astype(np.uint64)

    def _candidates(self, left, right, salt):
        rank, merged = self._look_up(left, right)
        met = rank < NONE
        pair = (left[met].astype(np.uint64) << np.uint64(32)) | right[met].astype(np.uint64)
        self.seen.append((salt[met], pair))
        return rank, merged


class _Lists:
    """Lists of numbers in a row in one growing array."""

    def __init__(self, kind: str):
        self.data, self.used = np.empty(1 << 12, kind), 0
        self.begin, self.size = np.empty(0, np.int64), np.empty(0, np.int64)

    def extend(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        need = self.used + len(flat)
        if need > len(self.data):
            data = np.empty(need + need // 4, self.data.dtype)
            data[: self.used] = self.data[: self.used]
            self.data = data
        self.data[self.used : need] = flat
        self.begin = np.concatenate([self.begin, self.used + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.used = need

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the lists `which` in a row, and how many each has."""
        sizes = self.size[which]
        return self.data[spread(self.begin[which], sizes)], sizes

    def keep(self, which: np.ndarray) -> None:
        flat, sizes = self.of(which)
        self.data, self.used = flat, len(flat)
        self.begin, self.size = np.cumsum(sizes) - sizes, sizes


class PieceCodec:
    #: Chunks that a worker remembers, and those of one batch more; beyond it the half that is used least is forgotten.
    CACHE = 300_000

    def __init__(self, path: str, drop: float, seed: int):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.byte_id = np.full(256, -1, np.int64)
        own: dict[str, int] = {}
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                own[piece] = i
        if (self.byte_id < 0).any() or any(BLANK in p.lstrip(BLANK) for p in own):
            raise ValueError("this codec is for models with byte fallback and blanks only at the start of pieces")
        # symbols: pieces by id; characters without a piece from n on, as the ids of their bytes
        self.n = n
        self.symbol_of = np.full(0x110000, -1, np.int32)
        for piece, i in own.items():
            if len(piece) == 1:
                self.symbol_of[ord(piece)] = i
        self.strange = _Lists("<i4")
        scores = {p: model.get_score(i) for p, i in own.items()}
        rank = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = {}
        for piece, i in own.items():
            for cut in range(1, len(piece)):
                a, b = own.get(piece[:cut]), own.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = (i, rank[scores[piece]])
        self.merger, self.recorder = Merger(pairs, drop), _Recorder(pairs)
        self.seed = np.uint64(seed & (2**64 - 1))
        raw = [b""] * n
        for piece, i in own.items():
            raw[i] = piece.replace(BLANK, " ").encode("utf-8")
        for byte, i in enumerate(self.byte_id):
            raw[i] = bytes([byte])
        self.raw = _Lists("u1")
        self.raw.extend(np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], dtype=np.int64))
        # of each chunk: its place in the tables that follow
        self.cache: dict[str, int] = {}
        self.ids, self.symbols, self.places, self.pairs = _Lists("<i4"), _Lists("<i4"), _Lists("<i4"), _Lists("<u8")
        self.keys, self.uses = np.empty(0, np.uint64), np.empty(0, np.int64)

    def _forget(self) -> None:
        """Keep the half of the chunks that is used most."""
        stay = np.sort(np.argsort(-self.uses, kind="stable")[: self.CACHE // 2])
        names = list(self.cache)
        self.cache = {names[i]: k for k, i in enumerate(stay.tolist())}
        for table in (self.ids, self.symbols, self.places, self.pairs):
            table.keep(stay)
        self.keys, self.uses = self.keys[stay], self.uses[stay] // 2

    def _symbols(self, chars: str) -> np.ndarray:
        codes = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        out = self.symbol_of[codes]
        if (out < 0).any():
            for code in np.unique(codes[out < 0]).tolist():
                self.symbol_of[code] = self.n + len(self.strange.size)
                char = chr(code)
                ids = self.byte_id[np.frombuffer((BLANK if char == LITERAL else char).encode("utf-8"), dtype=np.uint8)]
                self.strange.extend(ids, np.array([len(ids)]))
            out = self.symbol_of[codes]
        return out.astype(np.int64)

    def _spelled(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same with the ids of its bytes for each character that is no piece."""
        odd = symbols >= self.n
        if not odd.any():
            return symbols, sizes
        begin, each = np.arange(len(symbols)), np.ones(len(symbols), np.int64)
        begin[odd], each[odd] = len(symbols) + self.strange.begin[symbols[odd] - self.n], self.strange.size[symbols[odd] - self.n]
        ends = np.concatenate([[0], np.cumsum(each)])[np.cumsum(sizes)]
        return np.concatenate([symbols, self.strange.data[: self.strange.used]])[spread(begin, each)], np.diff(ends, prepend=0)

    def _learn(self, names: list[str]) -> None:
        if not names:
            return
        chunks = [c if c[0] == BLANK else BLANK + c for c in names]
        symbols, lengths = self._symbols("".join(chunks)), np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        self.recorder.seen = []
        merged, sizes = self.recorder.merge_flat(symbols, lengths, np.arange(len(chunks), dtype=np.uint64))
        where, pair = (np.concatenate([np.empty(0, np.uint64), *x]) for x in zip(*self.recorder.seen, strict=True)) if self.recorder.seen else (np.empty(0, np.uint64),) * 2
        word, place = (where >> np.uint64(32)).astype(np.int64), (where & np.uint64(2**32 - 1)).astype(np.int64)
        order = np.argsort(word, kind="stable")
        met = np.bincount(word, minlength=len(chunks))
        self.cache.update(zip(names, range(len(self.keys), len(self.keys) + len(names)), strict=True))
        self.ids.extend(*self._spelled(merged, sizes))
        self.symbols.extend(symbols, lengths)
        self.places.extend(place[order], met)
        self.pairs.extend(pair[order], met)
        keys = np.fromiter((xxhash.xxh64_intdigest(c.encode("utf-8", "surrogatepass")) for c in chunks), dtype=np.uint64, count=len(chunks))
        self.keys, self.uses = np.concatenate([self.keys, mix(keys ^ self.seed)]), np.concatenate([self.uses, np.zeros(len(names), np.int64)])

    def encode_flat(self, texts: list[str], streams: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's end. streams: which of the segmentations of the seed, for each."""
        cut_up = []
        for text in texts:
            if not text:
                cut_up.append([])
                continue
            text = text.replace(BLANK, LITERAL)
            words = text.split(" ")
            # a word stands for the chunk of it and the blank before it; chunks that aren't of one blank have theirs
            cut_up.append(_CHUNK.findall(BLANK + text.replace(" ", BLANK)) if "" in words else words)
        if len(self.cache) > self.CACHE:
            self._forget()
        words = list(chain.from_iterable(cut_up))
        counts = np.array([len(x) for x in cut_up], dtype=np.int64)
        at = np.fromiter(map(self.cache.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        new = np.flatnonzero(at < 0).tolist()
        self._learn(list(dict.fromkeys(words[i] for i in new)))
        at[new] = [self.cache[words[i]] for i in new]
        ends = np.cumsum(counts)
        self.uses += np.bincount(at, minlength=len(self.uses))
        seeds = np.array([x & (2**64 - 1) for x in streams], dtype=np.uint64)
        of_place = mix(np.repeat(seeds, counts) ^ mix(np.arange(len(at)) - np.repeat(ends - counts, counts)))
        parts = [self._segment(at[i : i + 50_000], of_place[i : i + 50_000]) for i in range(0, len(at), 50_000)]
        ids = np.concatenate([np.empty(0, np.int32), *(p for p, _ in parts)])
        sizes = np.concatenate([np.empty(0, np.int64), *(n for _, n in parts)])
        return ids, np.concatenate([[0], np.cumsum(sizes)])[ends]

    def _segment(self, at: np.ndarray, of_place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks `at`, and how many each has; those occurrences that skip a candidate are merged again."""
        begin, sizes, pool = self.ids.begin[at], self.ids.size[at], self.ids.data[: self.ids.used]
        if self.merger.limit:
            keys = mix(self.keys[at] ^ of_place)
            met = self.places.size[at]
            which, of = spread(self.places.begin[at], met), np.repeat(np.arange(len(at)), met)
            skipped = mix(mix(keys[of] ^ self.places.data[which].astype(np.uint64)) ^ self.pairs.data[which]) < self.merger.limit
            other = np.zeros(len(at), bool)
            other[of[skipped]] = True
            other = np.flatnonzero(other)
            merged, own = self._spelled(*self.merger.merge_flat(*self.symbols.of(at[other]), keys[other]))
            begin[other], sizes[other] = len(pool) + np.cumsum(own) - own, own
            pool = np.concatenate([pool, merged.astype(np.int32)])
        return pool[spread(begin, sizes)], sizes

    def encode(self, texts: list[str], stream: int | list[int] = 0) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers. stream: which of the segmentations of the seed, for all texts or for each."""
        ids, ends = self.encode_flat(texts, [stream] * len(texts) if isinstance(stream, int) else stream)
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip([0, *ends.tolist()], ends.tolist())]  # noqa: B905

    def decode_flat(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts that the ids of `encode_flat` stand for, complete."""
        raw, sizes = self.raw.of(ids)
        whole, of = raw.tobytes(), np.concatenate([[0], np.cumsum(sizes)])[ends].tolist()
        return [whole[a + 1 : b].decode("utf-8", "replace") for a, b in zip([0, *of], of)]  # noqa: B905

    def decode(self, ids: bytes) -> str:
        """The text that the ids of one text stand for, complete."""
        return self.decode_flat(np.frombuffer(ids, dtype="<u4"), np.array([len(ids) // 4]))[0]


@lru_cache(maxsize=4)
def codec(path: str, drop: float = 0.0, seed: int = 0) -> PieceCodec:
    """One for each worker process and setting."""
    return PieceCodec(path, drop, seed)


def encode(docs: DataFrame, path: str, drop: float = 0.1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every whole text; null and empty texts have an empty array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, drop, seed)
        for batch in slices(batches):
            ids, ends = _by_document(tool, batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return _rows(docs, id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of `encode`'s result; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            lists = [x or [] for x in batch.column("ids").to_pylist()]
            texts = tool.decode_flat(np.array(list(chain.from_iterable(lists)), dtype=np.int64), np.cumsum([len(x) for x in lists]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, drop: float = 0.1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, n_pieces, ids_crc32, decoded_sha256 and lossless of every whole text, encoded and decoded again.

    A null text counts as empty: 0 pieces, checksum 0. Repeated rows give repeated results, an empty table an
    empty one. Row by row, without a shuffle, in batches of bounded size.
    """
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, drop, seed)
        for batch in slices(batches):
            texts = texts_of(batch)
            ids, ends = _by_document(tool, batch)
            back = tool.decode_flat(ids, ends)
            whole, ends = ids.astype("<u4").tobytes(), ends.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(np.diff(ends, prepend=0), pa.int64()),
                    pa.array([zlib.crc32(whole[4 * a : 4 * b]) for a, b in zip([0, *ends], ends)], pa.int64()),  # noqa: B905
                    pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in back], pa.string()),
                    pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_()),
                ],
                ["doc_id", "n_chars", "n_pieces", "ids_crc32", "decoded_sha256", "lossless"],
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    return _rows(docs, id_col, text_col).mapInArrow(run, f"doc_id {id_type}, n_chars bigint, n_pieces bigint, ids_crc32 bigint, decoded_sha256 string, lossless boolean")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def _by_document(tool: PieceCodec, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tool.encode_flat(texts_of(batch), [xxhash.xxh64_intdigest(str(i).encode("utf-8")) for i in batch.column("doc_id").to_pylist()])
