"""Alignment of two tokenizations of each text by the byte offsets where both cut it.

The relational plan is: tokens with the sums of their lengths so far, an equi-join of the two sides on (text, end), the
running number of cuts as the group of a token, and a join of the two sides by group for the links. `links` states it in
Spark for tables of tokens.

For a corpus the plan is run on its distinct pieces instead. Both tokenizers cut before a blank that follows something
other than white space, so a text is a row of pieces that are tokenized and aligned each by itself, and a piece that comes
again has the same groups. Tasks remember the pieces they met, in bounded tables, run the plan on the others, all of a
batch at once on arrays (sums, join of ends, running counts, join by group), and put documents together from them. What
is counted over the corpus - how many documents hold a pair of ids linked - is grouped, compared and joined by Spark.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.llm.bpe import spread
from quarrymill.llm.common import slices
from quarrymill.llm.token_counts import byte_alphabet
from quarrymill.sources.tables import cut, ensure_checkpoint_dir

#: Pairs of ids whose counts are joined by broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: A blank after something that no tokenizer takes for white space.
_CUT = re.compile(r"(?<=\S) ")
_NO_CUT = re.compile(r"(?:^|\s) ")


def links(tokens: DataFrame) -> DataFrame:
    """row, grp (from 0), a_pos, a_id, b_pos and b_id of every linked pair of tokens.

    tokens: row (unique), a and b: arrays of (id, size) whose sizes add up to the same; a row with empty arrays has no links.
    A row's tokens are no more than its text, and windows are over rows; nothing wider than a row meets.
    """

    def side(name: str) -> DataFrame:
        along = Window.partitionBy("row").orderBy("pos")
        flat = tokens.select("row", F.posexplode(name).alias("pos", "t"))
        return flat.select("row", "pos", F.col("t.id").alias("id"), F.sum("t.size").over(along).alias("end"))

    a, b = side("a"), side("b")
    cuts = a.select("row", "end").join(b.select("row", "end"), ["row", "end"]).withColumn("is_cut", F.lit(1))

    def grouped(tokens: DataFrame, name: str) -> DataFrame:
        before = Window.partitionBy("row").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        marked = tokens.join(cuts, ["row", "end"], "left")
        return marked.select("row", F.coalesce(F.sum("is_cut").over(before), F.lit(0)).alias("grp"), F.col("pos").alias(f"{name}_pos"), F.col("id").alias(f"{name}_id"))

    return grouped(a, "a").join(grouped(b, "b"), ["row", "grp"])


class _Rows:
    """Lists of numbers, appended and looked up together."""

    def __init__(self, kind: str):
        self.data, self.begin, self.size = np.empty(0, kind), np.empty(0, np.int64), np.empty(0, np.int64)
        self.parts: list[np.ndarray] = []
        self.used = 0

    def extend(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.begin = np.concatenate([self.begin, self.used + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        if self.used + len(flat) > len(self.data):
            grown = np.empty((self.used + len(flat)) * 5 // 4 + 1024, self.data.dtype)
            grown[: self.used] = self.data[: self.used]
            self.data = grown
        self.data[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def of(self, which: np.ndarray) -> np.ndarray:
        return self.data[spread(self.begin[which], self.size[which])]

    def keep(self, which: np.ndarray) -> None:
        flat, sizes = self.of(which), self.size[which]
        self.data, self.begin, self.size, self.used = flat, np.cumsum(sizes) - sizes, sizes, len(flat)


class Aligner:
    #: Pieces that a worker remembers, and those of one batch more; beyond it the half that is used least is forgotten.
    CACHE = 300_000
    #: Links of one group that are listed one by one; of a larger group, pairs of distinct ids are, with their numbers.
    WIDE = 4096

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        self.raw_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            if all(c in alphabet for c in token):
                self.raw_a[i] = bytes(alphabet[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.raw_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode("utf-8") for i, p in enumerate(pieces)]
        self.blank = self.b.piece_to_id("▁")
        self.size_a, self.size_b = (np.array([len(r) for r in raw], np.int64) for raw in (self.raw_a, self.raw_b))
        #: A pair of ids is one number: the one of A times this and the one of B.
        self.base = len(self.raw_b)
        self.cache: dict[str, int] = {}
        self.texts: list[str] = []
        self.numbers = np.empty((0, 5), np.int64)  # n_a, n_b, n_groups, n_links, and 1 where the bytes are those of the piece
        self.pairs, self.times = _Rows("<i8"), _Rows("<i4")
        self.uses = np.empty(0, np.int64)

    def tokens(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides of each piece with the blank before it."""
        a = [e.ids for e in self.a.encode_batch([" " + p for p in pieces], add_special_tokens=False)]
        return a, [ids or [self.blank] for ids in self.b.encode(pieces, num_threads=1)]

    def learn(self, pieces: list[str]) -> None:
        """Tokenize, align and remember these pieces."""
        a, b = self.tokens(pieces)
        same = np.ones(len(pieces), bool)
        for i, piece in enumerate(pieces):
            whole = b" " + piece.encode("utf-8")
            same[i] = b"".join(map(self.raw_a.__getitem__, a[i])) == whole == b"".join(map(self.raw_b.__getitem__, b[i]))
        for i in np.flatnonzero(~same).tolist():
            a[i] = b[i] = []
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        id_a, id_b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a, n_a), (b, n_b)))
        # ends, counted through all pieces: the two sides agree at the end of every piece, so groups stay within pieces
        end_a, end_b = np.cumsum(self.size_a[id_a]), np.cumsum(self.size_b[id_b])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        in_a, in_b = np.bincount(np.searchsorted(cuts, end_a), minlength=len(cuts)), np.bincount(np.searchsorted(cuts, end_b), minlength=len(cuts))
        begin_a, begin_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        last = np.concatenate([[0], np.cumsum(self.size_a[id_a])])[np.cumsum(n_a)]  # where each piece ends
        upto = np.searchsorted(cuts, last, side="right")
        n_groups = np.diff(upto, prepend=0)
        of_piece = np.repeat(np.arange(len(pieces)), n_groups)
        n_links = np.bincount(of_piece, weights=in_a * in_b, minlength=len(pieces)).astype(np.int64)
        wide = np.flatnonzero(in_a * in_b > self.WIDE)
        few = np.ones(len(cuts), bool)
        few[wide] = False
        # join by group: each token of A with all tokens of B in its group
        group = np.repeat(np.arange(len(cuts)), in_a)
        listed = few[group]
        codes = [np.repeat(id_a[listed], in_b[group[listed]]) * self.base + id_b[spread(begin_b[group[listed]], in_b[group[listed]])]]
        times, owner = [np.ones(len(codes[0]), np.int64)], [np.repeat(of_piece[group[listed]], in_b[group[listed]])]
        for g in wide.tolist():
            (u, m), (v, n) = (np.unique(x[s : s + k], return_counts=True) for x, s, k in ((id_a, begin_a[g], in_a[g]), (id_b, begin_b[g], in_b[g])))
            codes.append((u[:, None] * self.base + v).ravel())
            times.append(np.outer(m, n).ravel())
            owner.append(np.full(len(codes[-1]), of_piece[g]))
        code, count, of = np.concatenate(codes), np.concatenate(times), np.concatenate(owner)
        if len(wide):
            order = np.argsort(of, kind="stable")
            code, count, of = code[order], count[order], of[order]
        shown_a, shown_b = list(map(str, id_a.tolist())), list(map(str, id_b.tolist()))
        groups = [f"{','.join(shown_a[p : p + m])}|{','.join(shown_b[q : q + n])}" for p, m, q, n in zip(begin_a.tolist(), in_a.tolist(), begin_b.tolist(), in_b.tolist(), strict=True)]
        ends = upto.tolist()
        self.cache.update(zip(pieces, range(len(self.texts), len(self.texts) + len(pieces)), strict=True))
        self.texts += [";".join(groups[i:j]) for i, j in zip([0, *ends], ends)]  # noqa: B905
        self.numbers = np.concatenate([self.numbers, np.stack([n_a, n_b, n_groups, n_links, same], axis=1)])
        sizes = np.bincount(of, minlength=len(pieces))
        self.pairs.extend(code, sizes)
        self.times.extend(count, sizes)
        self.uses = np.concatenate([self.uses, np.zeros(len(pieces), np.int64)])

    def _forget(self) -> None:
        stay = np.sort(np.argsort(-self.uses, kind="stable")[: self.CACHE // 2])
        names = list(self.cache)
        self.cache = {names[i]: k for k, i in enumerate(stay.tolist())}
        self.texts = [self.texts[i] for i in stay.tolist()]
        self.pairs.keep(stay)
        self.times.keep(stay)
        self.numbers, self.uses = self.numbers[stay], self.uses[stay] // 2

    def documents(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups and n_links of each text, digests of its groups, and its distinct pairs: sizes, pairs and how often each is linked."""
        if len(self.cache) > self.CACHE:
            self._forget()
        cut_up = [[] if not t else _CUT.split(t) if _NO_CUT.search(t) else t.split(" ") for t in texts]
        counts = np.fromiter(map(len, cut_up), np.int64, len(cut_up))
        words = list(chain.from_iterable(cut_up))
        at = np.fromiter(map(self.cache.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0).tolist()
        if new:
            self.learn(list(dict.fromkeys(words[i] for i in new)))
            at[new] = [self.cache[words[i]] for i in new]
        self.uses += np.bincount(at, minlength=len(self.uses))
        of = np.repeat(np.arange(len(texts)), counts)
        sums = np.stack([np.bincount(of, weights=self.numbers[at, k], minlength=len(texts)) for k in range(5)], axis=1).astype(np.int64)
        whole = (sums[:, 4] == counts) & (counts > 0)
        numbers = np.where(whole[:, None], sums[:, :4], 0)
        digests, places, begin = [], at.tolist(), (np.cumsum(counts) - counts).tolist()
        for i, n in enumerate(counts.tolist()):
            text = ";".join(map(self.texts.__getitem__, places[begin[i] : begin[i] + n])) if whole[i] else ""
            digests.append(hashlib.sha256(text.encode()).hexdigest() if text else "")
        kept = whole[of]
        at, of = at[kept], of[kept]
        code, weight, doc = self.pairs.of(at), self.times.of(at), np.repeat(of, self.pairs.size[at])
        # documents come in order, so sorting within them is sorting (document, pair)
        span = np.int64(len(self.raw_a)) * self.base
        keyed = doc * span + code
        order = np.argsort(keyed, kind="stable") if (weight != 1).any() else None
        keyed = np.sort(keyed) if order is None else keyed[order]
        first = np.flatnonzero(np.diff(keyed, prepend=-1))
        times = np.diff(first, append=len(keyed)) if order is None else np.add.reduceat(weight[order].astype(np.int64), first) if len(first) else first
        return numbers, digests, np.bincount(keyed[first] // span, minlength=len(texts)), keyed[first] % span, times


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker process and pair of vocabularies."""
    return Aligner(path_a, path_b)


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (distinct linked pairs, A's id * pieces of B + B's id) and times of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(path_a, path_b)
        for batch in slices(batches, 1_000_000):
            numbers, digests, sizes, pairs, times = tool.documents(batch.column("text").to_pylist())
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (pairs, times)]
            columns = [batch.column("doc_id"), *(pa.array(numbers[:, k]) for k in range(4)), pa.array(digests, pa.string()), *lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>")


def pair_counts(held: DataFrame, a_id: Column) -> DataFrame:
    """pair, n (rows of `held` that have it in `pairs`) and best: whether no pair of the same A id has more."""
    counts = cut(held.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    most = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", a_id).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every whole text.

    A: a byte-level vocabulary file, of the text with a blank before it; B: a SentencePiece model, which adds the blank. A
    text that is null or empty, or that one side does not give back byte for byte, has no tokens: zeros and ''. Rows with
    repeated or null ids count as documents each; an empty table gives an empty one. Other columns are not read. What a row
    is linked by is written once, to the shared folder, and read for the counts and for the sums.
    """
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/aligned-{uuid.uuid4().hex}"
    aligned(docs, path_a, path_b, id_col, text_col).withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(folder)
    held = spark.read.parquet(folder)
    base = aligner(path_a, path_b).base
    marks = cut(pair_counts(held, F.floor(F.col("pair") / base)))
    known = F.broadcast(marks) if marks.count() <= BROADCAST_ROWS else marks
    each = held.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    sums = each.join(known, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return held.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
