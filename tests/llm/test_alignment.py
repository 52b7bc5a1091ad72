import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quarrymill.llm import alignment, queries
from quarrymill.llm.token_counts import byte_alphabet

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Plain:
    """Whole texts by the libraries, groups by walking the ends."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        self.alphabet = byte_alphabet()

    def tokens(self, text):
        """(id, bytes) of both sides, or nothing."""
        if not text:
            return [], []
        a = [(i, bytes(self.alphabet[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([i - 3]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()) for i in self.b.encode(text)]
        whole = (" " + text).encode()
        return (a, b) if all(b"".join(r for _, r in x) == whole for x in (a, b)) else ([], [])

    def groups(self, text):
        a, b = self.tokens(text)
        ends = []
        for side in (a, b):
            upto, found = 0, []
            for _, raw in side:
                upto += len(raw)
                found.append(upto)
            ends.append(found)
        out, i, j = [], 0, 0
        for c in sorted(set(ends[0]) & set(ends[1])):
            k, m = i, j
            while i < len(a) and ends[0][i] <= c:
                i += 1
            while j < len(b) and ends[1][j] <= c:
                j += 1
            out.append(([x for x, _ in a[k:i]], [x for x, _ in b[m:j]]))
        return len(a), len(b), out

    def table(self, rows):
        docs = [(doc, *self.groups(text)) for doc, text in rows]
        links = [[(x, y) for ga, gb in groups for x in ga for y in gb] for *_, groups in docs]
        held = Counter(pair for found in links for pair in set(found))
        most = defaultdict(int)
        for (x, _), n in held.items():
            most[x] = max(most[x], n)
        shown = [";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups) for *_, groups in docs]
        digest = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in shown]
        return ordered((d, n, m, len(g), len(found), sum(held[p] == most[p[0]] for p in found), sum(held[p] for p in found), s) for (d, n, m, g), found, s in zip(docs, links, digest, strict=True))


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.fixture(scope="module")
def plain():
    return Plain()


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    signs = "ab  \n\t the of 日本é😀▁<|endoftext|> 's 12 ,.  \x85\x1c"
    mixed = [(i, "".join(draw.choice(signs) for _ in range(draw.randint(0, 60)))) for i in range(200)]
    return mixed + [(None, None), (None, "no id"), (5, ""), (7, " "), (8, "  "), (9, "abc "), (9, "abc "), (10, " abc  def "), (11, "x" * 3000), (12, "<s> </s> <unk> <0x0A> <|endoftext|>"), (13, "日本語テキスト" * 50), (14, "a▁b and the rest"), (15, "ends in a line\n"), (16, "\x00 zero")]


def test_equals_whole_texts_by_the_libraries(spark, plain, rows, monkeypatch):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, row long, pair long, pairs string").repartition(3)
    want = plain.table(rows)
    assert ordered(alignment.align(df, A, B).collect()) == want
    monkeypatch.setattr(alignment, "BROADCAST_ROWS", 0)
    assert ordered(alignment.align(df, A, B).collect()) == want


def test_odd_documents(odd, none, plain):
    assert ordered(alignment.align(odd, A, B).collect()) == plain.table([tuple(r) for r in odd.select("doc_id", "text").collect()])
    assert alignment.align(none, A, B).collect() == []


def test_wide_groups_and_a_small_memory_change_nothing(plain, rows):
    small = type("Small", (alignment.Aligner,), {"WIDE": 2, "CACHE": 40})(A, B)
    large = alignment.Aligner(A, B)
    for start in range(0, len(rows), 23):
        texts = [t for _, t in rows[start : start + 23]]
        for x, y in zip(small.documents(texts), large.documents(texts), strict=True):
            assert list(map(str, x)) == list(map(str, y))
    assert len(small.cache) < 600 < len(large.cache)


def test_the_relational_plan_gives_the_same_links(spark, plain, rows):
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    tokens = [(i, *([(x, len(r)) for x, r in side] for side in plain.tokens(t))) for i, t in rows]
    found = alignment.links(spark.createDataFrame(tokens, "row long, a array<struct<id:int,size:int>>, b array<struct<id:int,size:int>>"))
    got = {(r["row"], r["grp"], r["a_id"], r["b_id"]): r["n"] for r in found.groupBy("row", "grp", "a_id", "b_id").agg(F.count("*").alias("n")).collect()}
    want = Counter((i, g, x, y) for i, t in rows for g, (ga, gb) in enumerate(plain.groups(t)[2]) for x in ga for y in gb)
    assert got == want


def test_a_text_without_blanks_is_one_piece(plain):
    text = "".join(chr(0x4E00 + i * 37 % 5000) for i in range(20_000))
    numbers, digests, *_ = alignment.aligner(A, B).documents([text])
    n, m, groups = plain.groups(text)
    assert numbers[0].tolist() == [n, m, len(groups), sum(len(x) * len(y) for x, y in groups)]


def test_query(spark, sf_dir, documents, plain):
    out = queries.op12_token_alignment(spark, sf_dir)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert ordered(out.collect()) == plain.table([tuple(r) for r in documents.select("doc_id", "text").collect()])
