import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarrymill.llm import subwords, token_counts

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COUNTER, LIBRARY = token_counts.TokenCounter(BYTE), Tokenizer.from_file(BYTE)
PLAIN, DROPPED = subwords.PieceCodec(PIECE, 0.0, 0), subwords.PieceCodec(PIECE, 0.3, 7)
MODEL = sentencepiece.SentencePieceProcessor(model_file=PIECE)
TEXT = st.lists(st.sampled_from([*"abcTHE'sre don é.,!<|>\n\t\r\x0b\x1c\x85\xa0\u3000 12½", "日", "😀", "<|endoftext|>", "\u0301", "the ", "ing"]), max_size=50).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_counts_are_those_of_the_library(text):
    assert COUNTER.count([text]) == [len(LIBRARY.encode(text, add_special_tokens=False).ids)]


def test_whole_tokens_are_proved():
    assert "the" in COUNTER.whole and " the" in COUNTER.whole and "the the" not in COUNTER.whole
    some = sorted(COUNTER.whole)[::500]
    assert all(len(LIBRARY.encode(s, add_special_tokens=False).ids) == 1 for s in some)


def test_counts_of_odd_documents(odd, none):
    got = token_counts.count_tokens(odd, BYTE).collect()
    rows = odd.select("doc_id", "text").collect()
    key = lambda x: str(x)
    expected = []
    for r in rows:
        n = len(LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids)
        expected.append((r["doc_id"], len((r["text"] or "").encode()), n, n > 1024))
    assert sorted((tuple(r) for r in got), key=key) == sorted(expected, key=key)
    assert token_counts.count_tokens(none, BYTE).collect() == []


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_without_dropout_ids_are_those_of_the_library(text):
    assert np.frombuffer(PLAIN.encode([text])[0], "<u4").tolist() == MODEL.encode(text)
    assert PLAIN.decode(PLAIN.encode([text])[0]) == text


@settings(max_examples=200, deadline=None)
@given(TEXT.map(lambda t: t + "▁ x"))
def test_dropout_is_lossless(text):
    for stream in (0, 1):
        assert DROPPED.decode(DROPPED.encode([text], stream)[0]) == text


def test_long_words_merge_alike():
    word = "internationalization" * 30
    assert np.frombuffer(PLAIN.encode([word])[0], "<u4").tolist() == MODEL.encode(word)
    short, long = subwords.PieceCodec(PIECE, 0.2, 3), subwords.PieceCodec(PIECE, 0.2, 3)
    long.merger.LONG = 0  # the heap for every word
    texts = ["several words of a sentence, and internationalization"]
    assert short.encode(texts) == long.encode(texts)


def test_dropout_varies_by_seed_and_stream_only():
    text = ["several common words stand in this sentence"]
    one = DROPPED.encode(text, 0)
    assert one == subwords.PieceCodec(PIECE, 0.3, 7).encode(text, 0)
    assert one != DROPPED.encode(text, 1) and one != subwords.PieceCodec(PIECE, 0.3, 8).encode(text, 0)
    assert len(subwords.PieceCodec(PIECE, 1.0, 1).encode(["abc"])[0]) // 4 == 4


def test_round_trip_of_odd_documents(odd, none):
    rows = subwords.round_trip(odd, PIECE, 0.1, 42).collect()
    assert len(rows) == odd.count() and all(r["lossless"] for r in rows)
    texts = {r["doc_id"]: r["text"] or "" for r in odd.where("doc_id is not null").collect()}
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in rows if r["doc_id"] is not None)
    assert subwords.round_trip(none, PIECE).collect() == []


def test_encode_then_decode(odd):
    back = subwords.decode(subwords.encode(odd, PIECE, 0.1, 42), PIECE)
    key = lambda x: str(x)
    assert sorted((tuple(r) for r in back.collect()), key=key) == sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=key)


@pytest.mark.parametrize("bad", [[], [None]])
def test_decode_nothing(spark, bad):
    rows = spark.createDataFrame([(1, b) for b in bad] or [(1, [])], "doc_id long, ids array<int>")
    assert [r["text"] for r in subwords.decode(rows, PIECE).collect()] == [""]


def test_every_occurrence_may_be_segmented_in_its_own_way(spark):
    docs = spark.createDataFrame([(i, " ".join(["internationalization"] * 40)) for i in range(40)], "doc_id long, text string")
    of_word = MODEL.encode("internationalization")
    rows = subwords.encode(docs, PIECE, 0.1, 42).collect()
    assert len({tuple(r["ids"]) for r in rows}) == 40
    tool = subwords.PieceCodec(PIECE, 0.1, 42)
    text = " ".join(["internationalization"] * 2000)
    whole = tool.encode([text], 5)[0]
    assert tool.decode(whole) == text and 0 < whole.count(np.array(of_word, "<u4").tobytes()) < 2000


def plain_mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % 2**64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % 2**64
    return x ^ (x >> 31)


def plain_agenda(text, drop, seed, stream):
    """Ids of a text by one agenda for each chunk, in plain Python: the library's pieces and scores, hashes as documented."""
    ids = {MODEL.id_to_piece(i): i for i in range(MODEL.get_piece_size()) if not (MODEL.is_byte(i) or MODEL.is_control(i) or MODEL.is_unknown(i))}
    out = []
    chunks = re.findall("▁*[^▁]+|▁+", "▁" + text.replace("▁", "\udc00").replace(" ", "▁")) if text else []
    for place, chunk in enumerate(chunks):
        name = chunk[1:] if "  " not in text and not text.startswith(" ") and not text.endswith(" ") else chunk
        spelled = name if name[:1] == "▁" else "▁" + name
        key = plain_mix(plain_mix(xxhash.xxh64_intdigest(spelled.encode("utf-8", "surrogatepass")) ^ seed) ^ plain_mix(stream ^ plain_mix(place)))
        parts = list(enumerate(spelled))  # (place of the first character, piece)
        while True:
            found = [(-MODEL.get_score(ids[a + b]), i) for (i, a), (_, b) in zip(parts, parts[1:]) if a in ids and b in ids and a + b in ids and plain_mix(plain_mix(key ^ i) ^ (ids[a] << 32 | ids[b])) >= int(drop * 2**64)]  # noqa: B905
            if not found:
                break
            best = min(found)
            at = next(k for k, (i, _) in enumerate(parts) if i == best[1])
            parts[at : at + 2] = [(best[1], parts[at][1] + parts[at + 1][1])]
        for _, piece in parts:
            out += [ids[piece]] if piece in ids else [MODEL.piece_to_id(f"<0x{x:02X}>") for x in piece.replace("\udc00", "▁").encode()]
    return out


@settings(max_examples=60, deadline=None)
@given(TEXT, st.integers(0, 2**64 - 1))
def test_dropout_is_that_of_a_plain_agenda(text, stream):
    for tool, drop, seed in ((DROPPED, 0.3, 7), (PLAIN, 0.0, 0)):
        assert np.frombuffer(tool.encode([text], stream)[0], "<u4").tolist() == plain_agenda(text, drop, seed, stream)


def test_segmentations_do_not_depend_on_what_is_remembered():
    texts = [f"several words of sentence {i}, and internationalization of 日本 é " * 20 for i in range(30)] + ["a  b   c", ""]
    small, large = subwords.PieceCodec(PIECE, 0.1, 42), subwords.PieceCodec(PIECE, 0.1, 42)
    small.CACHE = 8  # forgets after each text
    assert [small.encode([t], i)[0] for i, t in enumerate(texts)] == large.encode(texts, list(range(len(texts))))
    assert len(small.cache) < 40
