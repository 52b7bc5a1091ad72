import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarrymill.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def tool():
    return packing.WordTokenizer(PATH)


def ids(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"abcTHE'sdon éÉßİΣς.,!<|>\n\t\r\x0b\x85 12½", "日", "😀", "<|endoftext|>", "\u0301", ", ", ". "]), max_size=40).map("".join))
def test_ids_are_those_of_the_library(text):
    assert TOOL.encode([text])[0] == ids(LIBRARY, text)


TOOL, LIBRARY = packing.WordTokenizer(PATH), Tokenizer.from_file(PATH)


def check_whole(rows, size):
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= size
    return len(places)


@pytest.mark.parametrize("size", [7, 64, 2048])
def test_pieces_and_places(spark, odd, library, size):
    rows = packing.pack(odd, PATH, size=size, part_rows=3).collect()
    expected = {}
    for d in odd.select("doc_id", "text").collect():
        whole = ids(library, d["text"] or "") + bytes(4)
        for k, a in enumerate(range(0, len(whole), 4 * size)):
            part = whole[a : a + 4 * size]
            key = (d["doc_id"], k, a // 4, len(part) // 4, zlib.crc32(part))
            expected[key] = expected.get(key, 0) + 1
    got = {}
    for r in rows:
        key = tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32"))
        got[key] = got.get(key, 0) + 1
    assert got == expected
    total = sum(r["length"] for r in rows)
    assert check_whole(rows, size) >= -(-total // size)


def test_few_sequences(documents):
    rows = packing.pack(documents, PATH).collect()
    assert check_whole(rows, 2048) <= -(-sum(r["length"] for r in rows) // 2048) * 1.02 + 1


def test_empty_table(none):
    assert packing.pack(none, PATH).collect() == []


def best_fit(lengths, size):
    """Best fit, longest first, one piece at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(size - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(25))
def test_plan_is_best_fit(seed):
    random.seed(seed)
    size = random.choice([10, 30, 100])
    histogram = {random.randint(1, size): random.randint(1, 40) for _ in range(random.randint(1, 15))}
    slots = packing.plan(histogram, size)
    places, ranks = {}, {}
    for length, a, b, first, each, place in slots:
        for r in range(a, b):
            ranks.setdefault(length, []).append(r)
            places.setdefault(first + (r - a) // each, []).append((place + (r - a) % each * length, length))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in histogram.items()}
    for found in places.values():
        at = 0
        for p, n in sorted(found):
            assert p == at
            at += n
        assert at <= size
    assert len(places) == best_fit([n for n, c in histogram.items() for _ in range(c)], size)


def test_rows_that_repeat_are_dealt_to_many_parts(spark):
    """A row of one id and text, repeated, is packed as often as it stands there, in parts of a few pieces."""
    docs = spark.range(3000).selectExpr("7L AS doc_id", "if(id % 3 = 0, 'some other words, more of them', 'one text') AS text").repartition(3)
    rows = packing.pack(docs, PATH, size=64, part_rows=16).collect()
    assert len(rows) == 3000 and {r["doc_id"] for r in rows} == {7}
    total = sum(r["length"] for r in rows)
    assert check_whole(rows, 64) <= -(-total // 64) * 1.05 + 1
