import hashlib
import math
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from quarrymill.llm import fingerprints
from tests.llm.conftest import plan_of


def expected(rows):
    """(doc_id, n_chars, edited hash) by a sort of all rows."""
    docs = sorted(((i is None, -(i or 0), t or "") for i, t in rows), key=lambda r: (r[0], r[1], r[2].encode()))
    out = []
    for k, (null, i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][2]
        m = len(t) // 3
        out.append((None if null else -i, len(t), hashlib.sha256((t[: len(t) - m] + after[:m]).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [64, 1024])
def test_edited_texts(odd, block):
    got = fingerprints.edited_pairs(odd, block=block).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == expected([(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()])
    by_text = {}
    texts = {(r["doc_id"]): r["text"] or "" for r in odd.collect() if r["doc_id"] is not None}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if r["doc_id"] is not None:
            by_text.setdefault(texts[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert len({next(iter(v)) for v in by_text.values()}) == len(by_text)


def test_sparse_ids(spark):
    rows = [(i, f"text {i}. And {i * i}.") for i in (0, 1, 1500, 10**6, 10**6 + 1, 7 * 10**12, 2**60)]
    got = fingerprints.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string"), block=64).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == expected(rows)


@pytest.mark.parametrize("hot", [None, 5, -(2**63)])
def test_hot_ids_are_split(spark, hot):
    rows = [(hot, f"text {i % 25}.") for i in range(60)] + [(hot, None)] * 9 + [(i, f"other {i}") for i in range(0, 14)] + [(6, f"six {i}") for i in range(9)] + [(7, "seven")] * 7 + [(None, "none"), (-(2**62), "low"), (2**63 - 1, "high")]
    got = fingerprints.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), block=4).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == expected(rows)


def test_ids_of_text_are_refused(spark):
    with pytest.raises(TypeError):
        fingerprints.edited_pairs(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def plain_hash(unit, seed):
    """Spark's xxhash64 of a string and an integer: each hashed with the hash before it as the seed."""
    first = xxhash.xxh64_intdigest(unit.encode(), 42)
    return xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), first)


def plain_vector(text):
    """(wide lanes, sentences, one-bit lanes) as plain sums."""
    paragraphs = text.split("\n")
    wide = []
    for seed in range(fingerprints.WIDE):
        hashes = [plain_hash(p, seed) for p in paragraphs]
        wide += [sum(h % 2**32 for h in hashes) % 2**32, sum(h >> 32 for h in hashes) % 2**32]
    sentences = [s for p in paragraphs for s in re.split(r"(?<=[.!?])\s+", p)]
    bits = []
    for seed in range(fingerprints.SIGNS):
        hashes = [plain_hash(s, 100 + seed) for s in sentences]
        bits += [[sum(h >> (i + lane) & 1 for h in hashes) for lane in (0, 21, 42)] for i in range(21)]
    return wide, len(sentences), [x for b in bits for x in b]


def plain_likeness(a, b):
    if a == b:
        return 1.0
    x, y = ([2 * v - n for v in bits] for _, n, bits in (a, b))
    norm = math.sqrt(sum(v * v for v in x) * sum(v * v for v in y))
    return min(1.0, max(0.0, sum(v * w for v, w in zip(x, y, strict=True)) / norm)) if norm else 0.0


def test_lanes_and_likeness_are_plain_sums(spark):
    texts = ["", "one", "One. Two! Three?\nfour\n\nfive. six", "One. Two! Three?\nfour\n\nfive. seven", "é ñ 日本. x\n" * 40, " ".join(f"s{i}." for i in range(200))]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate((a, b) for a in texts for b in texts)], "i int, a string, b string")
    v = fingerprints.vector
    for r in rows.select("a", "b", v(F.col("a")).alias("v"), fingerprints.fingerprint(v(F.col("a"))).alias("f"), fingerprints.likeness(v(F.col("a")), v(F.col("b"))).alias("near")).collect():
        wide, n, bits = plain_vector(r["a"])
        packed = [sum(bits[3 * i + k] << 21 * k for k in range(3)) for i in range(21 * fingerprints.SIGNS)]
        assert r["v"] == [*wide, n, *packed]
        assert r["f"] == "".join(f"{x:08x}" for x in wide) + "".join(f"{x:016x}" for x in [n, *packed])
        assert r["near"] == pytest.approx(plain_likeness(plain_vector(r["a"]), plain_vector(r["b"])))


def test_one_row_and_none(spark, none):
    one = fingerprints.edited_pairs(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one[0]["near_next"] == 1.0
    assert fingerprints.edited_pairs(none).collect() == []


def test_order_of_paragraphs_and_updates(spark):
    v = fingerprints.vector
    text = lambda s: v(F.lit(s))
    row = spark.range(1).select(
        (text("one a.\ntwo b.\nthree c.") == text("three c.\none a.\ntwo b.")).alias("order"),
        (fingerprints.insert(text("one a.\ntwo b."), F.lit("three c.")) == text("one a.\ntwo b.\nthree c.")).alias("insert"),
        (fingerprints.delete(text("one a.\ntwo b.\nthree c."), F.lit("two b.")) == text("one a.\nthree c.")).alias("delete"),
        (text("one a.\none a.") == text("one a.")).alias("repeat"),
        fingerprints.likeness(text("".join(f"s{i} x. " for i in range(90))), text("".join(f"s{i} x. " for i in range(60)) + "".join(f"t{i} x. " for i in range(30)))).alias("near"),
    ).first()
    assert row["order"] and row["insert"] and row["delete"] and not row["repeat"]
    assert 0.4 < row["near"] < 0.9


def test_native(odd):
    plan = plan_of(fingerprints.edited_pairs(odd))
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "MapPartitions"))


def test_edited_is_nearer_than_next(documents):
    row = fingerprints.edited_pairs(documents).agg(F.avg("near_edited").alias("e"), F.avg("near_next").alias("n")).first()
    assert row["e"] > 0.4 > 0.2 > row["n"]
