import random

import pytest
import xxhash

from quarrymill.llm import near_copies, simhash


def brute_fingerprint(text, k=3):
    words, word = [], b""
    for b in (text or "").encode():
        if b in b" \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), b""
        else:
            word += bytes([b + 32 if 65 <= b <= 90 else b])
    words += [word] * bool(word)
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: (id, fingerprint); the least id reachable by links of 2 bits."""
    values = sorted({f for _, f in prints})
    of = {f: f for f in values}

    def root(f):
        while of[f] != f:
            f = of[f]
        return f

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                of[root(a)] = root(b)
    least = {}
    for i, f in prints:
        if i is not None:
            least[root(f)] = min(least.get(root(f), i), i)
    return {(i, f): least.get(root(f)) for i, f in prints}


def test_odd_documents(odd):
    got = [(r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in simhash.near_duplicates(odd).collect()]
    prints = [(r["doc_id"], brute_fingerprint(r["text"])) for r in odd.select("doc_id", "text").collect()]
    assert sorted(((i, f) for i, f, _ in got), key=str) == sorted(prints, key=str)
    expected = brute_components(prints)
    assert all(c == expected[i, f] for i, f, c in got)


@pytest.mark.parametrize("crowd", [0, 1, 3, 64])
def test_links_reach_what_brute_force_reaches(spark, crowd):
    random.seed(crowd)
    values = set()
    for _ in range(6):  # clusters of near values, chains among them
        f = random.getrandbits(64)
        for _ in range(25):
            values.add(f)
            f ^= 1 << random.randrange(64)
            if random.random() < 0.5:
                f ^= 1 << random.randrange(32)
    values |= {0, 1, 2**63, (1 << 64) - 1, random.getrandbits(64)}
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), crowd)
    pairs = [(r["a"], r["b"]) for r in edges.collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 and a != b for a, b in pairs)
    nodes = spark.createDataFrame([(v,) for v in signed], "node long")
    roots = {r["node"]: r["root"] for r in simhash.components(nodes, edges).collect()}
    expected = brute_components([(v, v) for v in values])
    groups = {}
    for v, s in zip(values, signed, strict=True):
        groups.setdefault(expected[v, v], set()).add(roots[s])
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_no_rows(none):
    assert simhash.near_duplicates(none).collect() == []


def test_unlike_texts_of_one_id_are_decided_by_row(spark):
    text = lambda n: " ".join(f"{n}w{i}" for i in range(80))
    rows = [(3, text("a")), (7, text("a")), (7, text("b")), (8, text("c")), (8, text("d")), (8, text("d"))]
    kept = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept)) == sorted({rows[0], *rows[2:]})
