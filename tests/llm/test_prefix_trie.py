import hashlib
import math
import random
import re
import zlib

import duckdb
import pytest

from quarrymill.llm import prefix_trie, queries
from quarrymill.sources import read_table


def plain(rows):
    """The nodes, by dictionaries of whole prefixes."""
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    turns = {c: [(role, text) for *_, role, text in sorted(v)] for c, v in turns.items()}
    members = {}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = turns.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
        for d in range(len(paths[c]) + 1):
            members.setdefault(tuple(paths[c][:d]), []).append(c)
    children, below = {}, {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        under = [below[c] for c in children.get(node, [])]
        below[node] = ((len(members[node]) - 1) * words + sum(u[0] for u in under), sum(u[1] for u in under) if under else 1)
    out = []
    for node, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if len(paths[c]) == len(node))))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children.get(node, [])), below[node][1], below[node][0], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(1)
    found = [(None, 1, "user", "nobody's"), (3, None, None, None), (3, None, None, None), (2**40, 0, "user", "far"), (2**40 + 1, 0, "user", "far")]
    for conv in range(-45, 80):
        if draw.random() < 0.9:
            found += [(conv, draw.choice([turn, turn, turn, None, 1]), draw.choice(["user", None]), draw.choice(["a b", "c", "", None, "a\x0bb  d", "é 😀 ▁"])) for turn in range(draw.choice([1, 1, 2, 3, 5, 8]))]
    return found


def frame(spark, rows):
    clash = [(*r, 1, 2, "x", "y") for r in rows]
    return spark.createDataFrame(clash, "conv_id long, turn long, role string, text string, place long, depth int, digest string, len string").repartition(3)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_equals_dictionaries_of_prefixes(spark, rows):
    assert got(prefix_trie.prefix_trie(frame(spark, rows))) == plain(rows)


def test_long_conversations_go_in_blocks_and_crowded_nodes_by_broadcast(spark, rows, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STEP", 2)
    monkeypatch.setattr(prefix_trie, "CROWD", 3)
    want = plain(rows)
    assert got(prefix_trie.prefix_trie(frame(spark, rows))) == want
    monkeypatch.setattr(prefix_trie, "BROADCAST_ROWS", 0)
    assert got(prefix_trie.prefix_trie(frame(spark, rows))) == want


def test_one_long_conversation_and_many_copies(spark):
    rows = [(40, t, "user", f"turn {t % 7} of it") for t in range(30_000)] + [(c, t, "user", f"turn {t}") for c in range(1000, 1400) for t in range(3)]
    out = prefix_trie.prefix_trie(frame(spark, rows)).cache()
    deep = out.where("depth > 5").collect()
    assert len(deep) == 29_995 and {(r["conv_id"], r["n_convs"], r["n_leaves"], r["saved_tokens"]) for r in deep} == {(40, 1, 1, 0)}
    short = plain([r for r in rows if r[0] != 40 or r[1] < 5])
    other = hashlib.sha256(b"").hexdigest()
    assert got(out.where("depth <= 5")) == sorted([r if r[:2] != (40, 5) else (*r[:4], 1, 1, 0, other) for r in short], key=str)


def test_conversations_without_turns_of_their_own_are_members_of_the_root(spark):
    # crc32('1') % 4 = 3 takes all of its turns, and there is no conversation 0
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b")]
    assert zlib.crc32(b"1") % 4 == 3
    assert got(prefix_trie.prefix_trie(frame(spark, rows))) == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())] == plain(rows)


def test_no_rows(spark, rows):
    assert prefix_trie.prefix_trie(frame(spark, rows).where("false")).collect() == []
    assert prefix_trie.prefix_trie(frame(spark, rows).where("conv_id is null")).collect() == []


def test_ends_of_a_large_node_stream_in_order(spark):
    ids = [*range(-3, 70_000, 7), 2**50]
    ends = spark.createDataFrame([(1, 2, 3, c) for c in ids], "k1 long, k2 long, depth long, conv_id long").repartition(5)
    assert [tuple(r) for r in prefix_trie.digests(ends).collect()] == [(1, 2, 3, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())]


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    out = queries.op11_prefix_trie(spark, sf_dir)
    want = con.execute(queries.ORACLE_SQL["op11_prefix_trie"])
    assert out.columns == [d[0] for d in want.description]
    assert got(out) == sorted(want.fetchall(), key=str) == plain([tuple(r) for r in read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()])
