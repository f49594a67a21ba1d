"""Conversation tries against a plain dictionary, at every split between shards and heavy levels."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from folioforge.llm import trie
from folioforge.llm.common import materialize

CONV = "conv_id long, turn long, role string, text string, depth string, h1 int"


def plain(rows, rebuild):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(x[1], x[3]) for x in sorted(v)] for c, v in own.items()}
    if rebuild:
        cut = {c: zlib.crc32(str(c).encode()) % 6 for c in turns}
        turns = {c: turns.get(c - c % 100, [])[: cut[c]] + t[cut[c] :] for c, t in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in sorted(turns.items()):
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
        ends[tuple(t)].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    out, rolled = [], {}
    for node in sorted(members, key=len, reverse=True):
        below = [rolled[k] for k in kids[node]]
        saved = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(b[1] for b in below)
        rolled[node] = (sum(b[0] for b in below) or 1, saved)
        sha = hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids[node]), *rolled[node], sha))
    return sorted(out, key=str)


def made(seed, n=140):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        length = rng.choice((0, 1, 2, 4, 9)) if c % 100 else rng.randrange(3, 8)
        for t in range(length):
            rows.append((c + 100 * (c % 3), t, rng.choice(("user", "bot", None)), rng.choice(("hi", "", None, "é日本", "go on")) if t else "hello", "x", 1))
    rows += [(7000 + c, t, "user", f"same {t}", None, None) for c in range(40) for t in range(6)]
    rows += [(8000, t, "user", f"long {t % 7}", None, 0) for t in range(90)] + [(8001, t, "user", f"long {t % 7}", None, 0) for t in range(70)]
    rows += [(None, 0, "user", "nobody", None, None), (9000, None, "a", "b", None, 1), (9000, None, "a", "b", None, 1), (9000, 0, "a", "b", None, 1), (9000, 0, "a", "a", None, 1), (123456789012, 5, "ab", "c", "", 2), (123456789013, 5, "a", "bc", "", 2)]
    rng.shuffle(rows)
    return rows


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("shard, block", [(1, 3), (60, 4), (10**6, 10_000)])
def test_trie(spark, monkeypatch, shard, block):
    monkeypatch.setattr(trie, "BLOCK", block)
    rows = made(shard)
    df = materialize(spark.createDataFrame(rows, CONV).repartition(5), "conversations")
    assert result(trie.conversation_trie(df, shard_turns=shard)) == plain(rows, False)


def test_rebuilt(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 5)
    rows = made(9)
    df = materialize(spark.createDataFrame(rows, CONV).repartition(3), "conversations")
    assert result(trie.prefix_trie(*trie.rebuilt(trie.numbered(df)), shard_turns=30)) == plain(rows, True)


def test_without_rows(spark):
    assert trie.conversation_trie(spark.createDataFrame([], CONV)).count() == 0
    assert trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b", None, 1)], CONV)).count() == 0


def test_louds():
    #      0        6
    #    1   2      7
    #   3 4   5
    parent = np.array([-1, 0, 0, 1, 1, 2, -1, 6])
    level = np.array([0, 1, 1, 2, 2, 2, 0, 1])
    t = trie.Louds(level, parent, np.stack([np.array([5, 1, 2, 3, 4, 5, 9, 7])] * 2, axis=1))
    assert "".join("01"[int(b)] for b in t.bits) == "110" + "110" + "10" + "110" + "10" + "0" + "0" * 3
    assert t.order.tolist() == [0, 6, 1, 2, 7, 3, 4, 5] and t.labels[:, 0].tolist() == [5, 9, 1, 2, 7, 3, 4, 5]
    assert t.parents().tolist() == [-1, -1, 0, 0, 1, 2, 2, 3] and t.degrees().tolist() == [2, 1, 2, 1, 0, 0, 0, 0]
    ones = np.ones(8, np.int64)
    t.roll_up(ones)
    assert ones.tolist() == [6, 2, 3, 2, 1, 1, 1, 1]
    rng = random.Random(3)
    parent = np.array([-1] + [rng.randrange(k) for k in range(1, 300)])
    level = np.zeros(300, np.int64)
    for k in range(1, 300):
        level[k] = level[parent[k]] + 1
    t = trie.Louds(level, parent, np.stack([np.arange(300), np.arange(300)], axis=1))
    place = {int(r): i for i, r in enumerate(t.order)}
    assert [t.parents()[place[k]] for k in range(300)] == [-1 if k == 0 else place[int(parent[k])] for k in range(300)]
    sizes = np.ones(300, np.int64)
    t.roll_up(sizes)
    assert sizes[0] == 300


def test_a_long_conversation_is_dealt_over_tasks(spark):
    df = spark.range(30_000).selectExpr("cast(1 as bigint) AS conv_id", "id AS turn", "'user' AS role", "cast(id AS string) AS text")
    turns = trie.numbered(df)
    assert [r[0] for r in turns.selectExpr("count(DISTINCT pos)", "min(pos)", "max(pos)").collect()] == [30_000]
    out = trie.prefix_trie(turns, turns.where("pos = 1").select("conv", "total"), shard_turns=7_000)
    assert out.selectExpr("count(*)", "max(depth)", "sum(n_leaves)", "sum(n_children)", "count(parent_conv_id)").collect()[0] == (30_001, 30_000, 30_001, 30_000, 30_000)
