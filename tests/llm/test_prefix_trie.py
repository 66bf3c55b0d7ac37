"""The conversation trie against a plain build, the roll-up against a plain sum, odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from oddglass.llm import prefix_trie


def plain(found):
    """All nodes of (conv_id, turn, role, text) rows, by walking every rebuilt conversation."""
    own = defaultdict(list)
    for c, turn, role, text in found:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:30]
            own[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    out = {}
    for k in sorted(members, key=len, reverse=True):
        saved = (len(members[k]) - 1) * (len(k[-1][1]) if k else 0) + sum(out[x][6] for x in kids[k])
        leaves = sum(out[x][5] for x in kids[k]) or 1
        ends = ",".join(str(c) for c in sorted(c for c in members[k] if whole[c] == k))
        out[k] = (min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids[k]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def build(spark, found, **kw):
    df = spark.createDataFrame([(*f, 1, "x", 2) for f in found], "conv_id long, turn long, role string, text string, depth int, node string, conv int").repartition(3)
    return sorted([tuple(r) for r in prefix_trie.nodes(df, **kw).collect()], key=str)


def many(seed, convs=260, words=4):
    r = random.Random(seed)
    found = []
    for c in range(convs):
        for t in range(r.randrange(1, 9)):
            found.append((c, t, r.choice(["user", "assistant"]), "w" * r.randrange(words)))
    return found + [(c, t, "user", f"copy {t}") for c in range(1000, 1120) for t in range(4)]


@pytest.mark.parametrize("local", [1, 40, 8192])
def test_against_a_plain_build(spark, local):
    found = many(local)
    assert build(spark, found, local_weight=local) == plain(found)


def test_odd_rows(spark):
    found = [
        (None, 1, "user", "lost"), (100, None, "user", "null turn first"), (100, 0, None, None), (100, 0, "", ""), (100, 3, "user", "é😀"), (103, 0, "user", "a"), (103, 0, "user", "a"),
        (104, 5, "user", "x" * 50_000), (-5, 0, "user", "below zero"), (-100, 1, "user", "base below zero"), (7, 1, "us", "era"), (8, 1, "u", "sera"), (205, 0, "user", "no base"),
    ]
    assert build(spark, found) == plain(found)
    assert build(spark, [(None, 1, "a", "b")]) == [] and build(spark, []) == []


def test_one_conversation_holds_most_turns(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LONG_CONVERSATION", 50)
    monkeypatch.setattr(prefix_trie, "HOT_ROWS", 20)
    found = [(0, t // 2, "user", f"turn {t % 7}") for t in range(400)] + [(c, t, "user", f"turn {t % 7}") for c in range(1, 60) for t in range(c % 9)] + [(300 + c, 0, "user", "the same") for c in range(80)]
    assert build(spark, found, local_weight=30) == plain(found)


def test_lists_of_ids_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 60)
    found = [(c, 0, "user", "hello") for c in range(500)]
    assert build(spark, found) == plain(found)


@pytest.mark.parametrize("shape", ["chain", "star", "random", "caterpillar"])
def test_centroid_sums(shape):
    r = np.random.default_rng(3)
    n = 3000
    parent = {"chain": np.arange(n) - 1, "star": np.where(np.arange(n) > 0, 0, -1), "random": np.array([-1] + [r.integers(0, i) for i in range(1, n)]),
              "caterpillar": np.array([-1] + [max(0, i - 1 - (i - 1) % 2) for i in range(1, n)])}[shape].copy()
    parent[n // 2] = -1  # two components
    depth = np.zeros(n, dtype=np.int64)
    for i in range(n):
        depth[i] = depth[parent[i]] + 1 if parent[i] >= 0 else 0
    values = r.integers(0, 1 << 40, (n, 2))
    want, weight = values.copy(), np.ones(n, dtype=np.int64)
    for i in np.argsort(-depth, kind="stable"):
        if parent[i] >= 0:
            want[parent[i]] += want[i]
            weight[parent[i]] += weight[i]
    assert (prefix_trie.centroid_sums(parent, depth, weight, values) == want).all()
