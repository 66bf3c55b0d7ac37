"""SuperMinHash groups against comparing all pairs."""

import random

import numpy as np
from cases import documents, groups, odd_texts, shingle_set

from oddglass.llm import common, graph, near_dups


def test_signature_estimates_similarity():
    r = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        both = r.integers(0, 2**63, 300).astype(np.uint64)
        x, y = np.unique(both[:250]), np.unique(both[50:])
        h = near_dups.signatures([x, y])
        errors.append((h[0] == h[1]).mean() - 200 / 300)
    assert abs(np.mean(errors)) < 0.02
    # lower than independent ranks would give
    assert np.std(errors) < (2 / 9 / 128) ** 0.5 * 1.1


def test_small_sets_fill_every_place():
    for n in (1, 2, 7, 40, 2000):
        h = near_dups.signatures([np.arange(n, dtype=np.uint64) * np.uint64(977), np.zeros(0, np.uint64)])
        assert np.isfinite(h[0]).all() and np.isinf(h[1]).all()


def check(spark, found):
    got = near_dups.groups(documents(spark, found)).collect()
    want = groups(found)
    assert len(got) == len(found)
    sizes = sorted((i is None, i or 0, len(shingle_set(t))) for i, t in found)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles) for r in got) == sizes
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
        assert r.kept == (r.doc_id is not None and r.doc_id == r.component_id)


def test_odd_rows(spark):
    check(spark, odd_texts())


def test_empty_table(spark):
    assert near_dups.groups(documents(spark, [])).count() == 0


def test_chains_families_and_shared_passages(spark, monkeypatch):
    """Families whose members reach each other only through others, and unlike texts that share a bucket."""
    monkeypatch.setattr(near_dups, "BLOCK", 8)
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    found, at = [], 100
    for _ in range(4):  # chains: each text moves on by a few words
        words = [word() for _ in range(400)]
        for k in range(12):
            found.append((at, " ".join(words[k * 9:k * 9 + 110])))
            at += r.randrange(1, 4)
    base = [word() for _ in range(80)]
    for _ in range(30):  # one passage, then own words: some pairs reach the share, some do not
        found.append((at, " ".join(base + [word() for _ in range(r.randrange(0, 60))])))
        at += 1
    r.shuffle(found)
    check(spark, found)


def test_one_mixed_group_of_thousands(spark, monkeypatch):
    """A passage stands in all texts: one group, some of whose pairs are alike; its blocks are dealt over tasks."""
    monkeypatch.setattr(near_dups, "BLOCK", 64)
    monkeypatch.setattr(near_dups, "TOGETHER", 2)
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base, tails, found = [word() for _ in range(70)], [[word() for _ in range(50)] for _ in range(25)], []
    for i in range(1200):
        tail = list(r.choice(tails)) if r.random() < 0.4 else [word() for _ in range(r.randrange(30, 60))]
        if tail and r.random() < 0.5:
            tail[r.randrange(len(tail))] = word()
        found.append((i, " ".join(base + tail)))
    check(spark, found)


def test_components(spark):
    r = random.Random(9)
    links = [(i, i + 1) for i in range(0, 60)] + [(200, 200 + k) for k in range(1, 50)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(70)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = sorted((top(a), top(b)))
        parent[q] = p
    got = {x.v: x.c for x in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {v: top(v) for v in parent if any(v in p and p[0] != p[1] for p in links)}


def test_stars_take_no_round_and_found_components_are_not_joined_anew(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(graph, "settled", lambda df: kept.append(1) or common.settled(df))
    star = [(7, k) for k in range(8, 30)] + [(3, 4), (4, 3), (5, 5), (None, 6), (6, None)]
    got = sorted((x.v, x.c) for x in graph.components(spark.createDataFrame(star, "a long, b long")).collect())
    assert got == [(3, 3), (4, 3), *[(k, 7) for k in range(7, 30)]] and len(kept) == 1
    kept.clear()
    two = [(1, 2), (2, 3), (9, 8), (8, 3)]  # one round at least
    assert {(x.v, x.c) for x in graph.components(spark.createDataFrame(two, "a long, b long")).collect()} == {(k, 1) for k in (1, 2, 3, 8, 9)} and len(kept) > 1
    kept.clear()
    words = [f"w{k}" for k in range(300)]
    check(spark, [(k, " ".join(words[9 * k:9 * k + 100])) for k in range(20)])
    assert len(kept) <= 7
