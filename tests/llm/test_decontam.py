"""Tiling against a plain greedy search, and contaminated documents."""

import random

import numpy as np
from cases import PLAIN, documents, odd_texts

from oddglass.llm import decontam


def plain_tiles(doc, item, least):
    """The longest common unmarked run, again and again, by comparing all starts."""
    a, b, total = [False] * len(doc), [False] * len(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and doc[i + n] >= 0 and not a[i + n] and not b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return sorted(total)
        a[i:i + n] = [True] * n
        b[j:j + n] = [True] * n
        total.append(n)


def test_tiles_match_plain_search():
    r = random.Random(6)
    for _ in range(60):
        item = [r.randrange(30) for _ in range(r.randrange(5, 60))]
        k = r.randrange(len(item))
        doc = [r.randrange(-1, 30) for _ in range(20)] + item[k:] + [-1] + item[:k] + item[:8]
        got = decontam.tiles(np.array(doc), np.array(item), 4)
        assert sorted(t[2] for t in got) == plain_tiles(doc, item, 4)
        for d, i, n in got:
            assert doc[d:d + n] == item[i:i + n]


def benchmark(spark, found):
    return spark.createDataFrame([(i, t, 1, 1.0) for i, t in found], "item_id long, text string, doc_id int, coverage double")


def test_moved_and_partial_passages(spark):
    w = PLAIN.split()
    docs = documents(spark, [
        (1, "before " + PLAIN + " after"), (2, " ".join([*w[12:], "x", *w[:12]])), (3, " ".join(w[:8])), (4, PLAIN.upper().replace(" ", "!! ")), (5, "nothing of it at all here"),
        (6, None), (7, ""), (None, PLAIN), (8, " ".join(w[:13])), (1, "before " + PLAIN + " after"), (9, "z " * 30000 + PLAIN)])
    items = benchmark(spark, [(70, PLAIN), (71, None), (72, ""), (73, "four words are few"), (None, PLAIN), (74, PLAIN)])
    got = sorted((r.doc_id or 0, r.item_id) for r in decontam.overlaps(docs, items).collect())
    assert got == sorted((d, i) for d in (0, 1, 1, 2, 4, 8, 9) for i in (70, 74))
    assert sorted(got) == sorted((r.doc_id or 0, r.item_id) for r in decontam.overlaps(docs, items, block_chars=50).collect())
    left = decontam.clean(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [3, 5, 6, 7]


def test_empty_tables(spark):
    assert decontam.overlaps(documents(spark, []), benchmark(spark, [(1, PLAIN)])).count() == 0
    assert decontam.overlaps(documents(spark), benchmark(spark, [])).count() == 0
    assert decontam.clean(documents(spark), benchmark(spark, [])).count() == len(odd_texts())


def test_texts_that_repeat_themselves():
    """Equal and periodic words: the same tiles as before in a fraction of the pairs, and in bounded time."""
    import time

    start = time.time()
    assert sum(n for *_, n in decontam.tiles(np.zeros(20_000, np.int64), np.zeros(1_000, np.int64))) == 1_000
    assert sum(n for *_, n in decontam.tiles(np.arange(20_000) % 7, np.arange(1_000) % 7)) == 1_000
    assert time.time() - start < 6
