"""Counts and base score by brute force; the mixture as a distribution and against a plain computation."""

import math
import random
import zlib
from collections import Counter

import numpy as np
from cases import LOWER, WORD, documents, odd_texts

from oddglass.llm import lm


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 10 == 0


def check(spark, found):
    got = lm.score(documents(spark, found)).collect()
    tokens = [(i, [*WORD.findall((t or "").translate(LOWER)), None]) for i, t in found]
    counts = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((i is None, i or 0, held(i), len(ws), sum(counts[w] > 0 for w in ws), n) for i, ws in tokens)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got) == want
    base = sorted(round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6) for _, ws in tokens)
    assert np.allclose(sorted(round(r.base_score, 6) for r in got), base)
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    return got


def test_odd_rows(spark):
    check(spark, odd_texts())


def test_no_training_row(spark):
    only = [(i, "some words") for i in range(2000) if held(i)][:3]
    check(spark, only)
    assert lm.score(documents(spark, [])).count() == 0


def test_better_than_single_words(spark):
    r = random.Random(2)
    words = [f"w{k}" for k in range(40)]
    after = {w: r.sample(words, 3) for w in words}

    def text():
        out = [r.choice(words)]
        while len(out) < 80:
            out.append(r.choice(after[out[-1]]))
        return " ".join(out)

    got = check(spark, [(i, text()) for i in range(300)])
    own = [x for x in got if x.held_out]
    assert sum(x.score for x in own) > 0.5 * sum(x.base_score for x in own)  # both are negative


def plain_scores(found):
    """The mixture, token by token: every training token deleted in turn, weights by context level from plain EM."""
    docs = [(i, [*WORD.findall((t or "").translate(LOWER)), None]) for i, t in found]
    trained = [ws for i, ws in docs if not held(i)]
    one, two = Counter(w for ws in trained for w in ws), Counter((a, w) for ws in trained for a, w in zip(["<start>", *ws], ws))
    n, v = sum(one.values()), len(one)
    context = lambda a: len(trained) if a == "<start>" else one[a]
    start = {k: [0.1, 0.4, 0.5] if k else [0.2, 0.8, 0.0] for k in range(lm.LEVELS)}
    weight = dict(start)
    seen = [((context(a) - 1).bit_length(), [1 / (v + 1), (one[w] - 1) / max(n - 1, 1), (two[a, w] - 1) / max(context(a) - 1, 1)]) for ws in trained for a, w in zip(["<start>", *ws], ws)]
    for _ in range(lm.ROUNDS):
        got = {k: [x / 2 for x in start[k]] for k in start}
        for k, share in seen:
            part = [x * y for x, y in zip(weight[k], share)]
            for j in range(3):
                got[k][j] += part[j] / sum(part)
        got[0][2] = 0.0
        weight = {k: [x / sum(g) for x in g] for k, g in got.items()}
    return [(i, sum(math.log10(sum(x * y for x, y in zip(weight[context(a).bit_length()], [1 / (v + 1), one[w] / max(n, 1), two[a, w] / max(context(a), 1)]))) for a, w in zip(["<start>", *ws], ws))) for i, ws in docs]


def test_scores_against_a_plain_mixture(spark):
    """The grid of estimates that the tasks add up moves a score by less than half a percent."""
    r = random.Random(8)
    words = [f"w{int(r.paretovariate(0.8)) % 300}" for _ in range(6000)]
    found = [(i, " ".join(words[k:k + r.randrange(1, 60)])) for i, k in enumerate(range(0, 5900, 25))] + [(5000 + k, t) for k, (_, t) in enumerate(odd_texts())]
    got = {x.doc_id: x.score for x in check(spark, found)}
    assert all(math.isclose(got[i], want, rel_tol=5e-3, abs_tol=5e-3) for i, want in plain_scores(found))


def test_mixture_sums_to_one():
    w = lm.weights(np.array([[3, 50, 20.0, 5.0], [0, 7, 0.0, 1.0], [1, 9, 0.0, 0.4]]), 30)
    assert np.allclose(w.sum(1), 1) and w[0, 2] == 0
    assert np.allclose(lm.level(np.array([0, 1, 2, 3, 4, 1023, 1024])), [0, 1, 2, 2, 3, 10, 11])


def test_expectation_maximisation_climbs():
    r = np.random.default_rng(1)
    two, one = r.random(200), r.random(200)
    cells = np.column_stack([np.full(200, 4), np.ones(200), two, one])
    like = lambda w: np.log(w[4] @ np.stack([np.full(200, 1 / 6), one, two])).sum()
    found = [like(lm.weights(cells, 5, k)) for k in (1, 3, 10, 40)]
    assert all(b >= a - 1e-3 for a, b in zip(found, found[1:]))
