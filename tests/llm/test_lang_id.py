"""Language profiles against a plain count, held-out accuracy, odd rows."""

import random
import re
import unicodedata
import zlib
from collections import Counter

import pytest
from cases import documents, odd_texts

from oddglass.llm import lang_id

SIZE = lang_id.SIZE


def plain_grams(text):
    low = (text or "").lower()
    kind = "".join(unicodedata.category(c)[0] if unicodedata.category(c)[0] in "LM" else " " for c in low)
    found = Counter()
    if "L" not in kind:
        return found
    for m in re.finditer(r"[LM]+", kind):
        word = f" {low[m.start():m.end()]} "
        for n in (1, 2, 3):
            found.update(g for i in range(len(word) - n + 1) if (g := word[i:i + n]) != " ")
    # A blank between two words belongs to both; pairs and triples never span it.
    return found


def profile(found):
    return [g for g, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:SIZE]]


def plain(rows):
    learned = {}
    for i, text, lang in rows:
        if lang is not None and (i is None or zlib.crc32(str(i).encode()) % 4 != 2):
            learned.setdefault(lang, Counter()).update(plain_grams(text))
    profiles = {k: {g: p for p, g in enumerate(profile(v))} for k, v in learned.items() if v}
    out = []
    for i, text, _ in rows:
        own = profile(plain_grams(text))
        held = i is not None and zlib.crc32(str(i).encode()) % 4 == 2
        if not own or not profiles:
            out.append((i, held, "und", 0.0))
            continue
        d, lang = min((sum(abs(p - q[g]) if g in q else SIZE for p, g in enumerate(own)), k) for k, q in profiles.items())
        out.append((i, held, lang, 1.0 - d / (len(own) * SIZE)))
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, t, k, "s", 0, 1.0, 1) for i, t, k in rows], "doc_id long, text string, lang string, source string, gram int, score double, place int").repartition(3)


def answer(spark, rows):
    docs = table(spark, rows)
    return sorted([(r.doc_id, r.held_out, r.lang_pred, r.score) for r in lang_id.classify(docs, lang_id.train(docs)).collect()], key=str)


def languages(n=300, seed=2):
    r = random.Random(seed)
    letters = {"aa": "abcdefghijklm", "bb": "hijklmnopqrst", "cc": "аbвгдежзик", "dd": "ابتثجحخد"}
    return [(i, " ".join("".join(r.choice(a) for _ in range(r.randrange(2, 8))) for _ in range(r.randrange(1, 40))), k) for i in range(n) for k, a in [r.choice(list(letters.items()))]]


def test_against_a_plain_count(spark):
    rows = languages() + [(1000 + (i or 0), t, random.Random(k).choice(["aa", None, "zz"])) for k, (i, t) in enumerate(odd_texts())]
    assert answer(spark, rows) == sorted(plain(rows), key=str)


def test_held_out_accuracy(spark):
    rows = languages(600, 5)
    truth = {i: k for i, _, k in rows}
    own = [r for r in answer(spark, rows) if r[1]]
    assert len(own) > 100 and sum(p == truth[i] for i, _, p, _ in own) >= 0.95 * len(own)


def test_odd_rows(spark):
    odd = [(1, None, "aa"), (2, "", "aa"), (3, "123 -- 4", "bb"), (None, "Straße à la carte", "fr"), (4, "é́ x̂y", None), (4, "é́ x̂y", None), (5, "İstanbul ΣΑΣ", "tr"), (6, "퟿ 漢字かな 한국어", "ja"), (7, "a" * 5000, "aa")]
    assert answer(spark, odd) == sorted(plain(odd), key=str)
    nothing = [(1, "words", None), (2, "", "aa"), (3, None, "bb")]
    assert {r[2:] for r in answer(spark, nothing)} == {("und", 0.0)}
    assert answer(spark, []) == []


@pytest.mark.parametrize("stretch", [1, 2, 3, 7])
def test_long_texts_in_stretches(monkeypatch, stretch):
    text = odd_texts()[9][1] + " ab  c--d é́f " * 20
    whole = lang_id.grams(text)
    monkeypatch.setattr(lang_id, "STRETCH", stretch)
    parts = lang_id.grams(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    assert {lang_id.spell(k): n for k, n in zip(whole[0].tolist(), whole[1].tolist())} == plain_grams(text)


def test_task_flushes_lose_nothing(spark, monkeypatch):
    rows = languages(80)
    docs = table(spark, rows)
    want = {(r.lang, r.gram): r.n for r in lang_id.counts(docs).collect()}
    monkeypatch.setattr(lang_id, "GATHERED", 50)
    assert {(r.lang, r.gram): r.n for r in lang_id.counts(docs).collect()} == want
    assert documents(spark, []).count() == 0
