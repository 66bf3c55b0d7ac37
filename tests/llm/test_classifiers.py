"""Quality and toxicity: held-out accuracy, odd rows, missing labels."""

import random
import zlib

import numpy as np
import pytest
from cases import documents, odd_texts

from oddglass.llm import quality, toxicity

BAD = ["idiot", "moron", "trash"]


def corpus(n=500, seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(400)]
    docs, toxic, good = [], [], []
    for i in range(n):
        own = [r.choice(words) for _ in range(r.randrange(20, 90))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                own.insert(r.randrange(len(own)), r.choice(BAD).upper() + "!")
        junk = i % 3 == 0
        text = " | ".join(own) if junk else " ".join(own)
        docs.append((i, text))
        toxic.append(int(bad))
        good.append(int(not junk))
    return docs, toxic, good


def labels(spark, docs, toxic, good):
    made = [(i, q, t, "x") for (i, _), t, q in zip(docs, toxic, good)] + [(None, 1, 1, "x"), (10**6, None, None, "x"), (0, good[0], toxic[0], "x")]
    return spark.createDataFrame(made, "doc_id long, quality int, toxic int, text string")


@pytest.mark.parametrize("module, which", [(toxicity, 1), (quality, 2)])
def test_held_out_rows(spark, module, which):
    made = corpus()
    docs = documents(spark, made[0] + odd_texts()[:0])
    got = module.classify(docs, labels(spark, *made)).collect()
    assert len(got) == len(made[0])
    truth = {i: made[which][i] for i, _ in made[0]}
    own = [r for r in got if r.held_out]
    assert len(own) > 60
    assert np.mean([r.predicted == truth[r.doc_id] for r in own]) > 0.93
    assert all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows_and_no_labels(spark, module):
    docs = documents(spark)
    none = labels(spark, [], [], [0]).where("1 = 0") if False else spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = module.classify(docs, none).collect()
    assert len(got) == len(odd_texts()) and len({r.score for r in got}) == 1
    one_class = spark.createDataFrame([(i, 1, 0) for i, _ in odd_texts() if i], "doc_id long, quality int, toxic int")
    assert module.classify(docs, one_class).count() == len(odd_texts())
    assert module.classify(documents(spark, []), none).count() == 0


@pytest.mark.parametrize("module, which", [(toxicity, 1), (quality, 2)])
def test_text_alone_decides(spark, module, which):
    """Equal texts have equal scores, whatever their other columns; odd texts are scored too."""
    made = corpus(200, 3)
    docs = documents(spark, made[0] + [(1000 + i, t) for i, (_, t) in enumerate(odd_texts())])
    got = {r.doc_id: r.score for r in module.classify(docs, labels(spark, *made)).collect()}
    odd = odd_texts()
    assert got[1000] == got[1001] and got[1004] == got[1005]
    assert all(0 <= got[1000 + i] <= 1 for i in range(len(odd)))


def plain_toxicity(model, text):
    """One text through the network, window by window and filter by filter."""
    words = toxicity.WORDS.findall((text or "").lower())
    row = [int(model.remap[zlib.crc32(w.encode("utf-8", "replace")) & ((1 << toxicity.BITS) - 1)]) for w in words] or [toxicity.PAD]
    total = model.offset
    k = 0
    for own, bias in zip(model.filters, model.bias):
        for f in range(len(bias)):
            best = max(sum(float(model.embedding[row[at + j] if at + j < len(row) else toxicity.PAD] @ tap[:, f]) for j, tap in enumerate(own)) for at in range(len(row)))
            total += max(best + float(bias[f]), 0.0) * float(model.weights[k])
            k += 1
    language = int(np.argmax(sum(model.languages[r].astype(float) for r in row)))
    return 1 / (1 + np.exp(-(total - model.thresholds[language])))


def test_scores_against_the_plain_network(spark):
    made = corpus(240, 5)
    every = made[0][:60] + [(1000 + i, t) for i, (_, t) in enumerate(odd_texts()) if i not in (11, 12)]
    model = toxicity.train(documents(spark, made[0]), labels(spark, *made))
    got = {r.doc_id: r.score for r in toxicity.score(documents(spark, every), model).collect()}
    assert all(abs(got[i] - plain_toxicity(model, t)) < 1e-4 for i, t in every)


def test_windows_do_not_cross_documents():
    flat, starts, gaps = toxicity._laid_out([np.array([5, 6]), np.zeros(0, np.int64), np.array([7])])
    assert flat[starts].tolist() == [5, toxicity.PAD, 7] and len(gaps) == 6
    assert set(flat[gaps].tolist()) == {toxicity.PAD}


def test_dictionary_shares_come_from_all_texts():
    texts = [chr(65 + i % 26) * 400 + f" {i} " + "end of the text " * 100 for i in range(600)]
    distance = sum(map(len, texts)) // (quality.DICTIONARY // (quality.SHARE + 1))
    drawn = [(7919 * i, k, part) for i, t in enumerate(texts) for k, part in enumerate(quality.shares(t, 7919 * i, distance))]
    assert len({i for i, _, _ in drawn}) > 150 and sum(bytes([65 + i]) * 50 in quality.dictionary(drawn) for i in range(26)) > 8
    assert 0.8 * quality.DICTIONARY < len(quality.dictionary(drawn)) <= quality.DICTIONARY
    assert quality.shares("short", 3, 0) == [b"short"] and quality.shares("", 3, 0) == [b""] and quality.shares("", 3, 600) == []
    long = quality.shares("x" * 300_000, 5, 600)
    assert len(long) == 500 and all(len(p) <= quality.SHARE for p in long)


def plain_differences(model, docs):
    """Sizes of every block with each dictionary, compressed one by one."""
    import zstandard as zstd

    def size(text, block):
        d = zstd.ZstdCompressionDict(text, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        return len(zstd.ZstdCompressor(level=quality.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress(block))

    out = []
    for raw in (t.encode("utf-8", "replace") for t in docs):
        blocks = [raw[at:at + quality.BLOCK] for at in range(0, len(raw), quality.BLOCK)]
        out.append(sum(size(model.bad, b) - size(model.good, b) for b in blocks) / max(1, len(raw)))
    return out


def test_scores_are_a_curve_of_the_size_difference(spark):
    """Every score of the query is the calibrated curve at the plainly computed difference, and rises with it."""
    made = corpus(400, 7)
    every = made[0] + [(1000 + i, t) for i, (_, t) in enumerate(odd_texts())]
    docs = documents(spark, every)
    model = quality.train(docs, labels(spark, *made))
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    want = plain_differences(model, [t or "" for _, t in every])
    a, b, c = model.curve
    assert all(abs(got[i] - 1 / (1 + np.exp(-(a + b * d * 10 + c * max(d, 0) * 10)))) < 1e-9 for (i, _), d in zip(every, want))
    order = np.argsort(want)
    rising = np.array([got[every[i][0]] for i in order])
    assert b >= 0 and b + c > 0 and (np.diff(rising) >= -1e-12).all()


def test_very_long_labelled_texts_stay_in_the_tasks(spark):
    made = corpus(120, 9)
    docs = [(i, t * 4000 if i % 20 == 0 else t) for i, t in made[0]]
    got = quality.classify(documents(spark, docs), labels(spark, docs, made[1], made[2])).collect()
    assert len(got) == 120 and np.mean([r.predicted == made[2][r.doc_id] for r in got]) > 0.85


def test_the_sample_is_bounded_in_words(spark, monkeypatch):
    made = corpus(160, 11)
    docs = [(i, t * 3000 if i == 3 else t) for i, t in made[0]]
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda ids, label, lang: seen.append(sum(map(len, ids))) or len(ids))
    assert toxicity.train(documents(spark, docs), labels(spark, docs, made[1], made[2]), words=5_000) < 160 and 3_000 < seen[0] <= 5_000


def test_the_driver_hands_back_what_the_fit_took(spark, monkeypatch):
    docs, toxic, _ = corpus(60, 3)
    after = []
    monkeypatch.setattr(toxicity, "fit", lambda *a: after.append("fit") or "model")
    monkeypatch.setattr(toxicity, "release", lambda: after.append("release"), raising=False)
    labels = spark.createDataFrame([(i, t) for (i, _), t in zip(docs, toxic)], "doc_id long, toxic int")
    assert toxicity.train(documents(spark, docs), labels) == "model" and after == ["fit", "release"]


def test_all_labelled_rows_reach_the_fit(spark, monkeypatch):
    docs = spark.range(10_500).selectExpr("id AS doc_id", "concat('word', id, ' and more') AS text", "'en' AS lang").repartition(3)
    twice = docs.unionAll(docs.limit(50)).unionAll(spark.createDataFrame([(None, "lost", "en")], "doc_id long, text string, lang string"))
    labels = spark.range(10_500).selectExpr("id AS doc_id", "cast(id % 5 = 0 AS int) AS toxic")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda ids, label, lang: seen.append((len(ids), sum(map(len, ids)), label)))
    toxicity.train(twice, labels)
    own = [i for i in range(10_500) if zlib.crc32(str(i).encode()) % 5]
    assert len(own) > 8_000 and seen == [(len(own), 3 * len(own), sum(i % 5 == 0 for i in own))]


def test_fit_over_several_shards(spark, monkeypatch):
    """Rows dealt to shards are all learned from, and held-out rows are told apart as by one shard alone."""
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 250)
    monkeypatch.setattr(toxicity, "PART", 100)
    made = corpus(1200, 13)
    docs, own = documents(spark, made[0]), labels(spark, *made)
    got = [r for r in toxicity.classify(docs, own).collect() if r.held_out]
    assert np.mean([r.predicted == made[1][r.doc_id] for r in got]) > 0.93 and len(got) > 150
    model = toxicity.train(docs, own)
    assert all(abs(r.score - plain_toxicity(model, made[0][r.doc_id][1])) < 1e-4 for r in got[:20])


def test_the_strongest_answers_and_where_they_start():
    r = np.random.default_rng(2)
    parts = [r.integers(2, 900, n) for n in (5, 0, 9_000, 1, 300, 4_500, 2)]
    flat, starts, gaps = toxicity._laid_out(parts)
    taps = [[r.normal(size=(900, 4)) for _ in range(w)] for w in toxicity.WIDTHS]
    bests, spots = toxicity._strongest(taps, flat, starts, gaps)
    for own, best, spot in zip(taps, bests, spots):
        for d, part in enumerate(parts):
            at = np.arange(max(1, len(part))) + starts[d]
            every = sum(own[k][flat[at + k]] for k in range(len(own)))
            assert np.allclose(best[d], every.max(0)) and (spot[d] == every.argmax(0) + starts[d]).all()
