"""Encoding against the tokenizers library."""

import hashlib
import random

import public_tokenizers
from cases import documents, odd_texts
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from oddglass.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
REFERENCE = Tokenizer.from_file(PATH)
CODEC, DECODER = bpe.Encoder(open(PATH, "rb").read()), bpe.Decoder(open(PATH, "rb").read())


def ids(text):
    return REFERENCE.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    found = CODEC.encode([text])[0].tolist()
    assert found == ids(text)
    assert DECODER.decode(found) == text


def test_awkward_texts():
    r = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "é", "1", "\t", "<|endoftext|>", "'s", "'ll", "the", "\x1c", "　", "😀", "\r\n", "ƀ", "²"]
    made = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(3000)] + ["a" * 20000, "ab" * 9000, " " * 5000]
    for text, found in zip(made, CODEC.encode(made)):
        assert found.tolist() == ids(text)


def test_kept_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 10)
    c = bpe.Encoder(open(PATH, "rb").read())
    for k in range(6):
        text = " ".join(f"w{k}x{j}" for j in range(30))
        assert c.encode([text])[0].tolist() == ids(text)


def test_unknown_ids_decode_to_nothing():
    assert DECODER.decode([*ids("one"), 10**6, -3, *ids(" two")]) == "one two"


def test_whole_table(spark):
    got = {}
    for r in bpe.digest(documents(spark), PATH).collect():
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_sha256, r.decoded_sha256))
    want = {}
    for i, t in odd_texts():
        x = ids(t or "")
        want.setdefault(i, []).append((len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert bpe.digest(documents(spark, []), PATH).count() == 0


def test_one_pass_equals_two(spark):
    docs = documents(spark)
    two = sorted((r.doc_id or 0, r.ids, r.decoded) for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect())
    assert two == sorted((r.doc_id or 0, r.ids, r.decoded) for r in bpe.round_trip(docs, PATH).collect())
