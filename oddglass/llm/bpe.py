"""Byte-pair encoding and decoding by dynamic programming over prefixes.

For every prefix of a piece exactly one vocabulary token can end its encoding. An automaton
over the vocabulary names all tokens that are suffixes of the prefix; of them the right one is
the one that may follow the last token of the prefix before it. Whether a token may follow
another is a test on the pair alone: undo the merges that made both, latest first, and see if
an earlier merge would have crossed the border. The stored last tokens are then followed back
from the end. Time is linear in the text, also for one endless word.

Null and empty texts have no ids. Ids outside the vocabulary decode to nothing, as the
tokenizers library does it. Rows are kept one for one, repeated rows and null ids included.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lists, map_texts, narrow, rows, texts

# The byte-level split pattern of the vocabulary file's format. White space is
# the Unicode property, which does not hold the separators U+001C to U+001F.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?![^\p{White_Space}])|\p{White_Space}+"
# The same for texts below U+0180, where the classes can be written out.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
LATIN = rf" ?[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Pieces kept per worker, the longest kept piece, and pair tests kept per worker.
KEPT_PIECES, KEPT_LENGTH, KEPT_PAIRS = 150_000, 48, 150_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the file: itself if visible, else from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


class Decoder:
    """One vocabulary's byte strings, by id."""

    def __init__(self, source: bytes):
        spec = json.loads(source)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        table = {i: bytes(byte_of[c] for c in name) for name, i in spec["model"]["vocab"].items()}
        table |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
        self.table = [table.get(i, b"") for i in range(max(table, default=-1) + 1)]

    def decode(self, ids: list[int]) -> str:
        top = len(self.table)
        try:
            raw = b"".join(map(self.table.__getitem__, ids)) if min(ids, default=0) >= 0 else None
        except IndexError:
            raw = None
        if raw is None:
            raw = b"".join(self.table[i] for i in ids if 0 <= i < top)
        return raw.decode("utf-8", "replace")


class Encoder:
    """One vocabulary's merges: ranks, automaton and pair tests."""

    def __init__(self, source: bytes):
        import ahocorasick

        spec = json.loads(source)
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        letters = byte_letters()
        self.letters = {b: letters[b] for b in range(256)}
        # inside, a token is its rank: bytes first, then merges in their order
        names = letters + ["".join(m) for m in merges]
        rank = {name: r for r, name in enumerate(names)}
        self.halves = [(-1, -1)] * 256 + [(rank[a], rank[b]) for a, b in merges]
        self.merged = {pair: r for r, pair in enumerate(self.halves) if r >= 256}
        self.ids = [vocab[name] for name in names]
        self.automaton = ahocorasick.Automaton()
        for name, r in rank.items():
            self.automaton.add_word(name, (r, len(name)))
        self.automaton.make_automaton()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split, self.latin, self.beyond = regex.compile(SPLIT), re.compile(LATIN), re.compile(r"[^\x00-\u017f]")
        self.pairs: dict[int, bool] = {}  # left rank, 20 bits of right rank
        self.kept: dict[str | tuple[str], bytes] = {}

    def may_follow(self, left: int, right: int) -> bool:
        """Would the merges leave ``left`` and ``right`` beside each other? The answer is kept in ``pairs``."""
        a, b, before, good = left, right, len(self.halves), True
        while True:
            if self.merged.get((a, b), before) < before:
                good = False
                break
            if max(a, b) < 256:
                break
            if a > b:  # the later merge is undone; what was merged until then stands
                before, a = a, self.halves[a][1]
            else:  # an equal merge further left goes first
                before, b = b + 1, self.halves[b][0]
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        self.pairs[left << 20 | right] = good
        return good

    def encode_pieces(self, pieces: list[str]) -> None:
        """Keep the ids of pieces. In sorted order a piece shares its first prefixes with the one before it."""
        former, last, size_of = "", [], []
        matches, known = self.automaton.iter, self.pairs.get
        for piece in sorted(pieces):
            name = piece.encode("utf-8", "replace").decode("latin-1").translate(self.letters)
            shared, most = 0, min(len(name), len(former))
            while shared < most and name[shared] == former[shared]:
                shared += 1
            rest = len(name) - shared
            last[shared:] = [-1] * rest
            size_of[shared:] = [0] * rest
            for end, (token, size) in matches(name):
                if last[end] < 0:
                    before = end - size
                    if before < 0:
                        last[end], size_of[end] = token, size
                    elif (left := last[before]) >= 0:
                        good = known(left << 20 | token)
                        if self.may_follow(left, token) if good is None else good:
                            last[end], size_of[end] = token, size
            out, at = [], len(name) - 1
            while at >= 0:
                out.append(self.ids[last[at]])
                at -= size_of[at]
            self.kept[piece] = array("i", reversed(out)).tobytes()
            former = name

    def split_text(self, text: str) -> list[str]:
        return (self.split if self.beyond.search(text) else self.latin).findall(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        parts = []
        for text in texts:
            if self.special_split is not None and any(s in text for s in self.special):
                own = self.special_split.split(text)  # every second part is a special token
                parts.append([x for n, part in enumerate(own) for x in ([(part,)] if n % 2 else self.split_text(part))])
            else:
                parts.append(self.split_text(text))
        needed = set(chain.from_iterable(parts))
        marks = {x for x in needed if type(x) is tuple}
        needed -= marks
        new = [x for x in needed if x not in self.kept]
        if len(self.kept) + len(new) > KEPT_PIECES:
            self.kept.clear()
            new = list(needed)
        self.encode_pieces(new)
        kept = self.kept
        for mark in marks:
            kept[mark] = array("i", [self.special[mark[0]]]).tobytes()
        out = [np.frombuffer(b"".join(map(kept.__getitem__, part)), dtype=np.int32) for part in parts]
        for long in [*marks, *(x for x in new if len(x) > KEPT_LENGTH)]:
            del kept[long]
        return out


@functools.lru_cache(maxsize=1)
def encoder(source: bytes) -> Encoder:
    return Encoder(source)


@functools.lru_cache(maxsize=1)
def decoder(source: bytes) -> Decoder:
    return Decoder(source)


def _source(df: DataFrame, vocabulary: str):
    """The vocabulary file, read once by the driver and sent once to each executor (a file of a few MB)."""
    with open(vocabulary, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) -> (doc_id, ids array<int>): the ids of each whole text."""
    source = _source(df, vocabulary)

    def run(batch: pa.RecordBatch):
        found = encoder(source.value).encode(texts(batch))
        return rows(doc_id=batch.column("doc_id"), ids=lists(np.concatenate(found), np.array([len(x) for x in found])))

    return map_texts(narrow(df.withColumnsRenamed({id_col: "doc_id", text_col: "text"}), doc_id="long", text="string"), run, "doc_id long, ids array<int>")


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids) -> (doc_id, ids, decoded string)."""
    source = _source(df, vocabulary)

    def run(batches):
        for whole in batches:
            d = decoder(source.value)
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids = batch.column("ids")
                flat, ends = ids.flatten().to_numpy(zero_copy_only=False), np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                yield rows(doc_id=batch.column("doc_id"), ids=ids, decoded=pa.array([d.decode(x.tolist()) for x in np.split(flat, ends[:-1])], pa.string()))

    return narrow(df.withColumnsRenamed({id_col: "doc_id", ids_col: "ids"}), doc_id="long", ids="array<int>").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def round_trip(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) -> (doc_id, ids, decoded): ``decode`` of ``encode`` in one pass, so that the ids reach one worker only."""
    source = _source(df, vocabulary)

    def run(batch: pa.RecordBatch):
        found = encoder(source.value).encode(texts(batch))
        d = decoder(source.value)
        decoded = pa.array([d.decode(x.tolist()) for x in found], pa.string())
        return rows(doc_id=batch.column("doc_id"), ids=lists(np.concatenate(found), np.array([len(x) for x in found])), decoded=decoded)

    return map_texts(narrow(df.withColumnsRenamed({id_col: "doc_id", text_col: "text"}), doc_id="long", text="string"), run, "doc_id long, ids array<int>, decoded string")


def digest(df: DataFrame, vocabulary: str) -> DataFrame:
    """Encode, then decode, each text; count and hash what came out."""
    return round_trip(df, vocabulary).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
