"""Benchmark decontamination by greedy string tiling.

Words are lower-cased runs of letters and digits. Five words in a row that stand in a document
and in a benchmark item are a seed and make the two a candidate pair. For a pair the longest
common runs of words that overlap no earlier tile are marked as tiles, again and again: runs of a
search length are found by running Karp-Rabin hashes over the unmarked words, compared word by
word and grown to their full length; a run over twice the search length starts the search anew at
its length, otherwise tiles are marked longest first and the search length is halved, down to
five. The share of the item's words under tiles is its coverage: moved passages count in full.

The benchmark is handled in blocks: its size is summed first, each block holds about
``block_chars`` characters and is sent to the executors, and every block passes over all whole
documents. So the data sent is bounded, whatever the benchmark's size. There is no shuffle.

Null and empty texts match nothing, nor do items of fewer than five words; items with a null id
are left out. Equal items are reported each; equal document rows give equal rows.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, narrow, rows, texts

WORDS = re.compile(r"[^\W_]+")
LEAST = 5
FIRST = 20
COVERAGE = 0.5
BLOCK_CHARS = 16 << 20
#: Pairs of equal windows looked at together.
PAIRS = 1 << 20
_P = pow(0x9E3779B97F4A7C15, 1)
_Q = pow(_P, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def window_hashes(x: np.ndarray, s: int) -> np.ndarray:
    """Karp-Rabin hash of every run of ``s`` words: differences of running sums, shifted to one origin."""
    n = len(x) - s + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * _powers(_P, len(x)), dtype=np.uint64)])
    return (run[s:] - run[:n]) * _powers(_Q, n)


def _free(marked: np.ndarray, s: int) -> np.ndarray:
    """Starts of runs of ``s`` words without a mark."""
    if s > len(marked):
        return np.zeros(0, np.int64)
    run = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(run[s:] == run[: len(run) - s])


def tiles(doc: np.ndarray, item: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start in doc, start in item, words) of the greedy tiling; negative words of ``doc`` match nothing."""
    doc_marked, item_marked = doc < 0, np.zeros(len(item), bool)
    out: list[tuple[int, int, int]] = []
    s = max(least, min(FIRST, len(item)))
    while True:
        found, longest = _matches(doc, item, doc_marked, item_marked, s)
        if longest > 2 * s:
            s = longest
            continue
        again = False
        for size in sorted(found, reverse=True):
            for d, i in sorted(found[size]):
                if not (doc_marked[d:d + size].any() or item_marked[i:i + size].any()):
                    doc_marked[d:d + size] = item_marked[i:i + size] = True
                    out.append((d, i, size))
                elif size > s:
                    again = True
        if again:  # a run lost a part to a longer tile; what is left may still be as long as s
            continue
        if s <= least:
            return out
        s = s // 2 if s >= 2 * least else least


def _matches(doc, item, doc_marked, item_marked, s):
    """Common unmarked runs of at least ``s`` words that cannot grow, by size; and the longest size."""
    di, ii = _free(doc_marked, s), _free(item_marked, s)
    found: dict[int, list[tuple[int, int]]] = {}
    if not len(di) or not len(ii):
        return found, 0
    hd, hi = window_hashes(doc, s)[di], window_hashes(item, s)[ii]
    order = np.argsort(hi, kind="stable")
    hi, ii = hi[order], ii[order]
    left, right = np.searchsorted(hi, hd, "left"), np.searchsorted(hi, hd, "right")
    longest = 0
    for d, i in _starts(doc, item, doc_marked, item_marked, di, ii, left, right):
        most = min(len(doc) - d, len(item) - i)
        differ = (doc[d:d + most] != item[i:i + most]) | doc_marked[d:d + most] | item_marked[i:i + most]
        n = int(differ.argmax()) if differ.any() else most
        if n >= s:
            found.setdefault(n, []).append((d, i))
            longest = max(longest, n)
    return found, longest


def _starts(doc, item, doc_marked, item_marked, di, ii, left, right):
    """Pairs of equal windows that no run before them holds. In texts that repeat themselves most pairs lie
    inside a run that began earlier; they are left out together, so much at once."""
    some = np.flatnonzero(right > left)
    many = (right - left)[some]
    ends = np.cumsum(many)
    at = 0
    while at < len(some):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        own, n = some[at:stop], many[at:stop]
        owner = np.repeat(own, n)
        d, i = di[owner], ii[left[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)]
        inside = (d > 0) & (i > 0)
        inside &= (doc[d - 1] == item[i - 1]) & ~doc_marked[d - 1] & ~item_marked[i - 1]
        yield from zip(d[~inside].tolist(), i[~inside].tolist())
        at = stop


class Block:
    """Some items: their words as numbers, and their seeds."""

    def __init__(self, ids: list[int], items: list[str]):
        self.ids, self.vocabulary = ids, {}
        self.items = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in WORDS.findall(t.lower())], np.int64) for t in items]
        seeds = [window_hashes(x, LEAST) for x in self.items]
        flat = np.concatenate([*seeds, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(seeds)), [len(x) for x in seeds])
        order = np.argsort(flat, kind="stable")
        self.seeds, self.owner = flat[order], owner[order]

    def candidates(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The text's words as numbers (-1: in no item), and the items with a shared seed."""
        get = self.vocabulary.get
        words = WORDS.findall(text.lower())
        x = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        if len(x) < LEAST or not len(self.seeds):
            return x, np.zeros(0, np.int64)
        at = _free(x < 0, LEAST)
        if not len(at):
            return x, np.zeros(0, np.int64)
        h = np.unique(window_hashes(x, LEAST)[at])
        left, right = np.searchsorted(self.seeds, h, "left"), np.searchsorted(self.seeds, h, "right")
        spots = [self.owner[a:b] for a, b in zip(left, right) if b > a]
        return x, np.unique(np.concatenate(spots)) if spots else np.zeros(0, np.int64)

    def matches(self, text: str):
        x, near = self.candidates(text)
        for k in near.tolist():
            found = tiles(x, self.items[k])
            yield self.ids[k], len(self.items[k]), sum(t[2] for t in found), found


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS):
    """The benchmark as blocks of about equal, bounded size."""
    own = narrow(benchmark, item_id="long", text="string").where("item_id IS NOT NULL AND text IS NOT NULL")
    n = max(1, math.ceil((own.agg(F.sum(F.length("text"))).first()[0] or 0) / block_chars))
    for b in range(n):
        got = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).toArrow()
        yield Block(got.column("item_id").to_pylist(), got.column("text").to_pylist())


def overlaps(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, item_words, covered, coverage, tiles) of pairs whose coverage reaches the threshold."""
    own = narrow(docs, doc_id="long", text="string")
    span = pa.list_(pa.struct([("doc_word", pa.int32()), ("item_word", pa.int32()), ("words", pa.int32())]))
    out = None
    for block in blocks(benchmark, block_chars):
        sent = own.sparkSession.sparkContext.broadcast(block)

        def run(batch: pa.RecordBatch, sent=sent):
            made = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                made += [(doc_id, *m) for m in sent.value.matches(text) if m[2] >= coverage * m[1]]
            pick = lambda k, kind: pa.array([m[k] for m in made], kind)
            spans = pa.array([[dict(zip(("doc_word", "item_word", "words"), t)) for t in m[4]] for m in made], span)
            return rows(doc_id=pick(0, pa.int64()), item_id=pick(1, pa.int64()), item_words=pick(2, pa.int64()), covered=pick(3, pa.int64()),
                        coverage=pa.array([m[3] / m[2] for m in made], pa.float64()), tiles=spans)

        part = map_texts(own, run, "doc_id long, item_id long, item_words long, covered long, coverage double, tiles array<struct<doc_word:int,item_word:int,words:int>>")
        out = part if out is None else out.unionAll(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents that cover no item up to the threshold, with all their columns."""
    out = docs
    for block in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batch: pa.RecordBatch, sent=sent):
            keep = [not any(m[2] >= coverage * m[1] for m in sent.value.matches(t)) for t in texts(batch)]
            return batch.filter(pa.array(keep, pa.bool_()))

        out = map_texts(out, run, out.schema)
    return out
