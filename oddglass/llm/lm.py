"""Language-model scoring by deleted interpolation.

Word pairs: the probability of a token after the one before it is a mixture of the maximum-
likelihood estimates of order two and one and the even share 1 / (V + 1). The weights depend on
how often the context was seen (buckets of powers of two) and are learned by expectation-
maximisation on held-out counts: every training token is deleted from the counts in turn and
predicted from what is left. Its three estimates fall into a fine grid of fixed extent (eighths of
an octave), whose cells hold sums, so the driver gets a bounded table and still every training
token counts.

Counts cover all training documents. A block of documents sends its distinct words and pairs, as
64-bit hashes with their counts, to buckets by hash range and gets the corpus totals back in the
order of its keys; it can then score its own documents. The exchange is a shuffle of one entry
for each distinct key and block, whatever the key's frequency.

Null and empty texts hold the end token only. Null ids fall in fold 0 and are held out. An empty
table gives no rows; with no training token all counts are 0 and scores are those of the even
share. Repeated rows count as often as they stand there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zlib
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import bucket_count, cuts, make_blocks, pack_keys, pack_numbers, unpack, unpack_keys, unpack_numbers
from .common import release, rows, settled

FOLDS = 10
LEVELS = 48
GRID = 8  # cells to an octave
ROUNDS = 40
#: Bytes of text to one distinct key of a block, about.
BYTES_PER_KEY = 8.0
_U = np.uint64
END, START = _U(0xE4D), _U(0x57A87)


class _Hashes(dict):
    def __missing__(self, word):
        if len(self) >= 150_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word, seed=7)
        return value


def _mix(x):
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Tokens:
    """A block's tokens behind each other, with their pairs, and where each document starts."""

    def __init__(self, payload: bytes):
        batch = unpack(payload)
        self.doc_id = batch.column("doc_id")
        ids = self.doc_id.to_pylist()
        self.held = np.array([i is None or zlib.crc32(str(i).encode()) % FOLDS == 0 for i in ids], bool)
        hashes = _Hashes()
        parts, sizes = [], []
        for text in batch.column("text").to_pylist():
            words = text.encode("utf-8", "replace").lower().split() if text else []
            sizes.append(len(words) + 1)
            parts.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
            parts.append(np.array([END]))
        self.words = np.concatenate(parts)
        self.sizes = np.array(sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        before = np.concatenate([[START], self.words[:-1]])
        before[self.starts] = START
        self.pairs = _mix(before * _U(0x9E3779B97F4A7C15) + self.words)
        self.training = np.repeat(~self.held, self.sizes)

    def keys(self):
        """Distinct words and pairs, sorted, each with the number of training tokens."""
        for x in (self.words, self.pairs):
            keys, place = np.unique(x, return_inverse=True)
            yield keys, place, np.bincount(place[self.training], minlength=len(keys))


def _sends(blocks: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                packed = []
                tokens = Tokens(payload.as_py())
                for keys, _, counts in tokens.keys():
                    at = cuts(keys, buckets)
                    packed.append([(pack_keys(keys[a:b]), pack_numbers(counts[a:b]), int(b - a)) for a, b in zip(at, at[1:])])
                # Only buckets that some key falls in, and the first, which carries the block's own counts.
                full = [b for b in range(buckets) if b == 0 or any(kind[b][2] for kind in packed)]
                words, pairs = ([kind[b] for b in full] for kind in packed)
                n = pa.array([int(tokens.training.sum())] + [0] * (len(full) - 1), pa.int64())
                d = pa.array([int((~tokens.held).sum())] + [0] * (len(full) - 1), pa.int64())
                yield rows(bucket=pa.array(full, pa.int32()), block=pa.array([block] * len(full), pa.int64()), tokens=n, docs=d,
                           wk=pa.array([x[0] for x in words], pa.binary()), wc=pa.array([x[1] for x in words], pa.binary()),
                           pk=pa.array([x[0] for x in pairs], pa.binary()), pc=pa.array([x[1] for x in pairs], pa.binary()))
                del tokens, packed, words, pairs
                release()

    return blocks.select("block", "payload").mapInArrow(run, "bucket int, block long, tokens long, docs long, wk binary, wc binary, pk binary, pc binary")


def _answers(sent: DataFrame) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        blocks = group.column("block").to_pylist()
        out, distinct = {}, 0
        for kind in "wp":
            keys = [unpack_keys(x.as_py()) for x in group.column(kind + "k")]
            counts = np.concatenate([unpack_numbers(x.as_py()) for x in group.column(kind + "c")])
            known, place = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(place, weights=counts, minlength=len(known)).astype(np.int64)
            if kind == "w":
                distinct = int((total > 0).sum())
            ends = np.cumsum([len(k) for k in keys])
            out[kind] = [pack_numbers(total[p]) for p in np.split(place, ends[:-1])]
        n = len(blocks)
        del keys, counts, known, place, total
        release()
        return pa.table({
            "block": pa.array(blocks, pa.int64()), "bucket": pa.array([bucket] * n, pa.int32()),
            "distinct": pa.array([distinct] + [0] * (n - 1), pa.int64()), "tokens": group.column("tokens"), "docs": group.column("docs"),
            "w": pa.array(out["w"], pa.binary()), "p": pa.array(out["p"], pa.binary()),
        })

    return sent.groupBy("bucket").applyInArrow(run, "block long, bucket int, distinct long, tokens long, docs long, w binary, p binary")


class Counted:
    """A block's tokens with the corpus counts of word, pair and context."""

    def __init__(self, payload, answers, docs_in_training):
        self.tokens = t = Tokens(payload)
        answers = sorted(answers, key=lambda a: a["bucket"])
        got = []
        for kind, (keys, place, _) in zip("wp", t.keys()):
            total = np.concatenate([unpack_numbers(a[kind]) for a in answers])
            if len(total) != len(keys):
                raise RuntimeError("a block and its answers differ")
            got.append(total[place])
        self.word, self.pair = got
        self.context = np.concatenate([[0], self.word[:-1]])
        self.context[t.starts] = docs_in_training


def level(context: np.ndarray) -> np.ndarray:
    """Bucket of a context by its frequency: 0 for none, then powers of two."""
    return np.minimum(np.frexp(context.astype(float))[1], LEVELS - 1) * (context > 0)


class Model:
    def __init__(self, weights: np.ndarray, tokens: int, distinct: int, docs: int):
        self.weights, self.tokens, self.distinct, self.docs = weights, tokens, distinct, docs

    def probability(self, pair, context, word) -> np.ndarray:
        w = self.weights[level(context)]
        return w[:, 2] * pair / np.maximum(context, 1) + w[:, 1] * word / max(self.tokens, 1) + w[:, 0] / (self.distinct + 1)


def weights(cells, distinct: int, rounds: int = ROUNDS) -> np.ndarray:
    """Expectation-maximisation over cells (level, tokens, sum of pair estimates, sum of word estimates)."""
    out = np.tile([0.1, 0.4, 0.5], (LEVELS, 1))
    out[0] = [0.2, 0.8, 0.0]
    if not len(cells):
        return out
    at, n = cells[:, 0].astype(int), cells[:, 1]
    share = np.column_stack([np.full(len(cells), 1 / (distinct + 1)), cells[:, 3] / n, cells[:, 2] / n])
    prior = out * 0.5  # half a token, so that an unseen level keeps its start
    for _ in range(rounds):
        part = out[at] * share
        part *= (n / part.sum(1))[:, None]
        got = prior.copy()
        np.add.at(got, at, part)
        got[0, 2] = 0
        out = got / got.sum(1, keepdims=True)
    return out


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    blocks = make_blocks(docs)
    buckets = bucket_count(blocks, BYTES_PER_KEY)
    answers = settled(_answers(_sends(blocks, buckets)))
    distinct, n, d = (int(x or 0) for x in answers.agg(F.sum("distinct"), F.sum("tokens"), F.sum("docs")).first())
    # one list for each block: as many entries as buckets, together as long as the block's own keys
    lists = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "w", "p")).alias("answers"))
    joined = settled(blocks.select("block", "payload").join(lists, "block"))

    def each(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield Counted(batch.column("payload")[i].as_py(), batch.column("answers")[i].as_py(), d)
                release()

    def grid(batches):
        for c in each(batches):
            own = c.tokens.training
            pair, context, word = c.pair[own] - 1, c.context[own] - 1, c.word[own] - 1
            two, one = pair / np.maximum(context, 1), word / max(n - 1, 1)
            lv = level(context)
            fine = [np.where(x > 0, np.ceil(-np.log2(np.maximum(x, 1e-30)) * GRID), 1023).astype(np.int64) for x in (two, one)]
            cell = (lv.astype(np.int64) << 20) | (fine[0] << 10) | fine[1]
            known, place = np.unique(cell, return_inverse=True)
            yield rows(cell=known, level=(known >> 20).astype(np.int32), n=np.bincount(place), two=np.bincount(place, weights=two), one=np.bincount(place, weights=one))

    cells = joined.mapInArrow(grid, "cell long, level int, n long, two double, one double").groupBy("cell", "level").agg(
        F.sum("n").alias("n"), F.sum("two").alias("two"), F.sum("one").alias("one")).toArrow().sort_by("cell")
    table = np.column_stack([cells.column(k).to_numpy().astype(float) for k in ("level", "n", "two", "one")])
    model = Model(weights(table, distinct), n, distinct, d)

    def final(batches):
        for c in each(batches):
            t = c.tokens
            fit = np.log10(model.probability(c.pair, c.context, c.word))
            base = np.log10((c.word + 0.1) / (n + 0.1 * (distinct + 1)))
            total = lambda x: np.add.reduceat(x, t.starts)
            yield rows(doc_id=t.doc_id, held_out=pa.array(t.held), n_tokens=pa.array(t.sizes.astype(np.int64)), n_known=pa.array(total((c.word > 0).astype(np.int64))),
                       train_tokens=pa.array(np.full(len(t.sizes), n)), base_score=pa.array(total(base)), score=pa.array(total(fit)))

    return joined.mapInArrow(final, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
