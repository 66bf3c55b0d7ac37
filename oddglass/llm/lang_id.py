"""Language identification by rank-order profiles of character n-grams.

A text is lower-cased and cut into words, maximal runs of letters and marks. Each word stands
between two blanks, and its n-grams are its pieces of one to three characters with the blanks
(the blank alone is none). A profile lists the ``size`` most frequent n-grams, most frequent first,
equal counts in order of code points. A language's profile comes from all its training texts
together; a document's from its own text. The out-of-place distance of the two adds, for each of
the document's n-grams, how far its two places lie apart, or ``size`` where the language's profile
lacks it. The language of least distance is predicted, of equal ones the first by name.

Three characters of 21 bits fill one 64-bit key, so n-grams are counted as whole numbers and the
order of keys is the order of code points.

Defined results: a text that is null, empty or without a letter gives ``und`` with score 0; so does
every text where nothing was learned. Texts of any length are counted in stretches of bounded
size. Rows without an id are training rows and are scored; repeated rows count as often as they
stand. An empty table gives no rows; other columns, whatever their names, are left behind.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, map_texts, narrow, release, reachable, rows, pieces, settled

#: N-grams in a profile.
SIZE = 300
#: One row in so many is held out: crc32 of the id as text, modulo this, is HELD.
FOLDS = 4
HELD = 2
#: Characters counted at once.
STRETCH = 1 << 20
#: Different n-grams, of all languages, that a task gathers before it sends their counts on.
GATHERED = 1 << 20
#: Languages whose profiles every worker may hold: 300 keys of 8 bytes each, 24 MB in all.
MOST_LANGUAGES = 10_000
UNKNOWN = "und"
_BLANK = 32


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Per code point: 2 for letters, 1 for marks, 0 for all else."""
    import unicodedata

    major = {"L": 2, "M": 1}
    return np.array([major.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], dtype=np.uint8)


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text as keys, ascending, and their counts; nothing for a text without letters."""
    low = (text or "").lower()
    kinds, parts, lettered = _kinds(), [], False
    tail = np.array([_BLANK], dtype=np.int64)
    for at in range(0, len(low), STRETCH):
        code = np.frombuffer(low[at:at + STRETCH].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        kind = kinds[code]
        lettered = lettered or bool((kind == 2).any())
        code[kind == 0] = _BLANK
        line = np.concatenate([tail, code, [_BLANK]] if at + STRETCH >= len(low) else [tail, code])
        keep = np.ones(len(line), dtype=bool)
        keep[1:] = (line[1:] != _BLANK) | (line[:-1] != _BLANK)
        keep[:len(tail)] = True
        line = line[keep]
        old = len(tail)
        # An n-gram is counted in the stretch that holds its last character.
        one = line[old:]
        two = (line[old - 1:-1] << 42) | (one << 21)
        found = [one[one != _BLANK] << 42, two]
        back = max(old, 2)
        three = (line[back - 2:-2] << 42) | (line[back - 1:-1] << 21) | line[back:]
        found.append(three[line[back - 1:-1] != _BLANK])
        parts.append(np.unique(np.concatenate(found), return_counts=True))
        tail = line[-2:].copy()
        if len(parts) > 8:
            parts = [_merge(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))]
    if not lettered:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return parts[0] if len(parts) == 1 else _merge(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def spell(key: int) -> str:
    """The n-gram of a key."""
    return "".join(chr(c) for c in (key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF) if c)


def counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each n-gram stands in all training texts of each language.

    Training rows are those outside the held-out fold with a language. A task adds up its own
    n-grams before it sends them, so what is shuffled follows the different n-grams of a task, also
    where one language holds most rows.
    """

    def run(batches):
        held: dict[str, list] = {}
        size = 0

        def flush():
            for lang, parts in held.items():
                keys, n = _merge(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                yield rows(lang=pa.array([lang] * len(keys), pa.string()), gram=keys, n=n)
            held.clear()

        for batch in batches:
            for piece in pieces(batch, "text"):
                for lang, text in zip(piece.column("lang").to_pylist(), piece.column("text")):
                    keys, n = grams(text.as_py())
                    held.setdefault(lang, []).append((keys, n))
                    size += len(keys)
                if size > GATHERED:
                    held = {lang: [_merge(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))] for lang, parts in held.items()}
                    size = sum(len(p[0][0]) for p in held.values())
                    if size > GATHERED // 2:
                        yield from flush()
                        size = 0
        yield from flush()
        release()

    reachable(docs.sparkSession)
    known = narrow(docs.where(fold(FOLDS) != HELD), lang="string", text="string").where("lang IS NOT NULL AND text IS NOT NULL")
    return known.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(lang, place, gram): each language's profile, places from 0, ``size`` rows at most a language.

    Spark cuts the ranking down to ``size`` rows a language in every task before it shuffles. The
    result is written once, so scoring sees one and the same profile.
    """
    ranked = counts(docs).selectExpr("lang", "gram", "row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) - 1 AS place")
    return settled(ranked.where(F.col("place") < size).select("lang", "place", "gram"))


def _collected(profiles: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages by name, all keys ascending, and places by key and language (``size`` is not there)."""
    n = profiles.select("lang").distinct().count()
    if n > MOST_LANGUAGES:
        raise ValueError(f"{n} languages; profiles of {MOST_LANGUAGES} are held at most")
    got = profiles.toPandas()
    langs = sorted(set(got["lang"]))
    keys = np.unique(got["gram"].to_numpy(dtype=np.int64))
    return langs, keys, np.stack([got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64) if len(got) else np.zeros(0, np.int64),
                                  got["place"].to_numpy(np.int64), np.searchsorted(keys, got["gram"].to_numpy(dtype=np.int64))])


def classify(docs: DataFrame, profiles: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, distance, n_grams.

    ``distance`` is the least out-of-place distance and ``n_grams`` the length of the document's
    profile; ``score`` is 1 - distance / (n_grams * size): 1 where both profiles agree in every
    place, 0 where they share nothing. One pass over the texts, no shuffle.
    """
    langs, keys, entries = _collected(profiles)

    def run(batch):
        place = np.full((len(keys) + 1, max(1, len(langs))), -1, dtype=np.int32)
        place[entries[2], entries[0]] = entries[1]
        pred, score, distance, length = [], [], [], []
        for text in batch.column("text"):
            found, n = grams(text.as_py())
            best = np.lexsort((found, -n))[:size]
            m = len(best)
            if not m or not langs:
                pred.append(UNKNOWN), score.append(0.0), distance.append(m * size), length.append(m)
                continue
            at = np.searchsorted(keys, found[best])
            at[(at == len(keys)) | (keys[np.minimum(at, len(keys) - 1)] != found[best])] = len(keys)
            other = place[at]
            apart = np.where(other < 0, size, np.abs(other - np.arange(m)[:, None])).sum(axis=0, dtype=np.int64)
            k = int(apart.argmin())
            pred.append(langs[k]), score.append(1.0 - int(apart[k]) / (m * size)), distance.append(int(apart[k])), length.append(m)
        return rows(doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), lang_pred=pa.array(pred, pa.string()), score=pa.array(score, pa.float64()),
                    distance=pa.array(distance, pa.int64()), n_grams=pa.array(length, pa.int64()))

    docs = narrow(docs, doc_id="long", text="string").withColumn("held_out", fold(FOLDS) == HELD)
    return map_texts(docs, run, "doc_id long, held_out boolean, lang_pred string, score double, distance long, n_grams long")
