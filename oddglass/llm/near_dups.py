"""Near-duplicate groups by SuperMinHash signatures.

A document's set holds its distinct five-word shingles (a shorter document: its whole word
sequence). Every element walks through its own random permutation of the signature's places and
writes its random value plus the number of the step; the ranks an element leaves in the places are
thus correlated, which lowers the variance of the estimate, and an element stops as soon as the
number of the step exceeds the largest value still in the signature. All elements of a piece of
documents take a step together, in numpy.

Documents of one set are one node. Nodes that agree in one band of four places meet in a bucket
(32 bands: a pair at similarity 0.75 is missed with probability 5e-6). No bucket is expanded into
its pairs:

1. every node is paired with the bucket's first node; pairs are verified on the full sets and the
   links joined into components;
2. buckets with one first node are one group from here on. In a group that still holds several
   components, the nodes outside the component of the first node meet all others, in blocks of
   about 256 nodes with their full sets: a product of two incidence matrices has the sizes of all
   intersections of two blocks, and one link for each two components goes out. Pairs inside one
   component need no look: no link that would change a component is lost.

Buckets, blocks and links stay in Spark; hot keys are met by aggregates that combine before the
shuffle, by blocks, and by joins that adaptive execution splits. Candidate ids are broadcast only
when counted and few; otherwise the same join is shuffled.

Null and empty texts, and texts without words, have the empty set and link with nothing. Rows with
a null id form no links and get a null component. Rows that repeat an id are expected to be equal;
if they are not, a link of one counts for the id. Ties (equal sets) are links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, narrow, rows, settled, texts
from .graph import components

SHINGLE = 5
PLACES, BAND = 128, 4
SHARE = (75, 100)
BLOCK = 256
#: Shingles of one block, about.
BLOCK_SHINGLES = 1 << 17
#: Blocks of a mixed group that one task compares with the rest of the group.
TOGETHER = 4
#: Tasks in which the rows of one group meet what is known of it.
SPREAD = 32
#: Columns of an incidence matrix held at once.
COLUMNS = 8192
#: Candidate ids up to this number (some 100 MB in Spark's hash table) are broadcast.
BROADCAST_IDS = 3_000_000
KEPT_WORDS = 150_000
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Hashes(dict):
    def __missing__(self, word):
        if len(self) >= KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: str) -> list[bytes]:
    """Words of a text, A-Z lower-cased; bytes.split() cuts at blank, tab and line ends only."""
    return text.encode("utf-8", "replace").lower().split()


def shingles(text: str, hashes: _Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(w) < SHINGLE:
        whole = np.array([len(w)], np.uint64)
        for x in w:
            whole = mix(whole * _U(31) + x + _U(0x51ED270B))
        return whole
    n = len(w) - SHINGLE + 1
    out = w[:n].copy()
    for k in range(1, SHINGLE):
        out = out * _U(0x9E3779B97F4A7C15) + w[k:n + k]
    return np.unique(mix(out))


def signatures(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """SuperMinHash signature of each set; a row of infinities for the empty set."""
    h = np.full((len(sets), places), np.inf)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    x = np.concatenate([*sets, np.zeros(0, np.uint64)])
    order = None
    for j in range(places):
        if not len(x):
            break
        bits = mix(x + _U((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        value = (bits >> _U(32)).astype(np.float64) / 2.0**32 + j
        k = j + ((bits & _U(0xFFFFFFFF)) % _U(places - j)).astype(np.int64)
        if j == 0:
            place = k
        else:
            at = np.arange(len(x))
            place = order[at, k]
            order[at, k] = order[:, j]
        np.minimum.at(h.ravel(), owner * places + place, value)
        worst = h.max(1)
        go = worst[owner] > j + 1  # a later step could still lower a value
        if not go.any():
            break
        if j == 0:
            x, owner, k = x[go], owner[go], k[go]
            order = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.uint16), (len(x), 1))
            order[np.arange(len(x)), k] = 0
        elif go.sum() < 0.8 * len(go):  # values of sets that are done cannot change any more
            x, owner, order = x[go], owner[go], order[go]
    return h


def band_keys(h: np.ndarray) -> np.ndarray:
    bits = np.ascontiguousarray(h).view(np.uint64)
    n = h.shape[1] // BAND
    key = np.zeros((len(h), n), np.uint64) + (np.arange(n, dtype=np.uint64) + _U(1)) * _U(0x2545F4914F6CDD1D)
    for k in range(BAND):
        key = mix(key * _U(0x9E3779B97F4A7C15) + bits[:, k::BAND][:, :n])
    return key.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n, f1, f2, bands): size and fingerprint of each set; the keys of its bands once per set and piece."""

    def run(batch: pa.RecordBatch):
        hashes = _Hashes()
        sets = [shingles(t, hashes) for t in texts(batch)]
        n = np.array([len(s) for s in sets], np.int64)
        f1 = np.array([int(mix(s).sum(dtype=np.uint64)) for s in sets], np.uint64).view(np.int64)
        f2 = np.array([int(np.bitwise_xor.reduce(mix(s + _U(0x1234567)))) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
        first: dict[tuple, int] = {}
        for i, key in enumerate(zip(n.tolist(), f1.tolist(), f2.tolist())):
            if key[0]:
                first.setdefault(key, i)
        bands: list = [None] * len(sets)
        todo = list(first.values())
        while todo:
            take, size = [], 0
            while todo and (size < 60_000 or not take):
                take.append(todo.pop())
                size += len(sets[take[-1]])
            for i, key in zip(take, band_keys(signatures([sets[i] for i in take]))):
                bands[i] = key
        return rows(doc_id=batch.column("doc_id"), n=pa.array(n), f1=pa.array(f1), f2=pa.array(f2), bands=pa.array(bands, pa.list_(pa.int64())))

    return map_texts(narrow(docs, doc_id="long", text="string"), run, "doc_id long, n long, f1 long, f2 long, bands array<long>")


def alike(n, m) -> F.Column:
    """Can sets of these sizes reach the share at all?"""
    return F.least(n, m) * SHARE[1] >= F.greatest(n, m) * SHARE[0]


def sets_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(v, words): the full sets of some documents, read from their whole texts."""
    few = ids.count() <= BROADCAST_IDS
    near = narrow(docs, doc_id="long", text="string").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")

    def run(batch: pa.RecordBatch):
        hashes = _Hashes()
        return rows(v=batch.column("doc_id"), words=pa.array([shingles(t, hashes).tobytes() for t in texts(batch)], pa.binary()))

    return settled(map_texts(near, run, "v long, words binary"))


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    pairs = settled(pairs)
    ids = settled(pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select(F.col("b").alias("doc_id"))).distinct())
    found = sets_of(ids, docs)

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("wa").to_pylist(), batch.column("wb").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * SHARE[1] >= (len(x) + len(y) - both) * SHARE[0])
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(found.select(F.col("v").alias("b"), F.col("words").alias("wb")), "b").join(found.select(F.col("v").alias("a"), F.col("words").alias("wa")), "a")
    return both.select("a", "b", "wa", "wb").mapInArrow(compare, "a long, b long")


def intersections(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets, by products of incidence matrices."""
    out = np.zeros((len(x), len(y)), np.float32)
    if not x or not y:
        return out.astype(np.int64)
    flat = [np.concatenate(s) for s in (x, y)]
    owner = [np.repeat(np.arange(len(s)), [len(k) for k in s]) for s in (x, y)]
    shared = np.intersect1d(flat[0], flat[1])
    place = [np.minimum(np.searchsorted(shared, f), max(0, len(shared) - 1)) for f in flat]
    good = [shared[p] == f if len(shared) else np.zeros(len(f), bool) for p, f in zip(place, flat)]
    place, owner = [p[g] for p, g in zip(place, good)], [o[g] for o, g in zip(owner, good)]
    for at in range(0, len(shared), COLUMNS):
        sides = []
        for p, o, n in zip(place, owner, (len(x), len(y))):
            m = np.zeros((n, min(COLUMNS, len(shared) - at)), np.float32)
            own = (p >= at) & (p < at + COLUMNS)
            m[o[own], p[own] - at] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str) -> DataFrame:
    """``left`` with its one row of ``right``: the rows of a key meet it in ``SPREAD`` tasks."""
    salt = F.pmod(F.xxhash64(by), F.lit(SPREAD)).cast("int").alias("_salt")
    many = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return left.withColumn("_salt", salt).join(many, [key, "_salt"]).drop("_salt")


def rest_links(members: DataFrame) -> DataFrame:
    """Links (a, b) across components within groups: (first, v, c, main, words), ``main`` being the component of the first node.

    Nodes outside the first one's component meet all nodes of the group, in blocks of sets. The
    blocks on the left are dealt out ``TOGETHER`` to a task, and each task gets the group's other
    blocks, so a large mixed group is many tasks' work, not one's.
    """
    def blocks(keep):
        return F.ceil(F.greatest(F.count_if(keep) / BLOCK, F.sum(F.when(keep, F.length("words") / 8)) / BLOCK_SHINGLES)).cast("long")

    sizes = members.groupBy("first").agg(blocks(F.lit(True)).alias("all"), blocks(F.col("c") != F.col("main")).alias("out"))
    own = spread_join(members, sizes, "first", "v")

    def blocked(df, total, name):
        part = F.pmod(F.xxhash64("v"), F.col(total))
        tasks = F.ceil(F.max("out") / TOGETHER).cast("int")
        return df.withColumn("part", part).groupBy("first", "part").agg(F.collect_list(F.struct("v", "c", "words")).alias(name), tasks.alias("tasks"))

    left = blocked(own.where("c <> main"), "out", "x").select("first", F.floor(F.col("part") / TOGETHER).cast("int").alias("task"), "x")
    right = blocked(own, "all", "y").where("tasks > 0").select("first", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), "y")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                (v, c, x), (w, d, y) = (
                    (s.field(0).to_numpy(), s.field(1).to_numpy(), [np.frombuffer(k, np.uint64) for k in s.field(2).to_pylist()])
                    for s in (batch.column("x")[i].values, batch.column("y")[i].values))
                both = intersections(x, y)
                union = np.array([len(k) for k in x])[:, None] + np.array([len(k) for k in y])[None] - both
                p, q = np.nonzero((both * SHARE[1] >= union * SHARE[0]) & (c[:, None] != d[None]))
                _, some = np.unique(np.column_stack([c[p], d[q]]), axis=0, return_index=True)
                yield rows(a=v[p[some]], b=w[q[some]])

    return left.join(right, ["first", "task"]).select("x", "y").mapInArrow(run, "a long, b long")


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    sketched = settled(sketches(docs))
    nodes = settled(
        sketched.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "f1", "f2")
        .agg(F.min("doc_id").alias("v"), F.first("bands", True).alias("bands")))
    placed = nodes.select("v", "n", F.explode("bands").alias("key"))
    first = placed.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("v", "n")).alias("top")).where("size > 1")
    met = placed.join(first.select("key", F.col("top.v").alias("first"), F.col("top.n").alias("first_n")), "key")
    grouped = settled(met.groupBy("first", "first_n", "v", "n").agg(F.lit(1).alias("one")).drop("one"))
    stars = grouped.where((F.col("v") != F.col("first")) & alike(F.col("n"), F.col("first_n"))).select(F.col("first").alias("a"), F.col("v").alias("b"))
    links = settled(verify(stars, docs))
    comp = settled(components(links))
    # groups that still hold several components
    known = settled(grouped.join(comp, "v", "left").select("first", "v", F.coalesce("c", "v").alias("c")))
    mixed = known.groupBy("first").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min_by("c", "v").alias("main")).where("low <> high").select("first", "main")
    members = settled(spread_join(known, mixed, "first", "v"))
    sets = sets_of(settled(members.select(F.col("v").alias("doc_id")).distinct()), docs)
    more = settled(rest_links(members.join(sets, "v")))
    # a component found above is the star of its smallest id from here on
    final = components(comp.select(F.col("c").alias("a"), F.col("v").alias("b")).unionAll(more))
    named = nodes.select("n", "f1", "f2", "v").join(final, "v", "left").select("n", "f1", "f2", F.coalesce("c", "v").alias("c"))
    out = sketched.select("doc_id", "n", "f1", "f2").join(named, ["n", "f1", "f2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
