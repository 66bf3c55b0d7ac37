"""The prefix trie of conversations, rolled up by centroid decomposition.

Every conversation c is rebuilt: the first h turns of conversation c - c % 100, then its own turns
after its first h, where h = crc32(c) % 6. A node is one distinct sequence of first d turns; it is
named by its smallest member and d, which no two nodes share.

*Nodes.* A turn is its digest, its place and its length; texts are not shuffled. The turns up to a
place have four running sums of hashes of (place, digest), which name the sequence. One aggregate
over all rows gives each node's members; copies are combined before the shuffle. Only one
conversation of each distinct sequence goes on from there.

*Roll-up.* Sums over subtrees come from a centroid decomposition of the parent edges. A node weighs
as many as distinct conversations pass through it. The centroid of a component is its deepest node
that holds half of the weight or more; taking it out leaves components of at most half the weight.
The total of the centroid and the components below it is added to every node on the way from the
centroid to the component's top, and the parts go on by themselves: each node and descendant are
parted by exactly one centroid, so each descendant is added exactly once, and no path is longer
than its component. Components over a bound are split by joins, all at once; the others are split
inside tasks, many together, in the same way. A chain of any length takes a number of rounds that
grows with its logarithm.

*Hot keys.* Conversations of many turns are ordered in cut buckets, not in one window. Joins of rows
to a node that many share answer the few hottest nodes from a table whose size is bounded by the
threshold. The ids that end at a node are sorted by range, so a hot node's list is spread over tasks;
only its finished text is read through one hash, in pieces of a megabyte.

Defined results: rows without conv_id are left out; of equal turn numbers the order is that of the
turns' digests; repeated rows are repeated turns; null role or text is empty; a null turn comes first.
Texts of any length are digested whole. An empty table gives no rows; other columns are left behind.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import ordinal, running_totals
from .common import narrow, reachable, release, rows, settled

#: A conversation takes the first turns of the one whose id is the next lower multiple of this.
FAMILY = 100
#: It takes fewer turns than this.
SHARED = 6
#: Turns of one conversation that a plain window orders.
LONG_CONVERSATION = 100_000
#: Rows of one key that a plain join sends to one task, and the most keys that are answered otherwise.
HOT_ROWS = 1_000
HOT_KEYS = 1_000
#: Weight, and so the most nodes, of a component that is split inside one task.
LOCAL_WEIGHT = 1_024
#: Entries of a table that may be broadcast.
MOST_BROADCAST = 1_000_000
#: Nodes that a task splits at once, and bytes of a list of ids in one row.
TOGETHER = 1 << 16
PIECE = 1 << 20

def _spread_join(left: DataFrame, right: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """``left`` with its one row of ``right``; rows of a hot key stay where they are and read a broadcast.

    Hot keys hold more than ``HOT_ROWS`` rows and more than ``total`` / ``HOT_KEYS``, so there are at
    most ``HOT_KEYS`` of them, however large ``left`` is (``total`` is its number of rows, or more).
    """
    counted = left.groupBy(*keys).agg(F.count("*").alias("_n"))
    hot = settled(counted.where(F.col("_n") > max(HOT_ROWS, total // HOT_KEYS)).drop("_n"))
    if hot.isEmpty():
        return left.join(right, keys, how)
    few = F.broadcast(right.join(F.broadcast(hot), keys, "left_semi"))
    at_hot = left.join(F.broadcast(hot), keys, "left_semi").join(few, keys, how)
    return at_hot.unionByName(left.join(F.broadcast(hot), keys, "left_anti").join(right, keys, how))


def _long(total: int) -> int:
    """Conversations of more turns than this are ordered in buckets; at most ``HOT_KEYS`` are."""
    return max(LONG_CONVERSATION, total // HOT_KEYS)


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, int]:
    """(conv, pos, n, a, b, chars), every turn with its place in its conversation, from 1, and their
    number; and the number of all turns."""
    turns = settled(narrow(conversations, conv_id="long", turn="long", role="string", text="string").where("conv_id IS NOT NULL").selectExpr(
        "conv_id AS conv", "turn", "sha2(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')), 256) AS d", "length(coalesce(text, '')) AS chars",
    ).selectExpr("conv", "turn", "CAST(conv(substr(d, 1, 15), 16, 10) AS BIGINT) AS a", "CAST(conv(substr(d, 16, 15), 16, 10) AS BIGINT) AS b", "CAST(chars AS BIGINT) AS chars"))
    total = turns.count()
    long_ones = settled(turns.groupBy("conv").agg(F.count("*").alias("n")).where(F.col("n") > _long(total)).select("conv"))
    some = not long_ones.isEmpty()
    short = turns.join(F.broadcast(long_ones), "conv", "left_anti") if some else turns
    short = short.selectExpr("conv", "row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, a, b) AS pos", "count(1) OVER (PARTITION BY conv) AS n", "a", "b", "chars")
    if not some:
        return settled(short), total
    # Rows alike in all columns get numbers of their own, so that places are unique.
    chosen = settled(turns.join(F.broadcast(long_ones), "conv").selectExpr("conv", "turn IS NOT NULL AS t0", "coalesce(turn, 0) AS t1", "a", "b", "monotonically_increasing_id() AS i", "chars"))
    placed = ordinal(chosen, ["conv"], ["t0", "t1", "a", "b", "i"], out="pos", size="n", few_parts=False)
    return settled(short.selectExpr("conv", "CAST(pos AS BIGINT) AS pos", "n", "a", "b", "chars").unionByName(placed.selectExpr("conv", "CAST(pos AS BIGINT) AS pos", "CAST(n AS BIGINT) AS n", "a", "b", "chars"))), total


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (conv, depth, len, k1, k2, chars) of the rebuilt conversations, and all (conv, len).

    (k1, k2) name the sequence of the first ``depth`` turns.
    """
    own, total = ordered_turns(conversations)
    limit = _long(total)
    heads = own.where(f"pos < {SHARED} AND conv % {FAMILY} = 0").selectExpr("conv AS base", "pos", "a", "b", "chars")
    lengths = heads.groupBy("base").agg(F.count("*").alias("head"))
    convs = own.where("pos = 1").selectExpr("conv", "n", f"conv - conv % {FAMILY} AS base", f"crc32(CAST(conv AS STRING)) % {SHARED} AS h")
    convs = settled(convs.join(lengths, "base", "left").selectExpr("conv", "base", "n", "h", "least(h, coalesce(head, 0L)) AS taken").selectExpr(
        "conv", "base", "n", "h", "taken", "taken + greatest(n - h, 0L) AS len"))
    first = convs.where("taken > 0").join(heads, "base").where("pos <= taken").selectExpr("conv", "CAST(pos AS BIGINT) AS depth", "len", "a", "b", "chars")
    # Long conversations are so few that what they need is broadcast; the others have a bounded number of rows.
    shift = convs.select("conv", "h", "taken", "len", "n")
    some = not shift.where(f"n > {limit}").isEmpty()
    rest = own.where(f"n <= {limit}").join(shift.where(f"n <= {limit}").drop("n"), "conv")
    if some:
        rest = rest.unionByName(own.where(f"n > {limit}").join(F.broadcast(shift.where(f"n > {limit}").drop("n")), "conv"))
    rest = rest.where("pos > h").selectExpr("conv", "taken + pos - h AS depth", "len", "a", "b", "chars")
    both = first.unionByName(rest)
    lanes = both.selectExpr("*", "xxhash64(depth, a, b) AS x", "xxhash64(b, depth, a, 1) AS y").selectExpr(
        "conv", "depth", "len", "chars", "x & 2147483647 AS v1", "shiftrightunsigned(x, 33) AS v2", "y & 2147483647 AS v3", "shiftrightunsigned(y, 33) AS v4")
    name = ["xxhash64(depth, s1, s2, s3, s4) AS k1", "xxhash64(s4, s3, s2, s1, depth) AS k2"]
    window = "(PARTITION BY conv ORDER BY depth)"
    plain = lanes.where(f"len <= {limit + SHARED}") if some else lanes
    turns = plain.selectExpr("conv", "depth", "len", "chars", *[f"sum(v{i}) OVER {window} AS s{i}" for i in (1, 2, 3, 4)])
    if some:
        added = running_totals(settled(lanes.where(f"len > {limit + SHARED}")), ["conv"], ["depth"], {f"s{i}": f"v{i}" for i in (1, 2, 3, 4)}, few_parts=False)
        turns = turns.unionByName(added.selectExpr("conv", "depth", "len", "chars", *[f"before_s{i} + v{i} AS s{i}" for i in (1, 2, 3, 4)]))
    return settled(turns.selectExpr("conv", "depth", "len", *name, "chars")), convs.select("conv", "len")


def trie(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree, paths): all nodes, and the node at each depth of one conversation of each sequence.

    tree: conv, depth, k1, k2, parent, n_convs, n_children, weight, own (saved tokens of the node
    alone). paths: conv, depth, node. The root has k1 = k2 = 0.
    """
    total = turns.count()
    # Copies pass through the same nodes: one of them goes on, with their number.
    reps = turns.where("depth = len").groupBy("depth", "k1", "k2").agg(F.min("conv").alias("conv"), F.count("*").alias("copies")).select("conv", "copies")
    kept = settled(_spread_join(turns, reps, ["conv"], total))
    nodes = settled(kept.groupBy("depth", "k1", "k2").agg(
        F.min("conv").alias("node"), F.sum("copies").alias("n_convs"), F.max("chars").alias("chars"), F.sum(F.expr("len - depth + 1")).alias("weight")))
    top = convs.agg(F.min("conv").alias("node"), F.count("*").alias("n_convs")).first()
    own = _spread_join(kept.select("conv", "depth", "k1", "k2"), nodes.select("depth", "k1", "k2", "node"), ["depth", "k1", "k2"], total).select("conv", "depth", "node")
    paths = settled(own.unionByName(kept.where("depth = 1").select("conv", F.lit(0).cast("long").alias("depth"), F.lit(top["node"]).alias("node"))))
    whole = kept.agg(F.sum(F.expr("CASE WHEN depth = 1 THEN len + 1 END"))).first()[0] or 1
    root = turns.sparkSession.range(1).selectExpr(f"{top['node']}L AS conv", "0L AS depth", "0L AS k1", "0L AS k2", "CAST(NULL AS BIGINT) AS parent", f"{top['n_convs']}L AS n_convs", f"{whole}L AS weight", "0L AS own")
    above = paths.selectExpr("conv", "depth + 1 AS depth", "node AS parent")
    tree = nodes.selectExpr("node AS conv", "depth", "k1", "k2", "n_convs", "weight", "(n_convs - 1) * chars AS own").join(above, ["conv", "depth"])
    tree = settled(tree.select("conv", "depth", "k1", "k2", "parent", "n_convs", "weight", "own").unionByName(root))
    kids = tree.where("depth > 0").groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    tree = settled(tree.join(kids, ["conv", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    return tree, paths


def centroid_sums(parent: np.ndarray, depth: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (n, k) over the subtree of every node of a forest.

    ``parent`` holds positions, -1 for tops. ``weight`` is a positive weight summed over each subtree.
    All components of the forest are split at once; the number of rounds grows with the logarithm of
    the largest weight.
    """
    n = len(parent)
    parent, weight, out = parent.copy(), weight.copy(), np.zeros_like(values)

    def tops(live):
        up = np.arange(n)
        up[live] = np.where(parent[live] < 0, live, parent[live])
        while True:
            further = up[up[live]]
            if (further == up[live]).all():
                return up
            up[live] = further

    live = np.arange(n)
    top = tops(live)
    while len(live):
        heavy = live[2 * weight[live] >= weight[top[live]]]
        heavy = heavy[np.argsort(depth[heavy], kind="stable")]
        centre = np.full(n, -1)
        centre[top[heavy]] = heavy  # the deepest stays: one of equal depth at most holds half
        chosen = centre[centre >= 0]
        is_centre = np.zeros(n, dtype=bool)
        is_centre[chosen] = True
        # Cut: the centroid's children become tops, the centroid leaves.
        inner = live[parent[live] >= 0]
        kids = inner[is_centre[parent[inner]]]
        above, over = parent[chosen].copy(), parent[kids].copy()
        parent[kids] = -1
        live = live[~is_centre[live]]
        top = tops(live)
        part = np.zeros_like(values)
        np.add.at(part, top[live], values[live])  # totals of the components that are left
        total = values.copy()
        np.add.at(total, over, part[kids])
        out[chosen] += total[chosen]
        # From each centroid to its component's top.
        at, owner = above, chosen
        while True:
            go = at >= 0
            at, owner = at[go], owner[go]
            if not len(at):
                break
            out[at] += total[owner]
            weight[at] -= weight[owner]
            at = parent[at]
    return out


def _split_inside(pile: DataFrame, bound: int) -> DataFrame:
    """(conv, depth, n_leaves, saved) of components of at most ``bound`` nodes, several at once in a task."""

    def solve(t: pa.Table):
        col = {k: t.column(k).to_numpy() for k in ("top_conv", "top_depth", "conv", "depth", "parent", "weight", "leaf", "own", "more_leaves", "more_own")}
        n = len(col["conv"])
        _, code = np.unique(np.concatenate([col["conv"], col["parent"]]), return_inverse=True)
        _, level = np.unique(np.concatenate([col["depth"], col["depth"] - 1]), return_inverse=True)
        key, want = level[:n] * (2 * n) + code[:n], level[n:] * (2 * n) + code[n:]
        order = np.argsort(key, kind="stable")
        at = np.minimum(np.searchsorted(key[order], want), n - 1)
        is_top = (col["conv"] == col["top_conv"]) & (col["depth"] == col["top_depth"])
        parent = np.where(is_top, -1, order[at])
        sums = centroid_sums(parent, col["depth"], col["weight"], np.stack([col["leaf"], col["own"]], axis=1))
        return rows(conv=col["conv"], depth=col["depth"], n_leaves=sums[:, 0] + col["more_leaves"], saved=sums[:, 1] + col["more_own"])

    def run(batches):
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in held) < TOGETHER:
                continue
            t = pa.concat_tables(held).combine_chunks()
            a, b = t.column("top_conv").to_numpy(), t.column("top_depth").to_numpy()
            cut = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            if not len(cut):
                held = [t]
                continue
            yield solve(t.slice(0, int(cut[-1]) + 1))
            held = [t.slice(int(cut[-1]) + 1)]
        if held and sum(t.num_rows for t in held):
            yield solve(pa.concat_tables(held).combine_chunks())
        release()

    reachable(pile.sparkSession)
    return pile.repartition("top_conv", "top_depth").sortWithinPartitions("top_conv", "top_depth").mapInArrow(run, "conv long, depth long, n_leaves long, saved long")


def rollup(tree: DataFrame, paths: DataFrame, local_weight: int = LOCAL_WEIGHT) -> DataFrame:
    """(conv, depth, n_leaves, saved): childless nodes and own values, summed over each subtree.

    Components of up to ``local_weight`` (or a millionth of the whole weight) are split inside tasks.
    """
    root = tree.where("depth = 0").select("conv", "weight").first()
    bound = max(local_weight, root["weight"] // MOST_BROADCAST)
    top = ["top_conv", "top_depth"]
    state = tree.selectExpr(
        f"{root['conv']}L AS top_conv", "0L AS top_depth", f"{root['weight']}L AS whole", "conv", "depth", "coalesce(parent, -1L) AS parent", "weight",
        "CASE WHEN n_children = 0 THEN 1L ELSE 0L END AS leaf", "own", "0L AS more_leaves", "0L AS more_own")
    if root["weight"] <= bound:
        return _split_inside(state.drop("whole"), bound)
    small, done = [], []
    while True:
        # At most whole / bound components are over the bound, so their centroids may be broadcast.
        found = state.where("2 * weight >= whole").groupBy(*top).agg(F.max_by(F.struct("conv", "depth", "weight"), "depth").alias("c"))
        centres = settled(found.selectExpr(*top, "c.conv AS cc", "c.depth AS cd", "c.weight AS cw"))
        held = state.join(F.broadcast(centres), top)
        # What lies below: the centroid is the node at its depth on the way to the row; its child there names the new part.
        asked = held.where("depth > cd").select(*top, "conv", "cc", "cd").distinct()
        way = paths.selectExpr("conv", "depth AS cd", "node AS cc")
        kid = paths.selectExpr("conv", "depth - 1 AS cd", "node AS kid")
        below = asked.join(way, ["conv", "cd", "cc"], "left_semi").join(kid, ["conv", "cd"]).select(*top, "conv", "kid")
        cut = settled(_spread_join(held, below, [*top, "conv"], root["weight"], "left").selectExpr(
            "*", "conv = cc AND depth = cd AS centre", "coalesce(depth > cd AND kid IS NOT NULL, false) AS under"))
        sums = cut.where("centre OR under").groupBy(*top).agg(F.sum("leaf").alias("t_leaves"), F.sum("own").alias("t_own"))
        totals = centres.join(F.broadcast(sums), top)
        # One row for each node from a centroid up to its component's top.
        up = settled(paths.join(F.broadcast(totals.withColumnRenamed("cc", "conv")), "conv").where("depth BETWEEN top_depth AND cd").selectExpr(
            "node AS conv", "depth", "t_leaves", "t_own", "CASE WHEN depth < cd THEN cw ELSE 0L END AS less"))
        after = settled(cut.join(up, ["conv", "depth"], "left").selectExpr(
            "CASE WHEN under THEN kid ELSE top_conv END AS top_conv", "CASE WHEN under THEN cd + 1 ELSE top_depth END AS top_depth", "conv", "depth", "parent",
            "weight - coalesce(less, 0L) AS weight", "leaf", "own", "more_leaves + coalesce(t_leaves, 0L) AS more_leaves", "more_own + coalesce(t_own, 0L) AS more_own", "centre"))
        done.append(after.where("centre").selectExpr("conv", "depth", "more_leaves AS n_leaves", "more_own AS saved"))
        rest = after.where("NOT centre").drop("centre")
        large = settled(rest.where(f"conv = top_conv AND depth = top_depth AND weight > {bound}").selectExpr(*top, "weight AS whole"))
        if large.isEmpty():
            small.append(rest)
            break
        small.append(rest.join(F.broadcast(large), top, "left_anti"))
        state = settled(rest.join(F.broadcast(large), top))
    pile = small[0]
    for more in small[1:]:
        pile = pile.unionByName(more)
    out = _split_inside(pile, bound)
    for d in done:
        out = out.unionByName(d)
    return out


def end_digests(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends): SHA-256 of the ids that end at each node, ascending, joined by commas.

    Ids are sorted by range over all nodes. A task hashes the nodes that lie wholly inside its range;
    of its first and last node, whose other ids another task may hold, it gives the written-out ids,
    in pieces, which are hashed in their order in a second step.
    """
    ends = turns.where("depth = len").select("depth", "k1", "k2", "conv").unionByName(convs.where("len = 0").selectExpr("0L AS depth", "0L AS k1", "0L AS k2", "conv"))
    keys = ["k1", "k2", "depth"]
    schema = "k1 long, k2 long, depth long, first long, part binary, ends string"

    def made(found):
        return rows(**{k: pa.array([f[i] for f in found], kind) for i, (k, kind) in enumerate(
            [("k1", pa.int64()), ("k2", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("part", pa.binary()), ("ends", pa.string())])})

    def runs(batch):
        key = np.stack([batch.column(k).to_numpy() for k in keys])
        starts = np.flatnonzero((np.diff(key, axis=1) != 0).any(axis=0)) + 1
        cuts = [0, *starts.tolist(), key.shape[1]] if key.shape[1] else []
        for a, b in zip(cuts, cuts[1:]):
            yield tuple(key[:, a].tolist()), a, b

    def write(batches):
        out, seen, now, first, ids, size = [], 0, None, None, [], 0

        def close(last):
            nonlocal ids, size, seen
            text = ",".join(ids).encode()
            # The first and the last node of a range, and long lists, stay written out.
            whole = not last and seen > 0 and not split
            out.append((*now, first, None if whole else text, hashlib.sha256(text).hexdigest() if whole else None))
            ids, size, seen = [], 0, seen + 1

        split = False
        for batch in batches:
            conv = batch.column("conv").to_pylist()
            for key, a, b in runs(batch):
                if key != now:
                    if now is not None:
                        close(False)
                    now, first, split = key, conv[a], False
                for c in conv[a:b]:
                    if size > PIECE:
                        out.append((*now, first, ",".join(ids).encode(), None))
                        ids, size, first, split = [], 0, c, True
                    ids.append(str(c))
                    size += len(ids[-1]) + 1
            if len(out) > 4096 or sum(len(o[4] or b"") for o in out) > PIECE:
                yield made(out)
                out = []
        if now is not None:
            close(True)
            yield made(out)

    def finish(batches):
        now, hashed, out = None, None, []
        for batch in batches:
            part = batch.column("part")
            for key, a, b in runs(batch):
                if key != now:
                    if now is not None:
                        out.append((*now, None, None, hashed.hexdigest()))
                    now, hashed = key, None
                for i in range(a, b):
                    text = part[i].as_py()
                    if hashed is None:
                        hashed = hashlib.sha256(text)
                    else:
                        hashed.update(b"," + text)
            if out:
                yield made(out)
                out = []
        if now is not None:
            yield made([*out, (*now, None, None, hashed.hexdigest())])

    reachable(turns.sparkSession)
    ends = settled(ends)
    first = settled(ends.repartitionByRange(*keys, "conv").sortWithinPartitions(*keys, "conv").mapInArrow(write, schema))
    rest = first.where("part IS NOT NULL").repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(finish, schema)
    return first.where("part IS NULL").unionByName(rest).select(*keys, "ends")


def nodes(conversations: DataFrame, local_weight: int = LOCAL_WEIGHT) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    turns, convs = rebuilt(conversations)
    if convs.isEmpty():
        return conversations.sparkSession.createDataFrame([], schema)
    tree, paths = trie(turns, convs)
    sums = rollup(tree, paths, local_weight)
    ends = end_digests(turns, convs)
    whole = tree.join(sums, ["conv", "depth"]).join(ends, ["k1", "k2", "depth"], "left")
    return whole.selectExpr("conv AS conv_id", "depth", "parent AS parent_conv_id", "n_convs", "n_children", "n_leaves", "saved AS saved_tokens", f"coalesce(ends, '{hashlib.sha256(b'').hexdigest()}') AS ends_sha256")
