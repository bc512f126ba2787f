"""Parent-child rows to full hierarchies: path, depth, root and subtree of every node, by leaf peeling."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.session import cut, small

#: Trees of up to so many rows are peeled inside one task, many trees at once; larger ones level by level over the cluster, in steps that double.
LOCAL_NODES = 5_000

#: About so many rows of descendant lists leave a task at a time.
LIST_ROWS = 500_000

#: A node is hot if more than 1 / HOT_SHARE of the rows look for it, so at most HOT_SHARE are.
HOT_SHARE = 2_000

OUT_SCHEMA = "tree bigint, node bigint, state string, path string, depth int, root bigint, subtree_size bigint"


def _positions(rank: np.ndarray, node: np.ndarray, wanted: np.ndarray, has: np.ndarray) -> np.ndarray:
    """For each row the position of the node `wanted` in the same tree, -1 where there is none. Rows are sorted by tree and node."""
    codes = np.unique(node)
    at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
    found = has & (codes[at] == wanted)
    keys = rank * len(codes) + np.searchsorted(codes, node)
    seek = rank * len(codes) + at
    pos = np.minimum(np.searchsorted(keys, seek), len(keys) - 1)
    return np.where(found & (keys[pos] == seek), pos, -1)


def _owners(node: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The position of the node whose left child leads to each position, directly or along right siblings; -1 for none.

    The smallest owner or predecessor counts if there are several. Pointers are doubled, so a chain of n siblings takes
    log n rounds; a chain that runs in a ring has no owner.
    """
    n = len(node)
    label, pred = np.full(n, -1), np.full(n, -1)
    for target, into in ((left, label), (right, pred)):
        have = np.flatnonzero(target >= 0)[::-1]  # later assignments win, so the smallest node does
        into[target[have]] = have
    for _ in range(n.bit_length() + 1):
        open_ = np.flatnonzero((label < 0) & (pred >= 0))
        if not len(open_):
            break
        label[open_] = label[pred[open_]]
        pred[open_] = pred[pred[open_]]
    return label


def _peel(rank, node, parent, has_parent, is_root, left, has_left, right, has_right):
    """Peel the leaves of all trees of a batch round by round, each sending its subtree size to its parent; what is left are cycles."""
    n = len(node)
    up = _positions(rank, node, parent, has_parent)
    is_root = is_root.copy()
    if left is not None:
        unknown = ~has_parent & ~is_root
        if unknown.any():
            owner = _owners(node, _positions(rank, node, left, has_left), _positions(rank, node, right, has_right))
            up = np.where(unknown, owner, up)
            is_root |= unknown & (owner < 0)
    up = np.where(is_root, -1, up)
    waiting = np.bincount(up[up >= 0], minlength=n)
    size = np.ones(n, dtype=np.int64)
    rounds, leaves = [], np.flatnonzero(waiting == 0)
    while len(leaves):
        rounds.append(leaves)
        above = leaves[up[leaves] >= 0]
        np.add.at(size, up[above], size[above])
        np.subtract.at(waiting, up[above], 1)
        touched = np.unique(up[above])
        leaves = touched[waiting[touched] == 0]
    return node, up, is_root, waiting, size, rounds


def _placed(node, up, is_root, waiting, size, rounds) -> dict[str, list]:
    """Path, depth and root of every node, in the reverse order of the peeling."""
    n = len(node)
    state = np.full(n, "cycle", dtype=object)
    way: list = [None] * n
    depth, root = np.full(n, -1), np.full(n, -1)
    text = node.astype(str).tolist()
    ups, roots = up.tolist(), is_root.tolist()
    size[waiting > 0] = -1
    for leaves in reversed(rounds):
        for i in leaves.tolist():
            p = ups[i]
            # a node on a cycle has no way, so one that hangs from it starts its own
            way[i] = text[i] if p < 0 or way[p] is None else f"{way[p]}/{text[i]}"
            if p < 0:
                if roots[i]:
                    state[i], depth[i], root[i] = "tree", 0, i
                else:
                    state[i] = "dangling"
            else:
                state[i] = state[p]
                if root[p] >= 0:
                    depth[i], root[i] = depth[p] + 1, root[p]
    ok = root >= 0
    path = [w if r else None for w, r in zip(way, ok.tolist())]
    return {"state": state, "path": path, "way": way, "depth": pa.array(depth, pa.int32(), mask=~ok), "root": pa.array(node[root], pa.int64(), mask=~ok), "size": pa.array(size, pa.int64(), mask=size < 0)}


def _lists(node, up, is_root, waiting, size, rounds) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The descendant lists that the peeling sends upwards, some at a time: position of the node, position of its descendant, distance.

    A node's list is its children, each followed by the child's own list, so all lists of a tree are slices of one order,
    in which each node takes the place that its parent has kept for it.
    """
    n = len(node)
    free, place, level = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n, np.int64)
    filled = 0
    for leaves in reversed(rounds):
        p = up[leaves]
        held = (p >= 0) & (waiting[np.maximum(p, 0)] == 0)
        tops, kids = leaves[~held], leaves[held]
        place[tops] = filled + np.cumsum(size[tops]) - size[tops]
        filled += int(size[tops].sum())
        if len(kids):
            kids = kids[np.argsort(up[kids], kind="stable")]
            p = up[kids]
            upto = np.cumsum(size[kids]) - size[kids]  # sizes of the kids before, counted from the first kid of the same parent
            first = np.concatenate([[True], p[1:] != p[:-1]])
            before = upto - np.repeat(upto[first], np.diff(np.append(np.flatnonzero(first), len(p))))
            place[kids] = free[p] + before
            np.add.at(free, p, size[kids])
            level[kids] = level[p] + 1
        free[leaves] = place[leaves] + 1
    order = np.empty(filled, np.int64)
    on = np.flatnonzero(place >= 0)
    order[place[on]] = on
    owners = on[size[on] > 1]
    n_of = size[owners] - 1
    part = np.cumsum(n_of) // LIST_ROWS
    for lo, hi in zip(starts := np.searchsorted(part, np.unique(part)), [*starts[1:], len(owners)]):
        own, n_own = owners[lo:hi], n_of[lo:hi]
        owner = np.repeat(own, n_own)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(n_own) - n_own, n_own) + np.repeat(place[own] + 1, n_own)
        below = order[at]
        yield owner, below, level[below] - level[owner]


def _numbers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    has = col.is_valid().to_numpy(zero_copy_only=False)
    return col.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), has


def _peel_batches(batches: Iterator[pa.RecordBatch], ways: bool = False, lists: bool = False) -> Iterator[pa.RecordBatch]:
    """Batches are sorted by tree and node; the last tree of a batch waits for the next batch."""
    rest: list[pa.RecordBatch] = []

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        t = {c: table.column(c).combine_chunks() for c in table.column_names}
        t = {k: v.chunk(0) if isinstance(v, pa.ChunkedArray) else v for k, v in t.items()}
        tree, _ = _numbers(t["tree"])
        rank = np.cumsum(np.concatenate([[0], tree[1:] != tree[:-1]]))
        node, _ = _numbers(t["node"])
        parent, has_parent = _numbers(t["parent"])
        is_root = t["is_root"].fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
        left, has_left = _numbers(t["left_child"])
        right, has_right = _numbers(t["right_sib"])
        peeled = _peel(rank, node, parent, has_parent, is_root, left if t["linked"][0].as_py() else None, has_left, right, has_right)
        if lists:
            for owner, below, apart in _lists(*peeled):
                yield pa.RecordBatch.from_arrays([pa.array(tree[owner]), pa.array(node[owner]), pa.array(node[below]), pa.array(apart.astype(np.int32))], names=["tree", "node", "descendant", "distance"])
            return
        r = _placed(*peeled)
        more = [pa.array(r["way"], pa.string())] if ways else []
        yield pa.RecordBatch.from_arrays(
            [t["tree"], t["node"], pa.array(r["state"], pa.string()), pa.array(r["path"], pa.string()), r["depth"], r["root"], r["size"], *more],
            names=["tree", "node", "state", "path", "depth", "root", "subtree_size", *["way"] * ways],
        )

    for b in batches:
        if not b.num_rows:
            continue
        tree = b.column("tree").to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(tree, tree[-1]))
        if last == 0 and (not rest or rest[-1].column("tree")[-1].as_py() == tree[-1]):
            rest.append(b)
            continue
        # rows before `last` end the trees that wait
        yield from solve(pa.Table.from_batches([*rest, b.slice(0, last)]))
        rest = [b.slice(last)]
    if rest:
        yield from solve(pa.Table.from_batches(rest))


def _climb(left: DataFrame, right: DataFrame, on: str, rows: int) -> DataFrame:
    """Inner join of left's (tree, `on`) with right, one row per (tree, `on`); nodes that many rows look for go by broadcast, so no task gathers them."""
    keys = ["tree", on]
    if small(right):
        return left.join(F.broadcast(right), keys)
    hot = cut(left.groupBy(*keys).count().filter(F.col("count") > max(rows // HOT_SHARE, 10_000)).select(*keys), "hot")
    by_broadcast = left.join(F.broadcast(right.join(F.broadcast(hot), keys, "left_semi")), keys)
    return by_broadcast.unionByName(left.join(F.broadcast(hot), keys, "left_anti").join(right, keys))


def _owners_by_joins(nodes: DataFrame) -> DataFrame:
    """tree, node, label: _owners over the cluster, by pointers that double until none is open; a ring never ends and is left after as many rounds as its length allows."""
    owner = nodes.filter("left_child is not null").groupBy("tree", F.col("left_child").alias("node")).agg(F.min("node").alias("label"))
    pred = nodes.filter("right_sib is not null").groupBy("tree", F.col("right_sib").alias("node")).agg(F.min("node").alias("pred"))
    chain = cut(nodes.select("tree", "node").join(owner, ["tree", "node"], "left").join(pred, ["tree", "node"], "left"), "chain")
    rows = chain.count()
    for _ in range(rows.bit_length() + 1):
        open_ = chain.filter("label is null and pred is not null")
        if open_.isEmpty():
            break
        step = chain.select("tree", F.col("node").alias("pred"), F.col("label").alias("l2"), F.col("pred").alias("p2"))
        moved = _climb(open_.select("tree", "node", "pred"), step, "pred", rows).select("tree", "node", F.col("l2").alias("label"), F.when(F.col("l2").isNull(), F.col("p2")).alias("pred"))
        chain = cut(chain.filter("label is not null or pred is null").select("tree", "node", "label", "pred").unionByName(moved), "chain")
    return chain.select("tree", "node", "label")


def _by_doubling(nodes: DataFrame, linked: bool, paths: bool) -> DataFrame:
    """The same result for trees that don't fit one task, in rounds that grow with the logarithm of the depth.

    First the 2^j-th ancestors of all nodes are found for growing j; nodes that still have one when 2^j exceeds the rows
    stand above a cycle, and those ancestors are the cycles: the residue that no peeling reaches. Without them the rest is a
    forest. There round j joins each node that isn't placed with its 2^j-th ancestor, whose way it puts before its own,
    while it sends its subtree size up by 2^j levels, so each round does what 2^j rounds of single peeling do. Leaves that are
    placed leave; every round is written, so nothing is recomputed.
    """
    nodes = cut(nodes.select("tree", "node", "parent", "is_root", "left_child", "right_sib"), "tree")
    if linked:
        unknown = F.col("parent").isNull() & ~F.col("is_root")
        nodes = nodes.join(_owners_by_joins(nodes), ["tree", "node"], "left").select(
            "tree", "node", F.when(unknown, F.col("label")).otherwise(F.col("parent")).alias("parent"), (F.col("is_root") | (unknown & F.col("label").isNull())).alias("is_root")
        )
    nodes = cut(nodes.select("tree", "node", F.when(~F.col("is_root"), F.col("parent")).alias("up"), "is_root"), "up")
    rows = nodes.count()
    known = nodes.select("tree", F.col("node").alias("up"))
    wanted = nodes.filter("up is not null").select("tree", "up").distinct()
    inner = cut(wanted.join(known, ["tree", "up"]), "inner")  # nodes with children; small for a star, however many children it has
    up = _climb(nodes.filter("up is not null"), inner, "up", rows)
    base = up.unionByName(_not_in(nodes.filter("up is not null"), inner, rows).withColumn("up", F.lit(None).cast("bigint"))).unionByName(nodes.filter("up is null"))
    base = cut(base.join(inner.select("tree", F.col("up").alias("node"), F.lit(True).alias("inner")), ["tree", "node"], "left").withColumn("inner", F.coalesce("inner", F.lit(False))), "base")

    jump = base.filter("up is not null").select("tree", "node", "up", "inner")
    for _ in range(rows.bit_length() + 1):
        if jump.isEmpty():
            break
        step = jump.filter("inner").select("tree", F.col("node").alias("up"), F.col("up").alias("next"))
        jump = cut(_climb(jump, step, "up", rows).select("tree", "node", F.col("next").alias("up"), "inner"), "jump")
    ring = jump.select("tree", "up").distinct()
    if not ring.isEmpty():
        ring = cut(ring, "ring")
        on_ring = ring.select("tree", F.col("up").alias("node"), F.lit(True).alias("on_ring"))
        base = base.join(on_ring, ["tree", "node"], "left").filter("on_ring is null").drop("on_ring")
        hang = _climb(base.filter("up is not null"), ring, "up", rows).withColumn("up", F.lit(None).cast("bigint")).withColumn("hangs", F.lit(True))
        base = cut(_not_in(base.filter("up is not null"), ring, rows).unionByName(base.filter("up is null")).withColumn("hangs", F.lit(False)).unionByName(hang), "forest")
    else:
        base = base.withColumn("hangs", F.lit(False))

    here = F.col("node").cast("string")
    top = F.col("up").isNull()
    cur = base.select(
        "tree", "node", "up", "inner", F.when(F.col("hangs"), "cycle").when(top & F.col("is_root"), "tree").when(top, "dangling").alias("state"),
        (here if paths else F.lit(None).cast("string")).alias("way"), F.lit(0).alias("depth"), F.when(top, F.col("node")).alias("root"), F.lit(1).cast("bigint").alias("subtree_size"),
    )
    done = []
    for j in count():
        cur = cut(cur, "placed")
        done.append(cur.filter("up is null and not inner"))
        active = cur.filter("up is not null")
        if active.isEmpty():
            done.append(cur.filter("inner"))
            break
        above = cur.filter("inner").select("tree", F.col("node").alias("up"), F.col("up").alias("u2"), F.col("way").alias("w2"), F.col("depth").alias("d2"), F.col("root").alias("r2"), F.col("state").alias("s2"))
        moved = _climb(active, above, "up", rows).select(
            "tree", "node", F.col("u2").alias("up"), "inner", F.col("s2").alias("state"), F.concat_ws("/", "w2", "way").alias("way") if paths else "way",
            # right as soon as the ancestor, 2^j levels up, is placed itself
            (F.col("d2") + F.lit(2**j)).cast("int").alias("depth"), F.col("r2").alias("root"), "subtree_size",
        )
        sent = active.groupBy("tree", F.col("up").alias("node")).agg(F.sum("subtree_size").alias("sent"))
        kept = moved.unionByName(cur.filter("up is null and inner"))
        grown = kept.filter("inner").join(sent, ["tree", "node"], "left").withColumn("subtree_size", F.col("subtree_size") + F.coalesce("sent", F.lit(0))).drop("sent")
        cur = grown.unionByName(kept.filter("not inner"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    ok = F.col("state") == "tree"
    out = out.select("tree", "node", "state", F.when(ok, F.col("way")).alias("path"), F.when(ok, F.col("depth")).alias("depth"), F.when(ok, F.col("root")).alias("root"), "subtree_size", "way")
    null = lambda t: F.lit(None).cast(t)
    return out.unionByName(ring.select("tree", F.col("up").alias("node"), F.lit("cycle").alias("state"), null("string").alias("path"), null("int").alias("depth"), null("bigint").alias("root"), null("bigint").alias("subtree_size"), null("string").alias("way")))


def _not_in(left: DataFrame, right: DataFrame, rows: int) -> DataFrame:
    """Rows of left whose (tree, up) right lacks; hot ones are looked up by broadcast."""
    keys = ["tree", "up"]
    if small(right):
        return left.join(F.broadcast(right), keys, "left_anti")
    hot = cut(left.groupBy(*keys).count().filter(F.col("count") > max(rows // HOT_SHARE, 10_000)).select(*keys), "hot")
    known = F.broadcast(right.join(F.broadcast(hot), keys, "left_semi"))
    of_hot = left.join(F.broadcast(hot), keys, "left_semi").join(known, keys, "left_anti")
    return of_hot.unionByName(left.join(F.broadcast(hot), keys, "left_anti").join(right, keys, "left_anti"))


def _given(nodes: DataFrame, local_nodes: int) -> tuple[DataFrame, DataFrame | None, bool]:
    """One row per node, written once: those of trees that fit a task, those of larger trees (None if there are none), and whether links are given."""
    linked = "left_child" in nodes.columns
    cols = [F.col(c).cast("bigint").alias(c) for c in ("tree", "node", "parent")] + [F.coalesce("is_root", F.lit(False)).alias("is_root")]
    cols += [F.col(c).cast("bigint").alias(c) if linked else F.lit(None).cast("bigint").alias(c) for c in ("left_child", "right_sib")]
    given = cut(nodes.select(*cols).filter("tree is not null and node is not null"), "nodes")
    one_each = lambda df: df.groupBy("tree", "node").agg(F.max(F.struct("is_root", "parent", "left_child", "right_sib")).alias("m")).select("tree", "node", "m.*")
    large = given.groupBy("tree").count().filter(F.col("count") > local_nodes).select("tree")
    if large.isEmpty():
        return one_each(given.repartition("tree")), None, linked
    large = cut(large, "large")
    apart = F.broadcast(large) if small(large) else large
    # large trees leave before rows are spread by tree, so one shuffle serves both the latest row of a node and the peeling
    return one_each(given.join(apart, "tree", "left_anti").repartition("tree")), one_each(given.join(apart, "tree", "left_semi")), linked


def hierarchy(nodes: DataFrame, local_nodes: int = LOCAL_NODES, ways: bool = False, paths: bool = True) -> DataFrame:
    """Path, depth, root and subtree size of each node: tree, node, state, path, depth, root, subtree_size.

    nodes: tree, node, parent (bigint), is_root (boolean), and perhaps left_child and right_sib, from which the parent of a
    node that is no root and has none stored is taken: the node whose left child leads to it, directly or along right
    siblings; a node that none leads to is then a root.

    Leaves are peeled round by round and send their subtree sizes to their parents; what can't be peeled are cycles; then
    the rounds are gone through backwards and each node takes path, depth and root from its parent. `state` is `tree`,
    `cycle` (the way up runs into a cycle) or `dangling` (it ends at a node that is neither a root nor has a parent in the
    tree); path, depth and root are null unless it is `tree`, subtree_size is null on a cycle. Root depth is 0. With `ways` a
    last column `way` holds the path from the topmost node above that isn't on a cycle, whatever the state; it is null on a cycle.

    The rows are written once. Trees of up to local_nodes rows are spread by tree and peeled in Arrow batches, many at once;
    trees above that are placed by joins over the whole cluster whose steps double, with the same results, so no task holds
    more than local_nodes rows of a tree and a tree of depth n takes about 2 log n rounds. Paths grow with the square of the
    depth of a chain; with paths=False those of such large trees are left null and everything else is given.
    Rows without tree or node are no nodes; of several rows of a node the largest (parent, links) counts; other columns
    are ignored; an empty table gives an empty result.
    """
    local, big, linked = _given(nodes, local_nodes)
    out = local.withColumn("linked", F.lit(linked)).sortWithinPartitions("tree", "node").mapInArrow(lambda batches: _peel_batches(batches, ways), OUT_SCHEMA + ", way string" * ways)
    return out if big is None else out.unionByName(_by_doubling(big, linked, paths).select(*out.columns))


def descendants(nodes: DataFrame, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """tree, node, descendant, distance: every descendant of every node of hierarchy()'s trees, one row each.

    The lists are what peeled leaves send to their parents: in a tree that fits a task they are slices of one order, written
    out as rows. The lists of larger trees wouldn't fit one and are read off the ways. Nodes that dangle or hang from a cycle
    have their descendants too; nodes on a cycle have none.
    """
    local, big, linked = _given(nodes, local_nodes)
    out = local.withColumn("linked", F.lit(linked)).sortWithinPartitions("tree", "node").mapInArrow(lambda batches: _peel_batches(batches, lists=True), "tree bigint, node bigint, descendant bigint, distance int")
    return out if big is None else out.unionByName(descendant_rows(_by_doubling(big, linked, True)))


def with_verdict(h: DataFrame) -> DataFrame:
    """hierarchy() with the state in place of a missing path."""
    return h.withColumn("path", F.coalesce("path", "state"))


def descendant_rows(h: DataFrame) -> DataFrame:
    """tree, node, descendant, distance: every descendant of every node of a result of hierarchy(), read off the ways; one row each, so no list grows with a tree.

    From hierarchy(ways=True) each node with a subtree_size has its subtree_size - 1 descendants, those that dangle or hang
    from a cycle too; nodes on a cycle have none. From hierarchy() alone, only nodes with a path are covered.
    """
    way = "way" if "way" in h.columns else "path"
    up = h.filter(F.col(way).isNotNull()).select("tree", F.col("node").alias("descendant"), F.split(way, "/").alias("ns"))
    up = up.select("tree", "descendant", (F.size("ns") - 1).alias("last"), F.posexplode("ns").alias("p", "n"))
    return up.filter(F.col("p") < F.col("last")).select("tree", F.col("n").cast("bigint").alias("node"), "descendant", (F.col("last") - F.col("p")).alias("distance"))
