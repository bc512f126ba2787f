import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import hierarchy as h

SCHEMA = "tree bigint, node bigint, parent bigint, is_root boolean, path string, size int"


def brute(nodes, links=None):
    """(tree, node) -> state, path, depth, root, size by walking up from every node."""
    out, parent = {}, {}
    trees = {}
    for t, n, p, r in nodes:
        trees.setdefault(t, {})[n] = (p, r)
    for t, T in trees.items():
        lead = {}
        for q in sorted(T):
            x, seen = (links or {}).get((t, q), (None, None))[0], set()
            while x is not None and x in T and x not in seen:
                seen.add(x)
                lead.setdefault(x, q)
                x = links[t, x][1]
        for n, (p, r) in T.items():
            if links is not None and p is None and not r:
                p, r = lead.get(n), n not in lead
            parent[t, n] = (p, r)
    for t, n in parent:
        way, x = [], n
        while True:
            if (t, x) not in parent:
                state = "dangling"
                break
            if x in way:
                state = "cycle"
                break
            way.append(x)
            p, r = parent[t, x]
            if r:
                state = "tree"
                break
            if p is None:
                state = "dangling"
                break
            x = p
        out[t, n] = (state, "/".join(map(str, reversed(way))) if state == "tree" else None)
    return out


def random_nodes(seed, trees=30, most=25):
    rnd, nodes, links = random.Random(seed), [], {}
    for t in range(trees):
        n = rnd.randint(1, most)
        ids = rnd.sample(range(1000), n)
        for i, x in enumerate(ids):
            kind = rnd.random()
            p = None if i == 0 or kind < 0.05 else rnd.choice(ids) if kind < 0.2 else 5000 if kind < 0.22 else ids[rnd.randrange(i)]
            nodes.append((t, x, p, i == 0))
        for x in ids:
            links[t, x] = (None, None)
        kids = {}
        for tt, x, p, r in nodes:
            if tt == t and p in ids and not r:
                kids.setdefault(p, []).append(x)
        for p, ks in kids.items():
            links[t, p] = (ks[0], links[t, p][1])
            for a, b in zip(ks, ks[1:]):
                links[t, a] = (links[t, a][0], b)
    return nodes, links


def check(rows, want):
    assert {(r.tree, r.node): (r.state, r.path) for r in rows} == want
    by = {(r.tree, r.node): r for r in rows}
    for r in rows:
        if r.path:
            way = [int(x) for x in r.path.split("/")]
            assert r.depth == len(way) - 1 and r.root == way[0]
            assert r.subtree_size == sum(1 for o in rows if o.tree == r.tree and o.path and (o.path + "/").startswith(r.path + "/"))
        elif r.state == "cycle" and r.subtree_size is None:
            assert by[r.tree, r.node].depth is None


@pytest.mark.parametrize("seed", [1, 2])
def test_random_trees(spark, seed):
    nodes, _ = random_nodes(seed)
    df = spark.createDataFrame([(*n, "clash", 1) for n in nodes], SCHEMA)
    check(h.hierarchy(df).collect(), brute(nodes))


def test_joins_give_the_same(spark):
    nodes, links = random_nodes(3, trees=4, most=12)
    hidden = [(t, n, p if (n % 3 or r) else None, r) for t, n, p, r in nodes]
    rows = [(t, n, p, r, *links[t, n]) for t, n, p, r in hidden]
    df = spark.createDataFrame(rows, "tree bigint, node bigint, parent bigint, is_root boolean, left_child bigint, right_sib bigint")
    local = sorted(tuple(r) for r in h.hierarchy(df).collect())
    assert local == sorted(tuple(r) for r in h.hierarchy(df, local_nodes=5).collect())
    check(h.hierarchy(df).collect(), brute(hidden, links))


def test_special_rows(spark):
    rows = [(None, 1, None, True), (1, None, 1, False), (1, 1, None, True), (1, 1, None, True), (1, 2, 1, None), (1, 3, 3, False), (2, 5, 6, False), (2, 6, 5, False), (2, 7, 6, False), (3, 1, None, False), (4, -7, None, True), (4, 2**62, -7, False)]
    df = spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)
    got = {(r.tree, r.node): r.path or r.state for r in h.hierarchy(df).collect()}
    assert got == {(1, 1): "1", (1, 2): "1/2", (1, 3): "cycle", (2, 5): "cycle", (2, 6): "cycle", (2, 7): "cycle", (3, 1): "dangling", (4, -7): "-7", (4, 2**62): f"-7/{2**62}"}
    assert h.hierarchy(df.limit(0)).count() == 0


def test_many_batches(spark):
    # trees that reach over several Arrow batches, and a chain as long as a task may hold
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(1000).selectExpr("id div 50 as tree", "id % 50 as node", "case when id % 50 > 0 then id % 50 - 1 end as parent", "id % 50 = 0 as is_root")
        rows = h.hierarchy(df).collect()
        assert len(rows) == 1000 and all(r.depth == r.node and r.subtree_size == 50 - r.node for r in rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_descendants(spark):
    df = spark.createDataFrame([(1, 1, None, True), (1, 2, 1, False), (1, 3, 2, False), (1, 4, 1, False), (1, 9, 9, False)], "tree bigint, node bigint, parent bigint, is_root boolean")
    got = {(r.node, r.descendant, r.distance) for r in h.descendant_rows(h.hierarchy(df)).collect()}
    assert got == {(1, 2, 1), (1, 3, 2), (1, 4, 1), (2, 3, 1)}


def test_descendants_off_the_trees(spark):
    # below a missing parent (2 -> 3 -> 4) and below a cycle (5 <-> 6, 7 -> 8)
    rows = [(1, 1, None, True), (1, 2, 99, False), (1, 3, 2, False), (1, 4, 3, False), (1, 5, 6, False), (1, 6, 5, False), (1, 7, 6, False), (1, 8, 7, False)]
    df = spark.createDataFrame(rows, "tree bigint, node bigint, parent bigint, is_root boolean")
    for most in (h.LOCAL_NODES, 3):
        got = {(r.node, r.descendant, r.distance) for r in h.descendant_rows(h.hierarchy(df, local_nodes=most, ways=True)).collect()}
        assert got == {(2, 3, 1), (2, 4, 2), (3, 4, 1), (7, 8, 1)}


def test_descendants_of_both_sources(spark, data):
    from spanloom.plans import problems

    n = {(r.source, r.tree, r.node): r.n for r in problems.p6_descendants(spark, data).groupBy("source", "tree", "node").agg(F.count("*").alias("n")).collect()}
    want = {(r.source, r.tree, r.node): r.subtree_size - 1 for r in problems.p6_hierarchies(spark, data).collect() if (r.subtree_size or 0) > 1}
    assert n == want and {s for s, _, _ in n} == {"constituents", "conllu"}


def test_owner_pointers_double():
    n = 1000
    left, right = np.full(n, -1), np.full(n, -1)
    left[0] = 1
    right[1:n - 1] = np.arange(2, n)
    assert (h._owners(np.arange(n), left, right)[1:] == 0).all()


def test_doubling_gives_the_same(spark):
    nodes, links = random_nodes(10, trees=6, most=30)
    hidden = [(t, n, p if (n % 3 or r) else None, r) for t, n, p, r in nodes]
    df = spark.createDataFrame([(t, n, p, r, *links[t, n]) for t, n, p, r in hidden], "tree bigint, node bigint, parent bigint, is_root boolean, left_child bigint, right_sib bigint")
    local, large = h.hierarchy(df, ways=True), h.hierarchy(df, local_nodes=3, ways=True).collect()
    assert sorted(map(str, local.collect())) == sorted(map(str, large))
    want = sorted(map(tuple, h.descendant_rows(local).collect()))
    assert want == sorted(map(tuple, h.descendants(df).collect())) == sorted(map(tuple, h.descendant_rows(spark.createDataFrame(large, local.schema)).collect()))


def test_large_trees(spark):
    # a chain, a star and a ring with a tail, all above what a task takes
    n = 1_500
    chain = spark.range(n).selectExpr("1L as tree", "id as node", "case when id > 0 then id - 1 end as parent", "id = 0 as is_root")
    star = spark.range(40_000).selectExpr("2L as tree", "id as node", "case when id > 0 then 0L end as parent", "id = 0 as is_root")
    ring = spark.range(600).selectExpr("3L as tree", "id as node", "case when id = 0 then 99L else id - 1 end as parent", "false as is_root")
    rows = h.hierarchy(chain.union(star).union(ring), local_nodes=500, paths=False).collect()
    assert len(rows) == n + 40_600
    for r in rows:
        if r.tree == 1:
            assert (r.state, r.depth, r.root, r.subtree_size) == ("tree", r.node, 0, n - r.node)
        elif r.tree == 2:
            assert (r.state, r.depth, r.subtree_size) == ("tree", 0, 40_000) if r.node == 0 else ("tree", 1, 1)
        else:
            assert (r.state, r.subtree_size) == ("cycle", None if r.node < 100 else 600 - r.node)
