import random

import pytest
from pyspark.sql import functions as F

from spanloom.config import Options
from spanloom.functions import strings
from spanloom.operators import counts, layers, learning, trees


def test_extents_against_walk(spark):
    rnd = random.Random(3)
    nodes = []
    for t in range(20):
        n = rnd.randint(1, 15)
        order = rnd.sample(range(1, n + 1), n)
        nodes += [(t, x, None if i == 0 else order[rnd.randrange(i)]) for i, x in enumerate(order)]
    nodes += [(99, 1, 1), (99, 2, 77)]
    df = spark.createDataFrame(nodes, "tree bigint, node bigint, parent bigint")
    kids = {}
    for t, x, p in nodes:
        kids.setdefault((t, p), []).append(x)
    want = {}
    for t, x, _ in nodes:
        if (t, x) == (99, 1):
            continue
        lo = hi = x
        cur = x
        while (t, cur) in kids:
            hi = max(hi, *kids[t, cur])
            cur = min(kids[t, cur])
            lo = min(lo, cur)
        want[t, x] = (lo, hi + 1)
    assert {(r.tree, r.node): (r.start, r.end) for r in trees.extents(df).collect()} == want


def test_bracketed(spark):
    rows = [(1, 0, None, "S", 0, None), (1, 1, 0, "NP", 1, None), (1, 2, 1, "NN", 2, "dog"), (1, 3, 0, "VBZ", 3, "runs")]
    df = spark.createDataFrame(rows, "tree int, node int, parent int, label string, ord int, word string")
    assert trees.bracketed(df).head().text == "(S (NP (NN dog)) (VBZ runs))"


def test_siblings_and_children(spark):
    df = spark.createDataFrame([(1, 0, None, 0), (1, 1, 0, 2), (1, 2, 0, 1)], "tree int, node int, parent int, ord int")
    got = {r.node: (r.left_sib, r.right_sib, r.ord_in_parent) for r in trees.siblings(df).collect()}
    assert got[2] == (None, 1, 0) and got[1] == (2, None, 1)
    r = trees.child_summary(df).head()
    assert (r.left_child, r.right_child, r.n_children) == (2, 1, 2)


def test_layers(spark):
    tok = spark.createDataFrame([(1, 0, 3), (1, 0, 4), (1, 1, 3), (1, 1, 5), (1, 0, 3)], "d int, m int, t int")
    assert [r[:] for r in layers.contiguous_mentions(tok, ["d", "m"], "t").collect()] == [(1, 0, 3, 4)]
    parts = spark.createDataFrame([(1, 2, 4), (1, 7, 9)], "s int, first int, last int")
    assert layers.spans_of_parts(parts, ["s"], "first", "last").head()[:] == (1, 2, 9, 2)
    pred = spark.createDataFrame([(1, 5, 5)], "s int, first int, last int")
    args = spark.createDataFrame([(1, "A1", 7, 8), (1, "A0", 1, 2)], "s int, role string, first int, last int")
    assert [(r.part, r.role) for r in layers.situations(pred, args, ["s"]).orderBy("part").collect()] == [(0, "predicate"), (1, "A0"), (2, "A1")]
    sets = spark.createDataFrame([("e", "b"), ("e", "a"), ("f", "c")], "e string, m string")
    assert {r.e: r.mentions for r in layers.entity_sets(sets, "e", "m").collect()} == {"e": ["a", "b"], "f": ["c"]}
    with pytest.raises(ValueError):
        layers.entity_sets(sets.union(spark.createDataFrame([("f", "a")], sets.schema)), "e", "m")
    nodes = spark.createDataFrame([(1, 0, None, None), (1, 1, 0, None), (1, 2, 1, "dog")], "k int, node int, parent int, word string")
    assert sorted(r.node for r in layers.without_word_leaves(nodes, "k").collect()) == [0, 1]


def test_options(tmp_path):
    o = Options(["--n", "5", "--quiet", "--map", "a:1,b:2", "--shard", "1/3"], {"rate": "0.5"})
    assert (o.whole("n"), o.flag("quiet"), o.mapping("map"), o.shard(), o.real("rate"), o.text("other", "x"), o.flag("loud")) == (5, True, {"a": "1", "b": "2"}, (1, 3), 0.5, "x", False)
    assert o.asked["other"] == "x" and o.existing("path", str(tmp_path)) == str(tmp_path)
    for bad in (lambda: o.text("missing"), lambda: o.existing("p", "/no/such"), lambda: o.exclusive("n", "quiet"), lambda: Options(["--m", "a:1,a:2"]).mapping("m"), lambda: Options(["x"])):
        with pytest.raises((KeyError, ValueError, FileNotFoundError)):
            bad()
    o.exclusive("n", "absent")


def test_presentation_and_loss(spark):
    df = spark.createDataFrame([(["a", "bb", "c"], [1.0, -3.0, 0.5])], "n array<string>, w array<double>")
    assert df.select(strings.show_weights(F.col("n"), F.col("w"), 20)).head()[0] == "-1.50 bb:-3.00 and 2 more"
    r = spark.range(1).select(learning.muted(F.lit(2.0), False), learning.muted(F.lit(2.0)), learning.loss_augmented(F.lit(1.0), F.lit(False), 0.5), learning.loss_augmented(F.lit(1.0), F.lit(True), 0.5), learning.loss_augmented(F.lit(1.0), F.lit(False), 0.5, searching=False)).head()
    assert r[:] == (0.0, 2.0, 1.5, 1.0, 1.0)


def test_multimaps(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("a", 2), (None, 5)], "k string, v int")
    assert {r.k: (r.vals, r.n) for r in counts.collect_values(df, "k", "v").collect()} == {"a": ([1, 2, 2], 3), None: ([5], 1)}
    assert {r.k: r.vals for r in counts.collect_unique(df, "k", "v").collect()} == {"a": [1, 2], None: [5]}


def test_long_lists_come_in_parts(spark):
    from spanloom.operators import graphs

    df = spark.createDataFrame([("a", i % 50) for i in range(100)] + [("b", 1)], "k string, v bigint")
    rows = sorted((r.k, r.part, r.vals) for r in counts.collect_values(df, "k", "v", most=30).collect())
    assert [len(v) for _, _, v in rows] == [30, 30, 30, 10, 1]
    assert [x for k, _, v in rows for x in v if k == "a"] == sorted(i % 50 for i in range(100))
    rows = sorted((r.k, r.part, r.vals) for r in counts.collect_unique(df, "k", "v", most=30).collect())
    assert [x for k, _, v in rows for x in v if k == "a"] == list(range(50)) and len(rows) == 3
    e = spark.createDataFrame([(1, i, i % 3) for i in range(20)], "parent bigint, child bigint, label bigint")
    got = sorted((r.part, [tuple(x) for x in r.neighbours]) for r in graphs.neighbours(e, most=6).collect())
    assert [x for _, v in got for x in v] == sorted((i % 3, i) for i in range(20)) and len(got) == 4
