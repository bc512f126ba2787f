"""Queries over the relational tables: features, beams, statistics, sets, dictionaries, samples, graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import numbers, tags
from spanloom.operators import counts, graphs, joins, sampling, stats, topk, vectors
from spanloom.plans.catalogue import Catalogue
from spanloom.tables import read

C = Catalogue()
QUERIES, SQL = C.queries, C.sql


def user_features(spark: SparkSession, d: str) -> DataFrame:
    """user_id, event_id, name `event_type/k`, weight of the events with a value."""
    e = read(spark, d, "events")
    return e.filter("value is not null and user_id is not null").select("user_id", "event_id", F.concat_ws("/", "event_type", F.coalesce(F.get_json_object("props", "$.k"), F.lit("none"))).alias("name"), F.col("value").alias("weight"))


_FEATS = """f AS (SELECT user_id, event_id, event_type || '/' || coalesce(json_extract_string(props, '$.k'), 'none') AS name, value AS weight FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL)"""


@C.add(f"WITH {_FEATS} SELECT split_part(name, '/', 1) AS ns, count(*) AS n, count(DISTINCT name) AS names, round(sum(weight), 4) AS total FROM f GROUP BY 1")
def namespace_features(spark: SparkSession, d: str) -> DataFrame:
    f = vectors.by_namespace(user_features(spark, d))
    return f.groupBy("ns").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"), F.round(F.sum("weight"), 4).alias("total"))


@C.add(f"WITH {_FEATS} SELECT user_id, name, round(sum(weight), 6) AS sum_w, round(max(weight), 6) AS max_w, round(arg_min(weight, event_id), 6) AS first_w FROM f GROUP BY 1, 2")
def feature_sum_max_dedup(spark: SparkSession, d: str) -> DataFrame:
    f = user_features(spark, d)
    both = vectors.aggregate_features(f, ["user_id"]).join(vectors.first_wins(f, ["user_id"], "name", "weight", "event_id"), ["user_id", "name"])
    return both.select("user_id", "name", F.round("sum_w", 6).alias("sum_w"), F.round("max_w", 6).alias("max_w"), F.round("weight", 6).alias("first_w"))


@C.add(f"""WITH {_FEATS}, w AS (SELECT user_id, split_part(name, '/', 1) AS term, sum(weight) AS w FROM f GROUP BY 1, 2), n AS (SELECT user_id, sqrt(sum(w * w)) AS n FROM w GROUP BY 1)
SELECT a.user_id AS doc_l, b.user_id AS doc_r, round(sum(a.w * b.w) / (any_value(na.n) * any_value(nb.n)), 6) AS sim FROM w a JOIN w b USING (term) JOIN n na ON na.user_id = a.user_id JOIN n nb ON nb.user_id = b.user_id WHERE a.user_id % 100 = 0 AND na.n > 0 AND nb.n > 0 GROUP BY 1, 2""")
def sparse_vector_cosine_users(spark: SparkSession, d: str) -> DataFrame:
    from spanloom.operators import weights

    f = vectors.by_namespace(user_features(spark, d))
    w = vectors.aggregate_features(f, ["user_id"], "ns").select(F.col("user_id").alias("doc"), F.col("ns").alias("term"), F.col("sum_w").alias("w"))
    return weights.cosine(w.filter("doc % 100 = 0"), w).withColumn("sim", F.round("sim", 6))


@C.add("""WITH o AS (SELECT *, sum(o_totalprice) OVER (PARTITION BY o_custkey) AS z, coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM orders)
SELECT o_custkey, o_orderkey FROM o WHERE before / z < 0.5""")
def prune_by_ratio(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return topk.prune_by_ratio(o, ["o_custkey"], "o_totalprice", ["-o_totalprice", "o_orderkey"], 0.5).select("o_custkey", "o_orderkey")


@C.add("SELECT event_id, value FROM events WHERE abs(value) > 50")
def prune_by_eps(spark: SparkSession, d: str) -> DataFrame:
    return topk.prune(read(spark, d, "events").select("event_id", "value"), "value", 50)


@C.add("SELECT event_id, value FROM events WHERE value IS NOT NULL ORDER BY abs(value) DESC, event_id LIMIT 100")
def top_by_magnitude(spark: SparkSession, d: str) -> DataFrame:
    return topk.by_magnitude(read(spark, d, "events").filter("value is not null").select("event_id", "value"), "value", "event_id", 100)


@C.add("""WITH r AS (SELECT l_returnflag, l_linestatus, list_sort(list(l_extendedprice)) AS x FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, len(x) AS n, round(list_avg(x), 4) AS mean, x[1] AS q0, x[least(CAST(floor(0.25 * len(x)) AS BIGINT), len(x) - 1) + 1] AS q25, x[least(CAST(floor(0.5 * len(x)) AS BIGINT), len(x) - 1) + 1] AS q50,
x[least(CAST(floor(0.75 * len(x)) AS BIGINT), len(x) - 1) + 1] AS q75, x[len(x)] AS q100 FROM r""")
def order_statistics_by_group(spark: SparkSession, d: str) -> DataFrame:
    l = read(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")  # noqa: E741
    return stats.order_statistics(l, ["l_returnflag", "l_linestatus"], "l_extendedprice").withColumn("mean", F.round("mean", 4))


@C.add("""WITH RECURSIVE r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL),
e AS (SELECT user_id, i, value AS ema FROM r WHERE i = 1 UNION ALL SELECT r.user_id, r.i, 0.9 * e.ema + (1 - 0.9) * r.value FROM e JOIN r ON r.user_id = e.user_id AND r.i = e.i + 1)
SELECT user_id, max(i) AS n, round(arg_max(ema, i), 6) AS ema FROM e GROUP BY 1""")
def ema_by_user(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").filter("value is not null and user_id is not null")
    return stats.exponential_average(e, ["user_id"], "value", ["ts", "event_id"], 0.9).withColumn("ema", F.round("ema", 6))


@C.add("""SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS most, max(o_totalprice) AS high, arg_min(o_orderkey, o_totalprice) AS least, min(o_totalprice) AS low, count(*) AS offers FROM orders GROUP BY 1""")
def argmax_argmin_by_group(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    hi = stats.arg_best(o, ["o_custkey"], "o_orderkey", "o_totalprice", "o_orderkey")
    lo = stats.arg_best(o, ["o_custkey"], "o_orderkey", "o_totalprice", "o_orderkey", largest=False)
    return hi.select("o_custkey", F.col("item").alias("most"), F.col("score").alias("high"), "offers").join(lo.select("o_custkey", F.col("item").alias("least"), F.col("score").alias("low")), "o_custkey")


@C.add("""SELECT o_custkey, o_orderkey, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS rank FROM orders) WHERE rank <= 3""")
def beam_topk_by_group(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return topk.top_per_group(o, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey").desc()], 3).select("o_custkey", "o_orderkey", "rank")


@C.add("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS rank FROM orders) WHERE rank > 3""")
def beam_evicted(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return topk.evicted(o, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey").desc()], 3).select("o_custkey", "o_orderkey")


@C.add("""WITH s AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, p_retailprice / 50 AS b, 50.0 - p_size AS c FROM part), m AS (SELECT p_partkey AS item, greatest(a, b, c) AS score, CASE WHEN a >= b AND a >= c THEN 'size' WHEN b >= c THEN 'price' ELSE 'small' END AS objective FROM s)
SELECT objective, item, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY objective ORDER BY score DESC, item) AS rank FROM m) WHERE rank <= 20""")
def multi_objective_topk(spark: SparkSession, d: str) -> DataFrame:
    objectives = {"size": F.col("p_size").cast("double"), "price": F.col("p_retailprice") / 50, "small": 50.0 - F.col("p_size")}
    return topk.multi_objective(read(spark, d, "part"), objectives, "p_partkey", 20).withColumn("score", F.round("score", 6))


def labelled_lines(spark: SparkSession, d: str) -> DataFrame:
    """id, source stratum, gold (a returned line), predicted (a rule on discount and quantity), score."""
    l = read(spark, d, "lineitem")  # noqa: E741
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    score = (F.col("l_quantity") - 25) / 25 + F.col("l_discount") * 3
    return l.select(key.alias("id"), F.col("l_linestatus").alias("stratum"), (F.col("l_returnflag") == "R").alias("gold"), (score > 0).alias("predicted"), score.alias("score"))


_LAB = """lab AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_linestatus AS stratum, l_returnflag = 'R' AS gold, (l_quantity - 25) / 25 + l_discount * 3 > 0 AS predicted, (l_quantity - 25) / 25 + l_discount * 3 AS score FROM lineitem)"""
_CONF = "count(*) FILTER (gold AND predicted) AS tp, count(*) FILTER (NOT gold AND predicted) AS fp, count(*) FILTER (gold AND NOT predicted) AS fn, count(*) FILTER (NOT gold AND NOT predicted) AS tn"


@C.add(f"""WITH {_LAB}, c AS (SELECT {_CONF} FROM lab), p AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END AS r FROM c)
SELECT tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f FROM p""")
def fpr_micro(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.scores(stats.confusion(labelled_lines(spark, d), [], "gold", "predicted")))


def _rounded(df: DataFrame) -> DataFrame:
    for c in ("precision", "recall", "f"):
        df = df.withColumn(c, F.round(c, 6))
    return df


@C.add(f"""WITH {_LAB}, c AS (SELECT stratum, {_CONF} FROM lab GROUP BY 1), p AS (SELECT avg(CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END) AS p, avg(CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END) AS r FROM c)
SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f FROM p""")
def fpr_macro(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.macro_scores(stats.confusion(labelled_lines(spark, d), ["stratum"], "gold", "predicted")))


@C.add(f"""WITH {_LAB} SELECT stratum, {_CONF} FROM lab GROUP BY 1""")
def fpr_stratified(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled_lines(spark, d)
    even, odd = (stats.confusion(rows.filter(f"id % 2 = {k}"), ["stratum"], "gold", "predicted") for k in (0, 1))
    return stats.combine(even, odd, keys=["stratum"])


@C.add(f"""WITH {_LAB}, c AS (SELECT stratum, {_CONF} FROM lab GROUP BY 1), p AS (SELECT stratum, CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END AS r FROM c)
SELECT stratum, round(CASE WHEN p + r = 0 THEN 0 ELSE 5 * p * r / (4 * p + r) END, 6) AS f2 FROM p""")
def fbeta(spark: SparkSession, d: str) -> DataFrame:
    conf = stats.confusion(labelled_lines(spark, d), ["stratum"], "gold", "predicted")
    return stats.scores(conf, 2.0).select("stratum", F.round("f", 6).alias("f2"))


@C.add(f"""WITH {_LAB}, g AS (SELECT DISTINCT id FROM lab WHERE gold), p AS (SELECT DISTINCT id FROM lab WHERE predicted)
SELECT count(*) FILTER (g.id IS NOT NULL AND p.id IS NOT NULL) AS tp, count(*) FILTER (g.id IS NULL) AS fp, count(*) FILTER (p.id IS NULL) AS fn FROM g FULL OUTER JOIN p ON g.id = p.id""")
def set_compare_gold_pred(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled_lines(spark, d)
    return stats.compare_sets(rows.filter("gold"), rows.filter("predicted"), ["id"])


def _threshold_sql(value: str) -> str:
    return f"""WITH {_LAB}, o AS (SELECT gold::INT AS y, score AS s, row_number() OVER (ORDER BY score, id) - 1 AS i, lead(score) OVER (ORDER BY score, id) AS up, sum(gold::INT) OVER (ORDER BY score, id ROWS UNBOUNDED PRECEDING) AS fn, sum(gold::INT) OVER () AS pos, count(*) OVER () AS n FROM lab),
c AS (SELECT (s + up) / 2 AS t, pos - fn AS tp, fn, i + 1 - fn AS tn, n - i - 1 - (pos - fn) AS fp, n FROM o WHERE i >= 1 AND i < n - 1), v AS (SELECT t, {value} - exp(-8) * t * t AS score FROM c)
SELECT round(coalesce(min(t) FILTER (score = (SELECT max(score) FROM v WHERE NOT isnan(score))), 0), 6) AS threshold, round(coalesce(max(score), 0), 6) AS score FROM v WHERE score > 0 AND NOT isnan(score)"""


@C.add(_threshold_sql("2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn))"))
def best_threshold_f1(spark: SparkSession, d: str) -> DataFrame:
    b = stats.best_threshold(labelled_lines(spark, d), "gold", "score", "id", "f1")
    return b.select(F.round("threshold", 6).alias("threshold"), F.round("score", 6).alias("score"))


@C.add(_threshold_sql("(tp + tn) / n"))
def best_threshold_acc(spark: SparkSession, d: str) -> DataFrame:
    b = stats.best_threshold(labelled_lines(spark, d), "gold", "score", "id", "acc")
    return b.select(F.round("threshold", 6).alias("threshold"), F.round("score", 6).alias("score"))


@C.add("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def semi_intersection(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return joins.intersect_in_order(read(spark, d, "orders").select("o_custkey"), c, "o_custkey")


@C.add("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000 AND o_custkey IS NOT NULL)")
def missing_keys_anti(spark: SparkSession, d: str) -> DataFrame:
    known = read(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.missing_keys(read(spark, d, "customer").select("c_custkey"), known, "c_custkey")


@C.add("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 7 = 3")
def shard_filter(spark: SparkSession, d: str) -> DataFrame:
    k, n = sampling.parse_shard("3/7")
    return sampling.shard(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), F.col("o_orderkey"), k, n)


@C.add("WITH f AS (SELECT p_type, min(p_partkey) AS m FROM part WHERE p_type IS NOT NULL GROUP BY 1) SELECT p_type, row_number() OVER (ORDER BY m, p_type) - 1 AS id FROM f")
def dictionary_encode(spark: SparkSession, d: str) -> DataFrame:
    return counts.dictionary(read(spark, d, "part"), "p_type", "p_partkey")


@C.add("""WITH f AS (SELECT p_type, min(p_partkey) AS m FROM part WHERE p_size > 25 GROUP BY 1), i AS (SELECT p_type, row_number() OVER (ORDER BY m, p_type) - 1 AS id FROM f)
SELECT p_partkey, coalesce(id, -1) AS id, i.p_type AS decoded FROM part LEFT JOIN i USING (p_type)""")
def dictionary_decode(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    ids = counts.dictionary(p.filter("p_size > 25"), "p_type", "p_partkey")
    coded = counts.encode(p.select("p_partkey", "p_type"), "p_type", ids).drop("p_type")
    return counts.decode(coded, ids).select("p_partkey", "id", F.col("p_type").alias("decoded"))


@C.add("""SELECT o_custkey, count(o_orderkey) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS vals FROM orders GROUP BY 1""")
def multimap_collect(spark: SparkSession, d: str) -> DataFrame:
    m = counts.collect_values(read(spark, d, "orders"), "o_custkey", "o_orderkey")
    return m.select("o_custkey", "n", F.array_join("vals", ",").alias("vals"))


@C.add("""SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS vals FROM orders GROUP BY 1""")
def multimap_unique(spark: SparkSession, d: str) -> DataFrame:
    return counts.collect_unique(read(spark, d, "orders"), "o_custkey", "o_orderpriority").select("o_custkey", F.array_join("vals", ",").alias("vals"))


@C.add("""SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def multimap_project(spark: SparkSession, d: str) -> DataFrame:
    keys = read(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return counts.project(read(spark, d, "orders").select("o_custkey", "o_orderkey"), keys, "o_custkey")


@C.add("SELECT l_suppkey AS parent, l_partkey AS child, l_linenumber AS label, (l_suppkey << 40) | ((l_linenumber::BIGINT | 32768) << 24) | l_partkey AS edge FROM (SELECT DISTINCT l_suppkey, l_partkey, l_linenumber FROM lineitem)")
def edge_pack_unpack(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d).withColumn("edge", numbers.pack_edge(F.col("parent"), F.col("label"), F.col("child")))
    u = e.withColumn("u", numbers.unpack_edge(F.col("edge")))
    return u.select(F.col("u.node").alias("parent"), F.col("u.conode").alias("child"), F.col("u.label").cast("int").alias("label"), "edge")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(F.col("l_suppkey").alias("parent"), F.col("l_partkey").alias("child"), F.col("l_linenumber").alias("label")).distinct()


@C.add("""WITH e AS (SELECT DISTINCT l_suppkey AS parent, l_partkey AS child, l_linenumber AS label FROM lineitem), b AS (SELECT parent AS node, 1 AS c, 0 AS p FROM e UNION ALL SELECT child, 0, 1 FROM e)
SELECT node, CAST(sum(c) AS BIGINT) AS n_children, CAST(sum(p) AS BIGINT) AS n_parents FROM b GROUP BY 1""")
def degree_and_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return graphs.degrees(_edges(spark, d))


@C.add("""WITH e AS (SELECT DISTINCT l_suppkey AS parent, l_partkey AS child, l_linenumber AS label FROM lineitem) SELECT parent AS node, string_agg(label || ':' || child, ',' ORDER BY label, child) AS children FROM e GROUP BY 1""")
def neighbour_lists(spark: SparkSession, d: str) -> DataFrame:
    n = graphs.neighbours(_edges(spark, d))
    return n.select("node", F.array_join(F.transform("neighbours", lambda x: F.concat_ws(":", x["label"], x["conode"])), ",").alias("children"))


def _nation_edges(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation")
    a = n.select(F.col("n_nationkey").cast("bigint").alias("parent"), "n_regionkey")
    b = n.select(F.col("n_nationkey").cast("bigint").alias("child"), "n_regionkey")
    near = (F.col("child") - F.col("parent")).between(1, 6)
    return a.join(b, "n_regionkey").filter(near).select("parent", "child", F.concat(F.lit("r"), "n_regionkey").alias("label"))


_NAT = """e AS (SELECT a.n_nationkey::BIGINT AS parent, b.n_nationkey::BIGINT AS child, 'r' || a.n_regionkey AS label FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey - a.n_nationkey BETWEEN 1 AND 6)"""


@C.add(f"""WITH RECURSIVE {_NAT}, w AS (SELECT parent AS "start", child AS "end", parent AS prev, label AS path, 1 AS hops FROM e UNION ALL SELECT w."start", e.child, w."end", w.path || '_' || e.label, hops + 1 FROM w JOIN e ON e.parent = w."end" WHERE hops < 3 AND e.child <> w.prev)
SELECT "start", "end", path, hops FROM w""")
def relation_walk_k(spark: SparkSession, d: str) -> DataFrame:
    e = _nation_edges(spark, d)
    return graphs.walks(e, 3, e.select(F.col("parent").alias("node")).distinct())


@C.add(f"""WITH RECURSIVE {_NAT}, s AS (SELECT parent AS a, child AS b FROM e UNION SELECT child, parent FROM e), w AS (SELECT DISTINCT a AS source, a AS node, 0 AS hops FROM s UNION SELECT w.source, s.b, hops + 1 FROM w JOIN s ON s.a = w.node WHERE hops < 12)
SELECT source, node, min(hops) AS hops FROM w GROUP BY 1, 2""")
def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    e = _nation_edges(spark, d)
    sources = e.select(F.col("parent").alias("source")).union(e.select("child")).distinct()
    return graphs.distances(e, sources, bidirectional=True).select("source", "node", "hops")


@C.add("""WITH t AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'NN' WHEN 1 THEN 'VBZ' WHEN 2 THEN 'VB' WHEN 3 THEN 'NNP' WHEN 4 THEN 'PRP' ELSE 'IN' END AS tag FROM part)
SELECT tag, count(*) AS n, count(*) FILTER (tag IN ('VA','VC','VE','VV','VBD','VBG','VBN','VBP','VBZ')) AS verbs, count(*) FILTER (tag IN ('NR','NT','NN','NNS','NNP','NNPS')) AS nouns, count(*) FILTER (tag IN ('NR','NNP','NNPS')) AS names,
count(*) FILTER (tag IN ('PN','WP','WP$','PRP','PRP$')) AS pronouns, CASE left(tag, 1) WHEN 'J' THEN 'ADJECTIVE' WHEN 'R' THEN 'ADVERB' WHEN 'N' THEN 'NOUN' WHEN 'V' THEN 'VERB' END AS lexical FROM t GROUP BY tag""")
def tag_membership_counts(spark: SparkSession, d: str) -> DataFrame:
    tag = F.element_at(F.array(*[F.lit(x) for x in ("NN", "VBZ", "VB", "NNP", "PRP", "IN")]), F.col("p_size") % 6 + 1)
    t = read(spark, d, "part").select(tag.alias("tag"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    g = t.groupBy("tag").agg(F.count("*").alias("n"), n(tags.is_verb(F.col("tag"))).alias("verbs"), n(tags.is_noun(F.col("tag"))).alias("nouns"), n(tags.is_proper_noun(F.col("tag"))).alias("names"), n(tags.is_pronoun(F.col("tag"))).alias("pronouns"))
    return g.withColumn("lexical", tags.lexical_category(F.col("tag")))


@C.add("SELECT p_partkey, p_size::BIGINT + (length(p_brand) % 10 + (length(p_type) % 20) * 10) * 100 AS ix, ((p_partkey % 97) + 97) % 97 AS slot FROM part")
def mixed_radix_product(spark: SparkSession, d: str) -> DataFrame:
    ix = numbers.mixed_radix([(F.length("p_type") % 20, 20), (F.length("p_brand") % 10, 10), (F.col("p_size"), 100)])
    return read(spark, d, "part").select("p_partkey", ix.alias("ix"), F.pmod("p_partkey", F.lit(97)).alias("slot"))


@C.add("""SELECT event_type, CAST(least(greatest(coalesce(floor(log2(value / 4)) + 1, 0), 0), 19) AS BIGINT) AS bucket, count(*) AS n FROM events WHERE value > 0 GROUP BY 1, 2""")
def latency_histogram(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").filter("value > 0").select("event_type", numbers.latency_bucket(F.col("value")).alias("bucket"))
    return counts.counts(e, "event_type", "bucket")


_PATHS = """p AS (SELECT [p_brand, p_type, p_size::VARCHAR] AS path FROM part), x AS (SELECT path[1:k] AS path FROM p, (SELECT unnest(range(0, 4)) AS k)), c AS (SELECT array_to_string(path, '/') AS path, len(path) AS depth, count(*) AS n FROM x GROUP BY 1, 2)"""


def _trie(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select(F.array("p_brand", "p_type", F.col("p_size").cast("string")).alias("path"))
    return counts.path_prefixes(p, "path")


@C.add(f"WITH {_PATHS} SELECT path, CAST(depth AS INTEGER) AS depth, n FROM c")
def feature_path_trie(spark: SparkSession, d: str) -> DataFrame:
    return _trie(spark, d).select(F.array_join("path", "/").alias("path"), F.size("path").alias("depth"), "n")


@C.add("""WITH p AS (SELECT [p_brand, p_type, p_size::VARCHAR] AS path FROM part), x AS (SELECT path[1:k] AS path FROM p, (SELECT unnest(range(0, 4)) AS k)), c AS (SELECT path, count(*) AS n FROM x GROUP BY 1 HAVING count(*) >= 5),
ch AS (SELECT path[1:len(path) - 1] AS path, count(*) AS children FROM c WHERE len(path) > 0 GROUP BY 1), r AS (SELECT c.path, n - sqrt(coalesce(children, 0)) AS priority FROM c LEFT JOIN ch ON c.path = ch.path)
SELECT array_to_string(path, '/') AS path, row_number() OVER (ORDER BY priority DESC, path) - 1 AS id FROM r""")
def assign_feature_ids(spark: SparkSession, d: str) -> DataFrame:
    return counts.assign_feature_ids(_trie(spark, d), "path").select(F.array_join("path", "/").alias("path"), "id")


@C.add("""WITH w AS (SELECT DISTINCT p_name FROM part), a AS (SELECT p_name, unnest(range(0, length(p_name) + 1)) AS k FROM part), c AS (SELECT substring(p_name, 1, k) AS prefix, count(*) AS n FROM a GROUP BY 1 HAVING count(*) >= 20),
j AS (SELECT w.p_name, c.prefix, c.n, row_number() OVER (PARTITION BY w.p_name ORDER BY length(c.prefix) DESC) AS r FROM w JOIN c ON starts_with(w.p_name, c.prefix)) SELECT p_name, prefix, n FROM j WHERE r = 1""")
def longest_frequent_prefix(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").filter("p_name is not null").select("p_name")
    return counts.longest_frequent_prefix(p, "p_name", counts.prefixes(p, "p_name"), 20)


@C.add("""WITH p AS (SELECT unnest(['red', 'blue p', 'old']) AS prefix), c AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1) SELECT prefix, p_name, n FROM p JOIN c ON starts_with(p_name, prefix)""")
def prefix_completions(spark: SparkSession, d: str) -> DataFrame:
    return counts.completions(read(spark, d, "part").select("p_name"), "p_name", ["red", "blue p", "old"])


@C.add("""WITH w AS (SELECT DISTINCT p_name FROM part), a AS (SELECT p_name, unnest(range(0, length(p_name) + 1)) AS k FROM part), c AS (SELECT substring(p_name, 1, k) AS prefix, count(*) AS n FROM a GROUP BY 1)
SELECT w.p_name, c.prefix, c.n, round(c.n / lag(c.n) OVER (PARTITION BY w.p_name ORDER BY length(c.prefix)), 6) AS ratio FROM w JOIN c ON starts_with(w.p_name, c.prefix)""")
def prefix_change_points(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").filter("p_name is not null").select("p_name")
    return counts.prefix_changes(p, "p_name", counts.prefixes(p, "p_name")).withColumn("ratio", F.round("ratio", 6))


@C.add("""WITH p AS (SELECT p_partkey, [p_brand, p_type, p_size::VARCHAR] AS path FROM part), x AS (SELECT p_partkey, path[1:k] AS path FROM p, (SELECT unnest(range(0, 4)) AS k)), c AS (SELECT path, count(*) AS n FROM x GROUP BY 1 HAVING count(*) >= 5),
ch AS (SELECT path[1:len(path) - 1] AS path, count(*) AS children FROM c WHERE len(path) > 0 GROUP BY 1), r AS (SELECT c.path, row_number() OVER (ORDER BY n - sqrt(coalesce(children, 0)) DESC, c.path) - 1 AS id FROM c LEFT JOIN ch ON c.path = ch.path)
SELECT p_partkey, id FROM x JOIN r ON x.path = r.path""")
def path_feature_ids(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select("p_partkey", F.array("p_brand", "p_type", F.col("p_size").cast("string")).alias("path"))
    ids = counts.assign_feature_ids(_trie(spark, d), "path").select("path", "id")
    return counts.path_ids(p, ["p_partkey"], "path", ids)


@C.add("""WITH r AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, event_id FROM events WHERE event_type IS NOT NULL) SELECT user_id, event_id, event_type FROM r WHERE p IS NULL OR p <> event_type""")
def repeat_suppression(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").filter("event_type is not null").select("user_id", "event_id", "ts", "event_type")
    return graphs.suppress_repeats(e, ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


@C.add("""SELECT o_orderkey, round(CASE WHEN o_totalprice > 200000 THEN 1.0 ELSE o_totalprice / 200000 END, 8) AS share FROM orders WHERE o_orderstatus = 'F'""")
def guarded_scores(spark: SparkSession, d: str) -> DataFrame:
    from spanloom.operators import learning

    o = read(spark, d, "orders").filter("o_orderstatus = 'F'")
    score = learning.guarded(F.when(F.col("o_totalprice") > 200000, F.lit(float("inf"))).otherwise(0.0), F.col("o_totalprice") / 200000)
    return o.select("o_orderkey", F.round(F.when(score == float("inf"), 1.0).otherwise(score), 8).alias("share"))  # cents by 200,000 have 8 digits, so nothing is tied


@C.add("""WITH f AS (SELECT o_custkey AS k, o_orderpriority AS feature, count(*)::DOUBLE AS value FROM orders GROUP BY 1, 2), y AS (SELECT o_custkey AS k, max(o_totalprice) > 300000 AS y FROM orders GROUP BY 1),
e AS (SELECT k, (y::INT - 0.5) AS e FROM y), n AS (SELECT count(*) AS n FROM e) SELECT feature, round(sum(value * e) / any_value(n.n), 6) AS weight FROM f JOIN e USING (k), n GROUP BY 1""")
def gradient_step(spark: SparkSession, d: str) -> DataFrame:
    from spanloom.operators import learning

    o = read(spark, d, "orders")
    f = o.groupBy(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("feature")).agg(F.count("*").cast("double").alias("value"))
    y = o.groupBy(F.col("o_custkey").alias("k")).agg((F.max("o_totalprice") > 300000).alias("y"))
    zero = f.select("feature").distinct().select("feature", F.lit(0.0).alias("weight"))
    return learning.gradient_epoch(f.join(y, "k"), zero, ["k"], "y", 1.0).select("feature", F.round("weight", 6).alias("weight"))


@C.add("""WITH f AS (SELECT o_custkey AS k, o_orderpriority AS feature, count(*)::DOUBLE AS value FROM orders GROUP BY 1, 2), y AS (SELECT o_custkey AS k, max(o_totalprice) > 300000 AS y FROM orders GROUP BY 1), w AS (SELECT DISTINCT feature, length(feature) / 100.0 AS w FROM f),
z AS (SELECT k, sum(value * w) AS z FROM f JOIN w USING (feature) GROUP BY 1), e AS (SELECT k, y::INT - 1 / (1 + exp(-z)) AS e FROM y JOIN z USING (k)) SELECT feature, round(any_value(w) + 0.5 * (sum(value * e) / (SELECT count(*) FROM e) - 0.1 * any_value(w)), 6) AS weight FROM f JOIN e USING (k) JOIN w USING (feature) GROUP BY 1""")
def gradient_step_onward(spark: SparkSession, d: str) -> DataFrame:
    """A step of logistic regression from weights that aren't zero, with a penalty (L3)."""
    from spanloom.operators import learning

    o = read(spark, d, "orders")
    f = o.groupBy(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("feature")).agg(F.count("*").cast("double").alias("value"))
    y = o.groupBy(F.col("o_custkey").alias("k")).agg((F.max("o_totalprice") > 300000).alias("y"))
    start = f.select("feature").distinct().select("feature", (F.length("feature") / 100.0).alias("weight"))
    return learning.gradient_epoch(f.join(y, "k"), start, ["k"], "y", 0.5, 0.1).select("feature", F.round("weight", 6).alias("weight"))


#: Labelled rows that the perceptron is fitted on, at most; the model scores all rows.
FITTED_ROWS = 2_000


@C.add("SELECT c_custkey, c_nationkey < 12 AS predicted FROM customer WHERE c_nationkey IS NOT NULL AND c_mktsegment IS NOT NULL")
def kernel_perceptron_fit(spark: SparkSession, d: str) -> DataFrame:
    """A kernel perceptron fitted on a bounded sample of labelled rows, predicting all (L1); the label can be learnt from the features."""
    from spanloom.operators import learning, sampling

    c = read(spark, d, "customer").filter("c_nationkey is not null and c_mktsegment is not null")
    rows = c.select("c_custkey", F.array(F.col("c_nationkey").cast("int"), F.lit(100) + F.pmod(F.hash("c_mktsegment"), F.lit(10))).alias("x"), (F.col("c_nationkey") < 12).alias("y"))
    sample = [(r["x"], r["y"]) for r in sampling.reservoir(rows, ["c_custkey"], FITTED_ROWS).collect()]
    model = learning.KernelPerceptron(budget=200)
    for _ in range(20):
        if not any([model.update(x, y) for x, y in sample]):
            break
    return learning.score_rows(rows, model, "x").select("c_custkey", (F.col("score") > 0).alias("predicted"))


@C.add("SELECT o_custkey, sum(greatest(floor(o_totalprice) - 150000, 0))::DOUBLE AS score FROM orders GROUP BY 1")
def beam_search_path(spark: SparkSession, d: str) -> DataFrame:
    """Best-first search in each customer's orders: each order is taken, with its gain, or left."""
    from spanloom.operators import learning

    def moves_of(pdf):
        gains = [float(g) for g in pdf.sort_values("o_orderkey")["gain"]]

        def moves(state):
            at = state[0]
            return [((at + 1, *state[1:], at), gains[at]), ((at + 1, *state[1:]), 0.0)] if at < len(gains) else []

        return (0,), moves

    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", (F.floor("o_totalprice") - 150000).alias("gain"))
    return learning.search_groups(o, "o_custkey", moves_of, 1).select("o_custkey", "score")


@C.add("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n, round(greatest(max(l_tax), 0), 6) AS max_w FROM lineitem GROUP BY 1, 2""")
def weight_summaries(spark: SparkSession, d: str) -> DataFrame:
    l = read(spark, d, "lineitem")  # noqa: E741
    g = ["l_returnflag", "l_linestatus"]
    a = l.groupBy(*g).agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))
    m = stats.floor_zero_summary(l, g, "l_tax").select(*g, F.round("max_w", 6).alias("max_w"))
    return a.join(m, g)
