"""Queries over annotated words, trees and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import tags
from spanloom.operators import counts, hierarchy, joins, layers, trees, vectors
from spanloom.plans.catalogue import Catalogue
from spanloom.plans.problems import TREES_SQL, constituent_nodes, word_nodes
from spanloom.sources.annotated import cluster_of
from spanloom.tables import PLAIN_NUMBER, current_rows, current_words, read

C = Catalogue()
QUERIES, SQL = C.queries, C.sql

_CUR = """cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word_id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM conllu) WHERE rn = 1 AND regexp_full_match(id, '[0-9]+'))"""
_CONS = """cn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parse_id, cons ORDER BY loaded_at DESC NULLS LAST) AS rn FROM constituents) WHERE rn = 1)"""
_DEPTH = f"""{_CUR}, n AS (SELECT sent_id, id::BIGINT AS node, TRY_CAST(head AS BIGINT) AS head FROM cur), dep AS (SELECT sent_id, node, 1 AS depth FROM n WHERE head = 0 UNION ALL SELECT n.sent_id, n.node, depth + 1 FROM dep JOIN n ON n.sent_id = dep.sent_id AND n.head = dep.node)"""


def _words(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    rows = current_words(read(spark, d, "conllu"), ["sent_id", "id", *keep]).filter(F.col("id").rlike(PLAIN_NUMBER))
    return rows.withColumn("tok", F.col("id").cast("bigint")).drop("id")


@C.add(f"WITH RECURSIVE {_DEPTH} SELECT sent_id, node, CAST(depth AS INTEGER) AS depth FROM dep")
def tree_depths(spark: SparkSession, d: str) -> DataFrame:
    """Depths of words with the root at 1; words without a way to the root have none."""
    h = hierarchy.hierarchy(word_nodes(spark, d)).filter("state = 'tree'")
    return h.select(F.col("tree").alias("sent_id"), "node", (F.col("depth") + 1).alias("depth"))


@C.add(f"""WITH RECURSIVE {_DEPTH}, b AS (SELECT sent_id, unnest(range(1, m + 1, 5)) AS first, m FROM (SELECT sent_id, max(node) AS m FROM n GROUP BY 1)), s AS (SELECT sent_id, first, least(first + 4, m) AS last FROM b)
SELECT s.sent_id, s.first, arg_min(node, depth * 100000 + node) AS head FROM s JOIN dep ON dep.sent_id = s.sent_id AND node BETWEEN first AND last GROUP BY 1, 2""")
def mention_heads(spark: SparkSession, d: str) -> DataFrame:
    """The shallowest word of each stretch of five words, the leftmost of equals."""
    nodes = word_nodes(spark, d)
    depths = hierarchy.hierarchy(nodes).filter("state = 'tree'").select(F.col("tree").alias("sent_id"), "node", "depth")
    m = nodes.groupBy(F.col("tree").alias("sent_id")).agg(F.max("node").alias("m"))
    s = m.select("sent_id", "m", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m"), F.lit(5).cast("bigint"))).alias("first")).select("sent_id", "first", F.least(F.col("first") + 4, "m").alias("last"))
    spans = s.withColumn("span_id", F.col("first"))
    return trees.shallowest_in_spans(depths, spans, ["sent_id"], "node", "depth", "first", "last", ["span_id"]).select("sent_id", F.col("span_id").alias("first"), "head")


@C.add(f"""WITH RECURSIVE {_CONS}, a AS (SELECT parse_id, cons, cons AS anc FROM cn), e AS (SELECT parse_id, parent, cons FROM cn WHERE parent >= 0), up AS (SELECT parse_id, parent AS anc, cons FROM e UNION SELECT u.parse_id, e.parent, u.cons FROM up u JOIN e ON e.parse_id = u.parse_id AND e.cons = u.anc),
kids AS (SELECT parse_id, anc, count(*) AS n FROM up GROUP BY 1, 2) SELECT parse_id, parent AS cons, count(*) AS n_children, min(cons) AS first_child, max(cons) AS last_child FROM e GROUP BY 1, 2""")
def tree_children(spark: SparkSession, d: str) -> DataFrame:
    rows = current_rows(read(spark, d, "constituents"), ["parse_id", "cons"], ["loaded_at"], ["parent"]).filter("parent >= 0")
    s = trees.child_summary(rows.withColumn("ord", F.col("cons")), "parse_id", "parent", "ord", "cons")
    return s.select("parse_id", F.col("parent").alias("cons"), "n_children", F.col("left_child").alias("first_child"), F.col("right_child").alias("last_child"))


@C.add(f"""WITH {_CONS}, e AS (SELECT parse_id, parent, cons, first_token FROM cn WHERE parent >= 0 AND first_token IS NOT NULL) SELECT parse_id, cons, lag(cons) OVER w AS left_sib, lead(cons) OVER w AS right_sib FROM e WINDOW w AS (PARTITION BY parse_id, parent ORDER BY first_token, cons)""")
def tree_siblings(spark: SparkSession, d: str) -> DataFrame:
    rows = current_rows(read(spark, d, "constituents"), ["parse_id", "cons"], ["loaded_at"], ["parent", "first_token"]).filter("parent >= 0 and first_token is not null")
    rows = rows.withColumn("ord", F.struct("first_token", "cons"))
    return trees.siblings(rows, "parse_id", "parent", "ord", "cons").select("parse_id", "cons", "left_sib", "right_sib")


@C.add(f"""WITH {_CONS} SELECT parse_id, first_token, last_token, min(cons) AS cons FROM cn WHERE first_token IS NOT NULL AND last_token IS NOT NULL GROUP BY 1, 2, 3""")
def span_to_constituent(spark: SparkSession, d: str) -> DataFrame:
    rows = current_rows(read(spark, d, "constituents"), ["parse_id", "cons"], ["loaded_at"], ["first_token", "last_token"]).filter("first_token is not null and last_token is not null")
    return joins.smallest_spans(rows.withColumn("depth", F.lit(0)), ["parse_id"], "first_token", "last_token", "depth", "cons")


@C.add(TREES_SQL + f""", deep AS (SELECT tree_id AS parse_id, node AS cons, len(string_split(path, '/')) AS depth FROM p WHERE source = 'constituents'), s AS (SELECT parse_id, cons, first_token, last_token, depth FROM (SELECT parse_id, cons, first_token, last_token, row_number() OVER (PARTITION BY parse_id, cons ORDER BY loaded_at DESC NULLS LAST) AS rn FROM constituents) JOIN deep USING (parse_id, cons) WHERE rn = 1 AND first_token IS NOT NULL AND last_token IS NOT NULL)
SELECT parse_id, first_token, last_token, cons FROM (SELECT *, row_number() OVER (PARTITION BY parse_id, first_token, last_token ORDER BY depth, cons) AS r FROM s) WHERE r = 1""")
def shallowest_constituents(spark: SparkSession, d: str) -> DataFrame:
    """The shallowest constituent of each span, by the depths of the hierarchy."""
    rows = current_rows(read(spark, d, "constituents"), ["parse_id", "cons"], ["loaded_at"], ["first_token", "last_token"]).filter("first_token is not null and last_token is not null")
    h = hierarchy.hierarchy(constituent_nodes(spark, d)).filter("state = 'tree'").select(F.col("tree").alias("parse_id"), F.col("node").cast("int").alias("cons"), "depth")
    return joins.smallest_spans(rows.join(h, ["parse_id", "cons"]), ["parse_id"], "first_token", "last_token", "depth", "cons")


@C.add(f"""WITH {_CONS}, sp AS (SELECT parse_id, cons, first_token AS s, last_token AS e FROM cn WHERE first_token = last_token), b AS (SELECT parse_id, cons, first_token AS s, last_token AS e FROM cn WHERE last_token > first_token)
SELECT sp.parse_id, sp.cons AS leaf, b.cons AS over FROM sp JOIN b ON b.parse_id = sp.parse_id AND sp.s BETWEEN b.s AND b.e""")
def leaf_covering_constituents(spark: SparkSession, d: str) -> DataFrame:
    rows = current_rows(read(spark, d, "constituents"), ["parse_id", "cons"], ["loaded_at"], ["first_token", "last_token"])
    leaf = rows.filter("first_token = last_token").select("parse_id", F.col("cons").alias("leaf"), F.col("first_token").alias("tok"))
    over = rows.filter("last_token > first_token").select("parse_id", F.col("cons").alias("over"), "first_token", "last_token")
    return joins.range_join(leaf, over, ["parse_id"], "tok", "first_token", "last_token").select("parse_id", "leaf", "over")


@C.add(f"""WITH {_CUR}, e AS (SELECT sent_id, id::BIGINT AS mod, nullif(TRY_CAST(head AS BIGINT), 0) AS head, deprel AS label FROM cur), s AS (SELECT DISTINCT sent_id, 1 AS first, 4 AS last FROM e)
SELECT e.sent_id, head, mod, label, CASE WHEN mod BETWEEN first AND last THEN 'mod' ELSE 'head' END AS "inner" FROM e JOIN s USING (sent_id) WHERE (mod BETWEEN first AND last) <> coalesce(head BETWEEN first AND last, false)""")
def edges_leaving_span(spark: SparkSession, d: str) -> DataFrame:
    w = _words(spark, d, "head", "deprel")
    head = F.col("head").try_cast("bigint")
    e = w.select("sent_id", F.col("tok").alias("mod"), F.when(head != 0, head).alias("head"), F.col("deprel").alias("label"))
    s = e.select("sent_id").distinct().select("sent_id", F.lit(0).alias("sid"), F.lit(1).cast("bigint").alias("first"), F.lit(4).cast("bigint").alias("last"))
    return trees.edges_leaving(e, s, ["sent_id"], "first", "last", ["sid"]).drop("sid")


@C.add(f"""WITH RECURSIVE {_CUR}, n AS (SELECT sent_id, id::BIGINT AS node, TRY_CAST(head AS BIGINT) AS head FROM cur), p AS (SELECT sent_id, node, [node] AS path FROM n WHERE head = 0 UNION ALL SELECT n.sent_id, n.node, list_append(p.path, n.node) FROM p JOIN n ON n.sent_id = p.sent_id AND n.head = p.node),
j AS (SELECT a.sent_id, a.node AS source, b.node AS target, a.path AS pa, b.path AS pb, len(list_filter(list_zip(a.path, b.path), lambda x: x[1] = x[2])) AS k FROM p a JOIN p b ON a.sent_id = b.sent_id AND b.node = a.node + 3)
SELECT sent_id, source, target, len(pa) - k AS up, len(pb) - k AS down, pa[k] AS lca FROM j WHERE k > 0""")
def dependency_paths(spark: SparkSession, d: str) -> DataFrame:
    h = hierarchy.hierarchy(word_nodes(spark, d)).filter("state = 'tree'").withColumnRenamed("tree", "sent_id")
    pairs = h.select("sent_id", F.col("node").alias("source"), (F.col("node") + 3).alias("target"))
    return trees.dependency_paths(h, pairs, "sent_id").select("sent_id", "source", "target", F.col("up").cast("bigint").alias("up"), F.col("down").cast("bigint").alias("down"), "lca")


@C.add(f"""WITH {_CUR} SELECT sent_id, count(*) FILTER (left(xpos, 1) = 'V') AS verbs, count(*) FILTER (left(xpos, 1) IN ('V', 'N', 'R', 'J')) AS content, count(*) FILTER (xpos IN ('', 'NFP', 'HYPH', 'LS', 'UH', '-LRB-', '-RRB-', ':', ',', '.', '``', '''''', 'SYM')) AS nuisance FROM cur GROUP BY 1""")
def sentence_word_classes(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    x = F.col("xpos")
    return _words(spark, d, "xpos").groupBy("sent_id").agg(n(F.substring(x, 1, 1) == "V").alias("verbs"), n(tags.is_content(x)).alias("content"), n(x.isin(*tags.NUISANCE)).alias("nuisance"))


@C.add(f"""WITH {_CUR}, p AS (SELECT bit_path, word FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY frequency DESC, run_id, bit_path) AS rn FROM paths WHERE word IS NOT NULL AND frequency >= 3 AND bit_path IS NOT NULL) WHERE rn = 1),
j AS (SELECT coalesce(bit_path, '???') AS cluster FROM cur LEFT JOIN p ON p.word = cur.form) SELECT substring(cluster, 1, 4) AS cluster_4, count(*) AS n FROM j GROUP BY 1""")
def cluster_path_lookup(spark: SparkSession, d: str) -> DataFrame:
    usable = read(spark, d, "paths").filter("word is not null and frequency >= 3 and bit_path is not null")
    best = usable.groupBy("word").agg(F.min(F.struct((-F.col("frequency")).alias("f"), "run_id", "bit_path")).alias("b")).select("word", "b.bit_path")
    # each distinct form is looked up once, with its count, so a frequent form is one row of the join
    forms = counts.counts(_words(spark, d, "form"), "form")
    return cluster_of(forms, best, "form", (4,)).groupBy("cluster_4").agg(F.sum("n").alias("n"))


@C.add(f"""WITH {_CUR}, r AS (SELECT sent_id, id::BIGINT AS tok, xpos LIKE 'NN%' AS c FROM cur), i AS (SELECT sent_id, tok, tok - row_number() OVER (PARTITION BY sent_id ORDER BY tok) AS g FROM r WHERE c) SELECT sent_id, min(tok) AS first, max(tok) AS last FROM i GROUP BY sent_id, g""")
def noun_runs(spark: SparkSession, d: str) -> DataFrame:
    from spanloom.operators import graphs

    w = _words(spark, d, "xpos").withColumn("c", F.coalesce(F.col("xpos").startswith("NN"), F.lit(False)))
    return graphs.runs(w, ["sent_id"], "tok", "c")


@C.add(f"""WITH {_CUR}, v AS (SELECT sent_id, count(*) FILTER (head = '0') AS roots FROM cur GROUP BY 1) SELECT sent_id, roots FROM v WHERE roots <> 1""")
def single_root_violations(spark: SparkSession, d: str) -> DataFrame:
    from spanloom.operators import checks

    return checks.roots_not_one(_words(spark, d, "head").withColumn("is_root", F.col("head") == "0"), "sent_id", "is_root")


@C.add(f"""WITH {_CONS} SELECT parse_id, cons, CASE WHEN first_token < 0 THEN 'first below 0' WHEN last_token < first_token THEN 'last before first' END AS problem FROM cn WHERE first_token < 0 OR last_token < first_token""")
def token_bound_violations(spark: SparkSession, d: str) -> DataFrame:
    from spanloom.operators import checks

    rows = current_rows(read(spark, d, "constituents"), ["parse_id", "cons"], ["loaded_at"], ["first_token", "last_token"])
    return checks.token_bounds(rows, ["parse_id", "cons"], "first_token", "last_token")


@C.add("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS total FROM embeddings""")
def embedding_normalize(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    unit = vectors.normalize(F.col("embedding"))
    return e.select("vec_id", F.round(vectors.norm(F.col("embedding")), 5).alias("norm"), F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@C.add("""WITH s AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT query, neighbour, sim, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, neighbour) AS rank FROM s) WHERE rank <= 5""")
def embedding_cosine_top(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    return vectors.nearest(e.filter("vec_id % 100 = 0"), e, "embedding", "vec_id", "vec_id", 5)


@C.add("""WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT label, CAST(i - 1 AS INTEGER) AS i, round(sum(x), 4) AS x FROM x GROUP BY 1, 2""")
def embedding_label_sum(spark: SparkSession, d: str) -> DataFrame:
    s = vectors.sums(read(spark, d, "embeddings"), ["label"], "embedding")
    return s.select("label", F.posexplode("vec").alias("i", "x")).withColumn("x", F.round("x", 4))


@C.add("""WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT label, CAST(i - 1 AS INTEGER) AS i, round(avg(x), 5) AS x FROM x GROUP BY 1, 2""")
def parameter_average(spark: SparkSession, d: str) -> DataFrame:
    s = vectors.sums(read(spark, d, "embeddings"), ["label"], "embedding", average=True)
    return s.select("label", F.posexplode("vec").alias("i", "x")).withColumn("x", F.round("x", 5))


def _labelled_nodes(spark: SparkSession, d: str) -> DataFrame:
    rows = current_rows(read(spark, d, "constituents"), ["parse_id", "cons"], ["loaded_at"], ["parent", "lhs", "first_token"])
    return rows.select(F.col("parse_id").alias("tree"), F.col("cons").cast("bigint").alias("node"), F.when(F.col("parent") >= 0, F.col("parent")).cast("bigint").alias("parent"), F.coalesce("lhs", F.lit("")).alias("label"), F.struct(F.col("first_token"), F.col("cons")).alias("ord"))


def head_percolation(spark: SparkSession, d: str) -> DataFrame:
    """Which child each inner constituent takes its head from."""
    return trees.head_children(_labelled_nodes(spark, d))


def head_percolation_semantic(spark: SparkSession, d: str) -> DataFrame:
    """The same by the semantic rule table."""
    return trees.head_children(_labelled_nodes(spark, d), trees.SEMANTIC_HEAD_RULES)


QUERIES["head_percolation"] = head_percolation
QUERIES["head_percolation_semantic"] = head_percolation_semantic


def _head_sql(rules) -> str:
    rows = ", ".join(f"('{p}', {n}, {str(left).lower()}, '{how}', [{', '.join(repr(x) for x in labels)}]::VARCHAR[])" for p, n, left, how, labels in trees.rule_rows(rules))
    return f"""WITH {_CONS}, k AS (SELECT c.parse_id AS tree, c.parent::BIGINT AS node, coalesce(p.lhs, '') AS pl, c.cons::BIGINT AS child, coalesce(c.lhs, '') AS label, row_number() OVER (PARTITION BY c.parse_id, c.parent ORDER BY c.first_token NULLS FIRST, c.cons) AS pos
FROM cn c JOIN cn p ON p.parse_id = c.parse_id AND p.cons = c.parent WHERE c.parent >= 0), rules(pl, rule, is_left, how, labels) AS (VALUES {rows}),
m AS (SELECT k.*, rule, CASE WHEN is_left THEN pos ELSE -pos END AS scan, CASE WHEN how = 'patient' AND len(labels) > 0 THEN list_position(labels, label) ELSE 0 END AS turn FROM k JOIN rules USING (pl)
WHERE len(labels) = 0 OR (how = 'exclude') <> list_contains(labels, label)),
best AS (SELECT tree, node, child FROM (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY rule, turn, scan) AS rn FROM m) WHERE rn = 1)
SELECT tree, node, coalesce(best.child, last.child) AS head_child FROM (SELECT tree, node, max_by(child, pos) AS child FROM k GROUP BY 1, 2) last LEFT JOIN best USING (tree, node)"""


SQL["head_percolation"] = _head_sql(trees.HEAD_RULES)
SQL["head_percolation_semantic"] = _head_sql(trees.SEMANTIC_HEAD_RULES)


def subtree_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Subtree sizes of all constituents, held against a brute-force walk in the tests."""
    return hierarchy.hierarchy(constituent_nodes(spark, d)).filter("state = 'tree'").select("tree", "node", "depth", "subtree_size")


QUERIES["subtree_sizes"] = subtree_sizes
SQL["subtree_sizes"] = TREES_SQL + """
SELECT a.tree_id AS tree, a.node, (len(string_split(a.path, '/')) - 1)::INTEGER AS depth, count(b.node) AS subtree_size FROM p a LEFT JOIN p b ON b.source = a.source AND b.tree_id = a.tree_id AND (b.path = a.path OR starts_with(b.path, a.path || '/'))
WHERE a.source = 'constituents' GROUP BY ALL"""


def shortest_path_constituents(spark: SparkSession, d: str) -> DataFrame:
    """Distances from every stored root of constituents along stored parents, nodes written tree:node; held against depths in the tests."""
    from spanloom.operators import graphs

    name = lambda c: F.concat_ws(":", "tree", c)
    n = constituent_nodes(spark, d)
    edges = n.filter("parent is not null and tree is not null and node is not null").select(name("parent").alias("parent"), name("node").alias("child"))
    sources = n.filter("is_root and tree is not null and node is not null").select(name("node").alias("source")).distinct()
    return graphs.distances(edges, sources).select("source", "node", "hops")


QUERIES["shortest_path_constituents"] = shortest_path_constituents
SQL["shortest_path_constituents"] = f"""WITH RECURSIVE {_CONS}, w AS (SELECT parse_id, cons AS source, cons AS node, 0 AS hops FROM cn WHERE parent < 0 AND parse_id IS NOT NULL AND cons IS NOT NULL
UNION SELECT w.parse_id, w.source, cn.cons, hops + 1 FROM w JOIN cn ON cn.parse_id = w.parse_id AND cn.parent = w.node WHERE cn.parent >= 0)
SELECT parse_id || ':' || source AS source, parse_id || ':' || node AS node, min(hops)::INTEGER AS hops FROM w GROUP BY 1, 2"""


@C.add(f"""WITH RECURSIVE {_CUR}, n AS (SELECT sent_id, id::BIGINT AS node, nullif(TRY_CAST(head AS BIGINT), 0) AS head FROM cur), k AS (SELECT sent_id, head AS p, min(node) AS f, max(node) AS l FROM n WHERE head IS NOT NULL GROUP BY 1, 2),
c AS (SELECT sent_id, node, node AS x, 0 AS hop FROM n UNION ALL SELECT c.sent_id, c.node, k.f, hop + 1 FROM c JOIN k ON k.sent_id = c.sent_id AND k.p = c.x WHERE hop < 200),
ok AS (SELECT sent_id, node FROM c GROUP BY 1, 2 HAVING max(hop) < 100),
b AS (SELECT c.sent_id, c.node, min(c.x) AS s, greatest(c.node, coalesce(max(k.l), c.node)) + 1 AS e FROM c JOIN ok USING (sent_id, node) LEFT JOIN k ON k.sent_id = c.sent_id AND k.p = c.x GROUP BY 1, 2) SELECT sent_id, node, s AS "start", e AS "end" FROM b""")
def subtree_extent(spark: SparkSession, d: str) -> DataFrame:
    """Extents along left-child chains; words whose chain runs in a ring have none."""
    nodes = word_nodes(spark, d).select(F.col("tree").alias("sent_id"), "node", F.when(~F.coalesce("is_root", F.lit(False)), F.col("parent")).alias("parent"))
    return trees.extents(nodes, "sent_id")


@C.add(f"""WITH {_CUR} SELECT text_id, min(sent_id) AS first, max(sent_id) AS last, count(*) AS n_parts FROM (SELECT DISTINCT text_id, sent_id FROM cur) GROUP BY 1""")
def section_spans(spark: SparkSession, d: str) -> DataFrame:
    rows = current_words(read(spark, d, "conllu"), ["text_id", "sent_id", "id"]).filter(F.col("id").rlike(PLAIN_NUMBER)).select("text_id", "sent_id").distinct()
    out = layers.spans_of_parts(rows.select("text_id", F.col("sent_id").alias("first"), F.col("sent_id").alias("last")), ["text_id"], "first", "last")
    return out


@C.add(f"""WITH {_CUR}, w AS (SELECT sent_id, id::BIGINT AS tok, coalesce(form, '_') AS form FROM cur) SELECT sent_id, string_agg(form, ' ' ORDER BY tok, form) AS text FROM w WHERE tok BETWEEN 2 AND 5 GROUP BY 1""")
def token_slices(spark: SparkSession, d: str) -> DataFrame:
    w = _words(spark, d, "form").withColumn("form", F.coalesce("form", F.lit("_")))
    s = w.select("sent_id").distinct().select("sent_id", F.lit(0).alias("sid"), F.lit(2).alias("first"), F.lit(5).alias("last"))
    return layers.slices(w, s, ["sent_id"], "tok", "form", "first", "last", "sid").drop("sid")


@C.add(f"""WITH {_CUR}, s AS (SELECT text_id, sent_id, count(*) AS n FROM cur GROUP BY 1, 2), o AS (SELECT sent_id, coalesce(sum(n) OVER (PARTITION BY text_id ORDER BY sent_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_tok FROM s)
SELECT cur.sent_id, cur.id::BIGINT AS tok, first_tok + cur.id::BIGINT AS doc_tok FROM cur JOIN o USING (sent_id)""")
def document_token_numbers(spark: SparkSession, d: str) -> DataFrame:
    w = _words(spark, d, "text_id").select("text_id", "sent_id", "tok")
    s = w.groupBy("text_id", "sent_id").agg(F.count("*").alias("length"))
    return layers.document_tokens(w, s, ["text_id"], "sent_id", "tok").select("sent_id", "tok", "doc_tok")
