"""Queries over columns and small joins: hashes, strings, sets, lookups, layers, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import hashes, numbers, spans, strings
from spanloom.operators import checks, counts, features, graphs, joins, layers, learning, trees, vectors
from spanloom.plans.catalogue import Catalogue
from spanloom.tables import read

C = Catalogue()
QUERIES, SQL = C.queries, C.sql


def _customer(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer")


def _wrap32(x: str) -> str:
    return f"((({x}) + 2147483648) & 4294967295) - 2147483648"


_CODES = "list_transform(string_split(c_name, ''), lambda x: ascii(x)::BIGINT)"
_STEP = _wrap32("(h + c) * 1025")
_J1 = f"list_reduce(list_prepend(0::BIGINT, {_CODES}), lambda h, c: xor({_STEP}, ({_STEP}) >> 6))"
_JENKINS = f"""j1 AS (SELECT c_custkey, {_wrap32(f"({_J1}) * 9")} AS a FROM customer), j2 AS (SELECT c_custkey, {_wrap32("xor(a, a >> 11) * 32769")} AS jenkins FROM j1)"""


@C.add(f"WITH {_JENKINS} SELECT c_custkey, jenkins::INTEGER AS jenkins FROM j2")
def jenkins_hash(spark: SparkSession, d: str) -> DataFrame:
    """One-at-a-time with signed shifts (H1)."""
    return _customer(spark, d).select("c_custkey", hashes.jenkins(F.col("c_name")).alias("jenkins"))


_EXACT = """s1 AS (SELECT c_custkey, list_transform(range(0, 8), lambda j: ('0x' || substr(sha256(c_name), (2 * j + 1)::BIGINT, 2))::BIGINT) AS b FROM customer),
s2 AS (SELECT c_custkey, list_transform(range(0, 8), lambda j: CASE WHEN len(list_filter(b[j + 2:8], lambda x: x > 127)) % 2 = 1 THEN 255 - b[j + 1] ELSE b[j + 1] END) AS f FROM s1),
s3 AS (SELECT c_custkey, f, ((f[1] - CASE WHEN f[1] > 127 THEN 256 ELSE 0 END) * 72057594037927936::HUGEINT + f[2] * 281474976710656::HUGEINT + f[3] * 1099511627776::HUGEINT + f[4] * 4294967296::HUGEINT + f[5] * 16777216::HUGEINT + f[6] * 65536::HUGEINT + f[7] * 256::HUGEINT + f[8])::BIGINT AS folded FROM s2)"""


@C.add(f"WITH {_EXACT} SELECT c_custkey, folded FROM s3")
def sha_hash(spark: SparkSession, d: str) -> DataFrame:
    """The first eight bytes of SHA-256, each sign-extended, folded by exclusive or (H4)."""
    return _customer(spark, d).select("c_custkey", hashes.sha256_long(F.col("c_name")).alias("folded"))


@C.add(f"WITH {_EXACT} SELECT lower(list_aggregate(list_transform(f, lambda x: printf('%02x', x)), 'string_agg', '')) || chr(9) || c_name AS value FROM s3 JOIN customer USING (c_custkey)")
def hashed_lines(spark: SparkSession, d: str) -> DataFrame:
    """Each line behind its hash in hexadecimal digits (K9)."""
    return hashes.hashed_lines(_customer(spark, d).select(F.col("c_name").alias("value")))


_M = 4294967296


def _turn(x: str, r: int) -> str:
    return f"((({x}) * {1 << r}::HUGEINT) % {_M} + ({x}) // {1 << (32 - r)})"


def _scramble(k: str) -> str:
    return f"({_turn(f'(({k}) * {hashes.MURMUR_C1}::HUGEINT) % {_M}', 15)} * {hashes.MURMUR_C2}::HUGEINT) % {_M}"


_MIXED = f"xor(h, ({_scramble('k')})::HUGEINT)"
_MURMUR = f"""WITH b AS (SELECT c_custkey, list_transform(string_split(c_name, ''), lambda x: ascii(x)::HUGEINT) AS a FROM customer),
k AS (SELECT c_custkey, list_transform(range(0, 4), lambda i: a[4 * i + 1] + a[4 * i + 2] * 256 + a[4 * i + 3] * 65536 + a[4 * i + 4] * 16777216) AS ks, a[17] + a[18] * 256 AS tail FROM b),
r AS (SELECT c_custkey, list_reduce(list_prepend(0::HUGEINT, ks), lambda h, k: ({_turn(_MIXED, 13)} * 5 + {hashes.MURMUR_ADD}) % {_M}) AS h, tail AS k FROM k),
t AS (SELECT c_custkey, xor({_MIXED}, 18::HUGEINT) AS h FROM r), u AS (SELECT c_custkey, (xor(h, h // 65536) * {hashes.MURMUR_MIX1}) % {_M} AS h FROM t), v AS (SELECT c_custkey, (xor(h, h // 8192) * {hashes.MURMUR_MIX2}) % {_M} AS h FROM u), w AS (SELECT c_custkey, xor(h, h // 65536) AS h FROM v)
SELECT c_custkey, (CASE WHEN h >= 2147483648 THEN h - {_M} ELSE h END)::INTEGER AS murmur FROM w"""


@C.add(_MURMUR)
def murmur_hash(spark: SparkSession, d: str) -> DataFrame:
    """Standard Murmur3 of 32 bits over UTF-8 (H5)."""
    return _customer(spark, d).select("c_custkey", hashes.murmur3(F.col("c_name")).alias("murmur"))


_W = "18446744073709551616"
_MIX = f"""WITH b AS (SELECT c_custkey, flatten(list_transform(range(0, 8), lambda i: [((c_custkey::HUGEINT) // (256::HUGEINT ** i)::HUGEINT) % 256, ((c_nationkey::HUGEINT) // (256::HUGEINT ** i)::HUGEINT) % 256])) AS bytes FROM customer),
r AS (SELECT c_custkey, list_reduce(list_prepend(0::HUGEINT, bytes), lambda h, c: xor(((h + c) * 1025) % {_W}, (((h + c) * 1025) % {_W}) // 64)) AS h FROM b),
s AS (SELECT c_custkey, (h * 9) % {_W} AS h FROM r), t AS (SELECT c_custkey, (xor(h, h // 2048) * 32769) % {_W} AS h FROM s) SELECT c_custkey, (CASE WHEN h >= 9223372036854775808 THEN h - {_W} ELSE h END)::BIGINT AS mixed FROM t"""


@C.add(_MIX)
def mixed_hash(spark: SparkSession, d: str) -> DataFrame:
    """Two numbers mixed into 64 bits (H2)."""
    return _customer(spark, d).select("c_custkey", hashes.mixed(F.col("c_custkey"), F.col("c_nationkey")).alias("mixed"))


@C.add("SELECT c_custkey, c_custkey * 25 + c_nationkey AS code, (c_custkey * 25 + c_nationkey) // 25 AS x, (c_custkey * 25 + c_nationkey) % 25 AS y FROM customer")
def interleaved(spark: SparkSession, d: str) -> DataFrame:
    """Two numbers as one, undone by division (H3)."""
    code = hashes.interleave(F.col("c_nationkey"), 25, F.col("c_custkey"))
    return _customer(spark, d).select("c_custkey", code.alias("code"), F.expr("(c_custkey * 25 + c_nationkey) div 25").alias("x"), F.pmod(code, F.lit(25)).alias("y"))


@C.add("""WITH b AS (SELECT c_custkey, list_sum(list_transform(range(0, 15), lambda i: ('0x' || substr(md5(c_name), (2 * i + 1)::BIGINT, 2))::HUGEINT * (1::HUGEINT << (8 * i)::INT))) AS v FROM customer)
SELECT c_custkey, unnest(range(0, 9)) AS i, ((v::HUGEINT >> (unnest(range(0, 9)) * 12)::INT) & 4095)::BIGINT AS field FROM b""")
def digest_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of 12 bits of a digest, least significant first (H7)."""
    digest = F.unhex(F.md5("c_name"))
    return _customer(spark, d).select("c_custkey", F.posexplode(F.array(*[hashes.bit_field(digest, i, 12) for i in range(9)])).alias("i", "field")).withColumn("i", F.col("i").cast("bigint"))


@C.add("SELECT count(DISTINCT (c_nationkey, c_mktsegment)) AS keys, count(DISTINCT (c_nationkey, c_mktsegment)) AS hashes FROM customer")
def composite_keys(spark: SparkSession, d: str) -> DataFrame:
    """One 64-bit key of several columns tells them apart (H8)."""
    return _customer(spark, d).agg(F.count_distinct("c_nationkey", "c_mktsegment").alias("keys"), F.count_distinct(hashes.composite(F.col("c_nationkey"), F.col("c_mktsegment"))).alias("hashes"))


@C.add("SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents WHERE kind = 'bracket' AND text IS NOT NULL GROUP BY text")
def distinct_parses(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the same parse once each, by the smallest id (H9)."""
    return joins.once_each(read(spark, d, "documents").filter("kind = 'bracket' and text is not null"), "text", "doc_id")


@C.add("""SELECT c_custkey, c_name || '; null; ' || c_mktsegment AS joined, 'nmod(' || c_mktsegment || ',' || c_name || ')' AS edge, '(#1,NN)(NN,#2)(#1,#2)' AS path,
round((ascii(c_mktsegment[1]) + (ascii(c_mktsegment[2]) + ascii(c_mktsegment[3]) / 127.0 * 0.999999999999) / 127.0 * 0.999999999999) / 127.0, 8) AS real, c_nationkey::VARCHAR AS mapped FROM customer""")
def string_forms(spark: SparkSession, d: str) -> DataFrame:
    """Joined items, edges as text, paths without words, text as an ordered number, mappings."""
    name, seg = F.col("c_name"), F.col("c_mktsegment")
    path = F.concat(F.lit("(x"), seg, F.lit(",NN)(NN,y"), name, F.lit(")(x"), seg, F.lit(",y"), name, F.lit(")"))
    return _customer(spark, d).select(
        "c_custkey", strings.join_items(F.array(name, F.lit(None), seg), "; ").alias("joined"), strings.edge_text(F.lit("nmod"), seg, name).alias("edge"), strings.delexicalized(path).alias("path"),
        F.round(strings.ascii_to_real(F.substring(seg, 1, 3)), 8).alias("real"), strings.parse_mapping(F.concat(F.lit("a:1,n:"), F.col("c_nationkey").cast("string")))["n"].alias("mapped"),
    )


@C.add("""WITH m AS (SELECT c_custkey, md5(c_name) AS h FROM customer), u AS (SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS uuid, ('0x' || substr(h, 1, 16))::UBIGINT::HUGEINT AS a, ('0x' || substr(h, 17, 16))::UBIGINT::HUGEINT AS b FROM m)
SELECT c_custkey, (CASE WHEN a >= 9223372036854775808 THEN a - 18446744073709551616 ELSE a END)::BIGINT AS high, (CASE WHEN b >= 9223372036854775808 THEN b - 18446744073709551616 ELSE b END)::BIGINT AS low, uuid FROM u""")
def uuid_numbers(spark: SparkSession, d: str) -> DataFrame:
    """UUIDs as two numbers and back."""
    u = _customer(spark, d).select("c_custkey", F.regexp_replace(F.md5("c_name"), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5").alias("u")).withColumn("h", strings.uuid_halves(F.col("u")))
    return u.select("c_custkey", F.col("h.high").alias("high"), F.col("h.low").alias("low"), strings.uuid_text(F.col("h.high"), F.col("h.low")).alias("uuid"))


@C.add("""WITH t AS (SELECT o_custkey, list(DISTINCT CAST(strftime(o_orderdate, '%m') AS BIGINT) ORDER BY CAST(strftime(o_orderdate, '%m') AS BIGINT)) AS ms, count(*) AS n FROM orders GROUP BY 1)
SELECT o_custkey, ms[len(ms)] - ms[1] + 1 = len(ms) AS without_gap, CASE WHEN ms[len(ms)] - ms[1] + 1 = len(ms) THEN ms[1] END AS first, CASE WHEN ms[len(ms)] - ms[1] + 1 = len(ms) THEN ms[len(ms)] + 1 END AS after, round(n - sqrt(len(ms)), 8) AS priority FROM t""")
def token_lists(spark: SparkSession, d: str) -> DataFrame:
    """Whether a list has a gap, its span if not, and the priority of what has children."""
    o = read(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set(F.month("o_orderdate").cast("bigint"))).alias("ms"), F.count("*").alias("n"))
    s = spans.span_of(F.col("ms"))
    return o.select("o_custkey", numbers.contiguous(F.col("ms")).alias("without_gap"), s["start"].cast("bigint").alias("first"), s["end"].cast("bigint").alias("after"), F.round(numbers.expansion_priority(F.col("n"), F.size("ms")), 8).alias("priority"))


_SETS = "a AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS q FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)"


@C.add(f"WITH {_SETS}, j AS (SELECT o_custkey, len(p) AS n, len(q) AS m, len(list_intersect(p, q)) AS i FROM a JOIN b USING (o_custkey)) SELECT o_custkey, (n + m - 2 * i)::INTEGER AS apart, round((n + m - 2 * i) / (n + m), 8) AS share FROM j")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    """How many items are in exactly one of two sets."""
    o = read(spark, d, "orders")
    side = lambda s, n: o.filter(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias(n))
    j = side("F", "p").join(side("O", "q"), "o_custkey")
    return j.select("o_custkey", joins.symmetric_difference(F.col("p"), F.col("q")).alias("apart"), F.round(joins.symmetric_difference(F.col("p"), F.col("q"), True), 8).alias("share"))


@C.add("SELECT c_custkey, ord, n_nationkey, n_name FROM (SELECT c_custkey, 0 AS ord, c_nationkey AS k FROM customer UNION ALL SELECT c_custkey, 1, (c_nationkey + 1) % 25 FROM customer) x JOIN nation ON n_nationkey = k")
def lookup_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists of keys with the row of each key, in list order."""
    refs = _customer(spark, d).select("c_custkey", F.array(F.col("c_nationkey"), ((F.col("c_nationkey") + 1) % 25)).alias("keys"))
    return joins.lookup_in_order(refs, read(spark, d, "nation").select("n_nationkey", "n_name"), "keys", "n_nationkey").select("c_custkey", "ord", "n_nationkey", "n_name")


@C.add("SELECT r_regionkey, r_name FROM region WHERE r_regionkey = 2")
def unique_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The one row that meets a condition; none or several are an error."""
    return joins.unique_match(read(spark, d, "region").select("r_regionkey", "r_name"), F.col("r_regionkey") == 2)


@C.add("""WITH t AS (SELECT parse_id, unnest(range(0, m + 1)) AS tok FROM (SELECT parse_id, max(last_token) AS m FROM constituents WHERE last_token < 200 GROUP BY 1)), s AS (SELECT DISTINCT parse_id, first_token, last_token, cons FROM constituents WHERE lhs = 'NP' AND first_token >= 0 AND last_token >= first_token)
SELECT t.parse_id, t.tok, coalesce(max(s.cons), -1) AS mention FROM t LEFT JOIN s ON s.parse_id = t.parse_id AND t.tok BETWEEN s.first_token AND s.last_token GROUP BY 1, 2""")
def last_mentions(spark: SparkSession, d: str) -> DataFrame:
    """The last of the mentions that cover each token, -1 for none."""
    c = read(spark, d, "constituents")
    m = c.filter("last_token < 200").groupBy("parse_id").agg(F.max("last_token").cast("bigint").alias("m"))
    tokens = m.filter("m >= 0").select("parse_id", F.explode(F.sequence(F.lit(0).cast("bigint"), "m")).alias("tok"))
    spans_ = c.filter("lhs = 'NP' and first_token >= 0 and last_token >= first_token").select("parse_id", F.col("first_token").alias("s"), (F.col("last_token") + 1).alias("e"), "cons").distinct()
    return joins.last_mention(tokens, spans_, ["parse_id"], "tok", "s", "e", "cons").select("parse_id", "tok", "mention")


@C.add("SELECT c_custkey AS ord, c_name, o_totalprice FROM customer JOIN orders ON o_orderkey = c_custkey")
def zipped_rows(spark: SparkSession, d: str) -> DataFrame:
    """Two tables side by side by ordinal."""
    return joins.zip_positions(_customer(spark, d).select(F.col("c_custkey").alias("ord"), "c_name"), read(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), "o_totalprice"), "ord")


@C.add("SELECT event_type, min(event_id) AS first_at FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def ordered_unique(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values in order of first appearance."""
    return counts.ordered_distinct(read(spark, d, "events").filter("event_type is not null"), "event_type", "event_id")


_E = "SELECT DISTINCT l_orderkey AS parent, l_partkey AS child FROM lineitem"


@C.add(f"SELECT parent - 100 AS parent, child - 100 AS child FROM ({_E}) WHERE parent BETWEEN 100 AND 900 AND child BETWEEN 100 AND 900")
def induced_graph(spark: SparkSession, d: str) -> DataFrame:
    """The subgraph on a range of nodes, counted from 0."""
    e = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_partkey").alias("child")).distinct()
    return graphs.induced(e, 100, 900)


_F = "f AS (SELECT o_custkey AS k, o_orderpriority AS feature, count(*) AS c FROM orders GROUP BY 1, 2)"


@C.add(f"WITH {_F}, w AS (SELECT DISTINCT o_orderpriority AS feature, o_orderstatus AS label, (length(o_orderpriority) - ascii(o_orderstatus))::DOUBLE AS weight FROM orders WHERE o_orderpriority NOT LIKE '5%') SELECT k, label, sum(weight) AS score FROM f JOIN w USING (feature) GROUP BY 1, 2")
def label_scores(spark: SparkSession, d: str) -> DataFrame:
    """The weights of each label over the features that fire (V6)."""
    o = read(spark, d, "orders")
    f = o.select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("feature")).distinct()
    w = o.filter("o_orderpriority not like '5%'").select(F.col("o_orderpriority").alias("feature"), F.col("o_orderstatus").alias("label")).distinct()
    return features.score(f, w.withColumn("weight", (F.length("feature") - F.ascii("label")).cast("double")), ["k"])


@C.add(f"WITH {_F}, g AS (SELECT o_custkey AS k, o_orderstatus AS feature, count(*) AS c FROM orders GROUP BY 1, 2) SELECT k, f.feature || '*' || g.feature AS name, f.c * g.c AS weight FROM f JOIN g USING (k)")
def feature_products(spark: SparkSession, d: str) -> DataFrame:
    """Two feature sets of a key multiplied."""
    o = read(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    side = lambda c: o.groupBy("k", F.col(c).alias("name")).agg(F.count("*").alias("weight"))
    return vectors.product(side("o_orderpriority"), side("o_orderstatus"), ["k"])


@C.add("SELECT c_nationkey AS entity, array_to_string(list(DISTINCT c_custkey ORDER BY c_custkey), ',') AS mentions FROM customer WHERE c_nationkey IS NOT NULL GROUP BY 1")
def entity_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Clusters as sets of mentions, no mention in two."""
    return layers.entity_sets(_customer(spark, d).filter("c_nationkey is not null").select(F.col("c_nationkey").alias("entity"), "c_custkey"), "entity", "c_custkey").withColumn("mentions", F.array_join("mentions", ","))


@C.add("SELECT o_custkey, min(m) AS first, max(m) AS last FROM (SELECT o_custkey, month(o_orderdate) AS m FROM orders) GROUP BY 1 HAVING max(m) - min(m) + 1 = count(DISTINCT m)")
def mention_spans(spark: SparkSession, d: str) -> DataFrame:
    """Mentions given as tokens, those with a gap left out."""
    return layers.contiguous_mentions(read(spark, d, "orders").select("o_custkey", F.month("o_orderdate").cast("bigint").alias("m")), ["o_custkey"], "m")


@C.add("SELECT c_custkey, '(S (N ' || c_name || ') (V ' || c_mktsegment || '))' AS text FROM customer")
def bracketed_trees(spark: SparkSession, d: str) -> DataFrame:
    """Trees written with brackets."""
    rows = F.array(
        F.struct(F.lit(0).alias("node"), F.lit(None).cast("int").alias("parent"), F.lit("S").alias("label"), F.lit(0).alias("ord"), F.lit(None).cast("string").alias("word")),
        F.struct(F.lit(1).alias("node"), F.lit(0).alias("parent"), F.lit("N").alias("label"), F.lit(1).alias("ord"), F.col("c_name").alias("word")),
        F.struct(F.lit(2).alias("node"), F.lit(0).alias("parent"), F.lit("V").alias("label"), F.lit(2).alias("ord"), F.col("c_mktsegment").alias("word")),
    )
    return trees.bracketed(_customer(spark, d).select("c_custkey", F.inline(rows)), "c_custkey")


@C.add("SELECT o_orderkey, 0.0::DOUBLE AS muted, o_totalprice + CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE 1.0 END AS augmented FROM orders")
def augmented_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores switched off, and with the loss of a wrong choice added (L4)."""
    o = read(spark, d, "orders")
    return o.select("o_orderkey", learning.muted(F.col("o_totalprice"), False).alias("muted"), learning.loss_augmented(F.col("o_totalprice"), F.col("o_orderstatus") == "F", 1.0).alias("augmented"))


@C.add("SELECT c_custkey, 2.0 * (c_nationkey * c_acctbal + 3.0) AS scalar, c_nationkey * c_acctbal + 1.5 AS diagonal, c_nationkey * 0.5 * c_acctbal + c_nationkey * 3.0 + c_acctbal AS full FROM customer")
def bilinear_scores(spark: SparkSession, d: str) -> DataFrame:
    """Bilinear scores by a scalar, a diagonal and a matrix."""
    y, x = F.array(F.col("c_nationkey").cast("double"), F.lit(1.0)), F.array(F.col("c_acctbal"), F.lit(3.0))
    return _customer(spark, d).select("c_custkey", learning.bilinear(y, x, 2.0).alias("scalar"), learning.bilinear(y, x, [1.0, 0.5]).alias("diagonal"), learning.bilinear(y, x, [[0.5, 1.0], [1.0, 0.0]]).alias("full"))


@C.add("""WITH s AS (SELECT c_mktsegment AS v, row_number() OVER (ORDER BY min(c_custkey), c_mktsegment) - 1 AS id FROM customer GROUP BY 1), n AS (SELECT c_name AS v, row_number() OVER (ORDER BY min(c_custkey), c_name) - 1 AS id FROM customer GROUP BY 1)
SELECT c_custkey, n.id || chr(9) || c_acctbal_text || chr(9) || s.id AS value FROM (SELECT *, c_nationkey::VARCHAR AS c_acctbal_text FROM customer) JOIN s ON s.v = c_mktsegment JOIN n ON n.v = c_name""")
def tsv_columns_encoded(spark: SparkSession, d: str) -> DataFrame:
    """Chosen columns of tab-separated lines as dictionary ids (K8)."""
    lines = _customer(spark, d).select("c_custkey", F.concat_ws("\t", "c_name", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("value"))
    return counts.encode_columns(lines, "value", "c_custkey", [0, 2])[0]


@C.add("SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority NOT IN (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderkey % 977 = 1)")
def values_without_id(spark: SparkSession, d: str) -> DataFrame:
    """Values that a dictionary lacks (F16)."""
    o = read(spark, d, "orders")
    return checks.out_of_dictionary(o, "o_orderpriority", o.filter("o_orderkey % 977 = 1").select("o_orderpriority").distinct())


@C.add("SELECT c_custkey, unnest(['a-' || c_name, c_name || '-' || c_mktsegment]) AS gram FROM customer")
def path_grams(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of neighbours along a path."""
    return _customer(spark, d).select("c_custkey", F.explode(trees.path_ngrams(F.array(F.lit("a"), "c_name", "c_mktsegment"), 2)).alias("gram"))
