"""Readers and writers as queries: files are written from the tables and read back; the SQL says what must come out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom import session
from spanloom.operators import counts, layers, weights
from spanloom.plans.catalogue import Catalogue
from spanloom.plans.problems import word_nodes
from spanloom.sources import annotated, text
from spanloom.tables import PLAIN_NUMBER, current_words, read

C = Catalogue()
QUERIES, SQL = C.queries, C.sql

_CUR = """cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word_id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM conllu) WHERE rn = 1 AND regexp_full_match(id, '[0-9]+'))"""


def _place(spark: SparkSession) -> str:
    path = f"{session.shared_dir(spark)}/reading-{uuid.uuid4().hex}"
    session._written.append(path)
    return path


def _named(spark: SparkSession, df: DataFrame, name: str) -> str:
    """df's lines as one file of the given name, in a folder of its own."""
    folder = _place(spark)
    df.coalesce(1).write.text(f"{folder}/parts")
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in fs.listStatus(hadoop.Path(f"{folder}/parts")) if s.getPath().getName().startswith("part-"))
    fs.mkdirs(hadoop.Path(f"{folder}/files"))
    fs.rename(part, hadoop.Path(f"{folder}/files/{name}"))
    return f"{folder}/files/{name}"


@C.add("SELECT c_name AS value, count(*) AS n FROM customer GROUP BY 1")
def lines_compressed(spark: SparkSession, d: str) -> DataFrame:
    """Lines written by bzip2 and gzip, half each, and read together."""
    c, folder = read(spark, d, "customer").select("c_custkey", F.col("c_name").alias("value")), _place(spark)
    text.write_lines(c.filter("c_custkey % 2 = 0").select("value"), f"{folder}/a", "bzip2")
    text.write_lines(c.filter("c_custkey % 2 <> 0").select("value"), f"{folder}/b", "gzip")
    return text.lines(spark, [f"{folder}/a", f"{folder}/b"]).groupBy("value").agg(F.count("*").alias("n"))


@C.add("SELECT CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS value, count(*) AS n FROM customer GROUP BY 1")
def doubles_read(spark: SparkSession, d: str) -> DataFrame:
    """One number a line, some of them none (S3)."""
    folder = _place(spark)
    text.write_lines(read(spark, d, "customer").select(F.when(F.col("c_custkey") % 7 == 0, "none").otherwise(F.concat(F.lit(" "), F.col("c_acctbal").cast("string"))).alias("value")), folder)
    return text.doubles(spark, folder).groupBy("value").agg(F.count("*").alias("n"))


@C.add("SELECT c_custkey::VARCHAR AS key, c_name || chr(9) || c_mktsegment AS value FROM customer")
def pairs_read(spark: SparkSession, d: str) -> DataFrame:
    """Tab-separated pairs with unique keys; what follows the first tab is one field."""
    folder = _place(spark)
    text.write_pairs(read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), folder)
    return text.pairs(spark, folder, unique=True)


@C.add("SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1")
def counted_names_read(spark: SparkSession, d: str) -> DataFrame:
    """Lines like `  12 some name`."""
    folder = _place(spark)
    n = counts.counts(read(spark, d, "part"), "p_name")
    text.write_lines(n.select(F.concat(F.lpad(F.col("n").cast("string"), 9, " "), F.lit(" "), "p_name").alias("value")), folder)
    return text.counted_names(spark, folder)


def _nations(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "nation").select(F.col("n_name").alias("value")).repartition(1).sortWithinPartitions("value")


@C.add("SELECT string_agg(n_name, ' ' ORDER BY n_name) AS value FROM nation")
def whole_file(spark: SparkSession, d: str) -> DataFrame:
    """A file as one text, line ends as blanks."""
    return text.whole(spark, _named(spark, _nations(spark, d), "nations.txt"), one_line=True).select(F.trim("value").alias("value"))


@C.add("SELECT length(t) AS length, md5(t) AS digest FROM (SELECT string_agg(n_name || chr(10), '' ORDER BY n_name) AS t FROM nation)")
def file_bytes(spark: SparkSession, d: str) -> DataFrame:
    """A file as bytes."""
    return text.contents(spark, _named(spark, _nations(spark, d), "nations.txt")).select("length", F.md5("content").alias("digest"))


@C.add("SELECT c_mktsegment AS segment, sum(length(c_name) + 1)::BIGINT AS length FROM customer GROUP BY 1")
def files_found(spark: SparkSession, d: str) -> DataFrame:
    """Files below a folder by name and suffix, with their size, unread."""
    folder = _place(spark)
    read(spark, d, "customer").select("c_mktsegment", "c_name").write.partitionBy("c_mktsegment").text(folder)
    found = text.find(spark, folder, "part-*.txt")
    return found.groupBy(F.regexp_extract(F.url_decode("path"), "c_mktsegment=([^/]+)/", 1).alias("segment")).agg(F.sum("length").alias("length"))


def _conllx_file(spark: SparkSession, d: str) -> str:
    """The current words as a CoNLL-X file; the ninth column holds the sentence."""
    w = current_words(read(spark, d, "conllu"), ["sent_id", "id", "form", "lemma", "upos", "xpos", "head", "deprel"]).filter(F.col("id").rlike(PLAIN_NUMBER))
    v = lambda c: F.coalesce(F.col(c), F.lit("_"))
    line = F.concat_ws("\t", "id", v("form"), v("lemma"), v("upos"), v("xpos"), F.lit("_"), v("head"), v("deprel"), F.col("sent_id").cast("string"), F.lit("_"))
    sentence = w.groupBy("sent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("id").cast("int").alias("i"), line.alias("l")))), lambda x: x["l"]), "\n").alias("s"))
    folder = _place(spark)
    text.write_lines(sentence.select(F.concat("s", F.lit("\n")).alias("value")), folder)
    return folder


_X = f"""{_CUR}, x AS (SELECT sent_id, id::INT AS id, coalesce(form, '_') AS form, coalesce(xpos, '_') AS pos, CASE WHEN regexp_full_match(coalesce(head, '_'), '[0-9]+') AND head::BIGINT > 0 THEN head::BIGINT - 1 END AS head_index, coalesce(deprel, '_') AS deprel,
row_number() OVER (PARTITION BY sent_id ORDER BY id::INT) AS r, count(*) OVER (PARTITION BY sent_id) AS n FROM cur WHERE sent_id IS NOT NULL)"""


@C.add(f"WITH {_X} SELECT sent_id, id, form, pos, head_index::INT AS head_index, deprel, id = r AS in_order FROM x")
def conllx_parse(spark: SparkSession, d: str) -> DataFrame:
    """CoNLL-X sentences between blank lines, ids checked."""
    w = annotated.conllx(spark, _conllx_file(spark, d)).filter("phead <> '_'")
    return w.select(F.col("phead").cast("bigint").alias("sent_id"), F.col("id").cast("int").alias("id"), "form", "pos", "head_index", "deprel", F.col("_corrupt").isNull().alias("in_order"))


@C.add(f"WITH {_X} SELECT sent_id, coalesce(head_index, n)::INT AS parent, (r - 1)::INT AS child, deprel AS label FROM x")
def conllx_graph(spark: SparkSession, d: str) -> DataFrame:
    """CoNLL-X rows as edges from 0; those of the root come from the wall, node n."""
    w = annotated.conllx(spark, _conllx_file(spark, d)).filter("phead <> '_'").withColumn("deprel", F.concat_ws("\t", "phead", "deprel"))
    e = annotated.dependency_edges(w, wall=True)
    return e.select(F.substring_index("label", "\t", 1).cast("bigint").alias("sent_id"), F.col("parent").cast("int"), "child", F.substring_index("label", "\t", -1).alias("label"))


@C.add(f"WITH {_CUR} SELECT word_id, id, coalesce(lemma, '_') AS lemma, coalesce(upos, '_') AS upos, CASE WHEN upos IS NOT NULL THEN upos END AS feature, length(coalesce(form, ''))::VARCHAR AS size FROM cur WHERE sent_id IS NOT NULL")
def conllu_parse(spark: SparkSession, d: str) -> DataFrame:
    """CoNLL-U sentences with their features as a map."""
    w = current_words(read(spark, d, "conllu"), ["sent_id", "id", "form", "lemma", "upos"]).filter(F.col("id").rlike(PLAIN_NUMBER) & F.col("sent_id").isNotNull())
    v = lambda c: F.coalesce(F.col(c), F.lit("_"))
    feats = F.concat(F.when(F.col("upos").isNotNull(), F.concat(F.lit("Class="), "upos", F.lit("|"))).otherwise(""), F.lit("Size="), F.length(F.coalesce("form", F.lit(""))).cast("string"))
    line = F.concat_ws("\t", "id", v("form"), v("lemma"), v("upos"), F.lit("_"), feats, F.lit("_"), F.lit("_"), F.lit("_"), F.col("word_id").cast("string"))
    s = w.groupBy("sent_id").agg(F.array_join(F.concat(F.array(F.lit("# text")), F.collect_list(line)), "\n").alias("s"))
    folder = _place(spark)
    text.write_lines(s.select(F.concat("s", F.lit("\n")).alias("value")), folder)
    u = annotated.conllu(spark, folder).filter("_corrupt is null")
    return u.select(F.col("misc").cast("bigint").alias("word_id"), "id", "lemma", "upos", F.col("feats_map")["Class"].alias("feature"), F.col("feats_map")["Size"].alias("size"))


@C.add("""SELECT c_custkey, unnest([0, 1, 2, 3]) AS id, unnest([NULL, 0, 1, 0]) AS parent, unnest(['S', 'NP', 'EDITED', '-NONE-']) AS category, unnest([NULL, NULL, c_custkey::VARCHAR, c_mktsegment]) AS word,
unnest([0, 0, 0, 1]) AS first_leaf, unnest([1, 0, 0, 1]) AS last_leaf, unnest([false, false, false, true]) AS is_trace, unnest([false, false, true, false]) AS skipped FROM customer""")
def bracket_parse(spark: SparkSession, d: str) -> DataFrame:
    """Bracketed trees as node rows in the order of their open brackets, with the leaves each covers."""
    t = read(spark, d, "customer").select("c_custkey", F.concat(F.lit("(S (NP (EDITED "), F.col("c_custkey").cast("string"), F.lit("))\n (-NONE- "), "c_mktsegment", F.lit("))")).alias("text"))
    return annotated.brackets(t, "c_custkey", "text").filter("_corrupt is null").select("c_custkey", "id", "parent", "category", "word", "first_leaf", "last_leaf", "is_trace", "skipped")


@C.add("SELECT c_name AS comment, c_acctbal > 0 AS y, c_nationkey + 1 AS i0, 101 AS i1, c_acctbal AS v0, 0.5::DOUBLE AS v1 FROM customer")
def svmlight_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Sparse vectors written with indices one higher and read as written."""
    c = read(spark, d, "customer").select((F.col("c_acctbal") > 0).alias("y"), F.array(F.col("c_nationkey"), F.lit(100)).alias("indices"), F.array(F.col("c_acctbal"), F.lit(0.5)).alias("vals"), F.col("c_name").alias("comment"))
    folder = _place(spark)
    text.write_lines(annotated.svmlight_lines(c), folder)
    r = annotated.svmlight(spark, folder).filter("_corrupt is null")
    return r.select("comment", "y", *[F.get("indices", F.lit(i)).alias(f"i{i}") for i in (0, 1)], *[F.get("vals", F.lit(i)).alias(f"v{i}") for i in (0, 1)])


_TRIPLE = """SELECT '/m/' || c_custkey AS mid, 'entity' AS s_type, CASE WHEN c_custkey % 3 = 0 THEN 'integer' WHEN c_custkey % 3 = 1 THEN 'string' ELSE 'other' END AS o_type,
CASE WHEN c_custkey % 3 = 0 THEN c_nationkey::VARCHAR WHEN c_custkey % 3 = 1 THEN c_name ELSE 'plain' END AS o_value, c_custkey % 5 <> 0 AS valid FROM customer"""


def _triples(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    obj = F.when(k % 3 == 0, F.concat(F.lit('"'), F.col("c_nationkey").cast("string"), F.lit('"^^<http://x/XMLSchema#integer>'))).when(k % 3 == 1, F.concat(F.lit('"'), "c_name", F.lit('"@en'))).otherwise("plain")
    line = F.concat(F.lit("<http://x/ns/m."), k.cast("string"), F.lit("> <http://x/name> "), obj, F.when(k % 5 == 0, " <http://g> .").otherwise(" ."))
    folder = _place(spark)
    rows = read(spark, d, "customer").select(line.alias("value"))
    text.write_lines(rows.unionByName(rows.limit(1).select(F.lit("# comment").alias("value"))).unionByName(rows.limit(1).select(F.lit("  ").alias("value"))), folder)
    return annotated.triples(spark, folder)


@C.add(_TRIPLE)
def triple_parse(spark: SparkSession, d: str) -> DataFrame:
    """Triples with typed terms; comments and blank lines are skipped."""
    t = _triples(spark, d).filter(annotated.is_knowledge_node(F.col("s.value")))
    return t.select(annotated.machine_id(F.concat(F.lit("<"), "s.value", F.lit(">"))).alias("mid"), F.col("s.type").alias("s_type"), F.col("o.type").alias("o_type"), F.col("o.value").alias("o_value"), "valid")


@C.add(f"SELECT round(avg(CASE WHEN valid THEN 0.0 ELSE 1.0 END), 8) AS skipped FROM ({_TRIPLE})")
def triple_skipped(spark: SparkSession, d: str) -> DataFrame:
    return annotated.skipped_share(_triples(spark, d)).select(F.round("skipped", 8).alias("skipped"))


@C.add("SELECT 'w' || vec_id AS word, len(embedding) AS dim, round(embedding[1]::DOUBLE, 5) AS first, round(embedding[len(embedding)]::DOUBLE, 5) AS last FROM embeddings WHERE embedding IS NOT NULL")
def word_vectors_read(spark: SparkSession, d: str) -> DataFrame:
    """Word vectors from text with a header."""
    e = read(spark, d, "embeddings").filter("embedding is not null").select(F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("w"), "embedding")
    one = F.concat_ws(" ", "w", F.array_join(F.transform("embedding", lambda x: x.cast("string")), " "))
    size = e.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d"))
    lines = e.select(F.lit(1).alias("o"), one.alias("value")).unionByName(size.select(F.lit(0).alias("o"), F.concat_ws(" ", F.col("n").cast("string"), F.col("d").cast("string")).alias("value")))
    v = annotated.word_vectors(spark, _named(spark, lines.repartition(1).sortWithinPartitions("o").select("value"), "vectors.txt"))
    return v.select("word", F.size("vec").alias("dim"), F.round(F.get("vec", F.lit(0)).cast("double"), 5).alias("first"), F.round(F.element_at("vec", -1).cast("double"), 5).alias("last"))


@C.add("SELECT bit_path, word, frequency, count(*) AS n FROM paths WHERE bit_path IS NOT NULL AND word IS NOT NULL AND word <> '' AND frequency >= 3 GROUP BY ALL")
def cluster_paths_parse(spark: SparkSession, d: str) -> DataFrame:
    """Cluster paths of at least three occurrences."""
    folder = _place(spark)
    p = read(spark, d, "paths").filter("bit_path is not null and word is not null and word <> '' and frequency is not null")
    text.write_pairs(p.select("bit_path", "word", "frequency"), folder)
    return annotated.cluster_paths(spark, folder).groupBy("bit_path", "word", "frequency").agg(F.count("*").alias("n"))


@C.add("SELECT lower(n_name) AS lemma, n_nationkey || '.01' AS id, 'to ' || n_name AS name, '[' || n_regionkey || ']' AS vncls, 2 AS n_roles, '0' AS first_role, 'PAG' AS first_feature FROM nation")
def frames_read(spark: SparkSession, d: str) -> DataFrame:
    """Frame files with their numbered roles; a role without a number is skipped."""
    n = read(spark, d, "nation")
    line = F.concat(
        F.lit('<predicate lemma="'), F.lower("n_name"), F.lit('"><roleset id="'), F.col("n_nationkey").cast("string"), F.lit('.01" name="to '), "n_name", F.lit('" vncls="['), F.col("n_regionkey").cast("string"),
        F.lit(']"><roles><role n="0" f="PAG" descr="doer"/><role n="1" f="PPT" descr="done"><vnrole vncls="1" vntheta="theme"/></role><role n="" f="x" descr="none"/></roles></roleset></predicate>'),
    )
    ends = spark.createDataFrame([(0, "<frameset>"), (2, "</frameset>")], "o int, value string")
    lines = ends.unionByName(n.select(F.lit(1).alias("o"), line.alias("value"))).repartition(1).sortWithinPartitions("o").select("value")
    f = annotated.frames(spark, _named(spark, lines, "nations.xml"))
    return f.select("lemma", "id", "name", "vncls", F.size("roles").alias("n_roles"), F.get("roles", F.lit(0))["role"].alias("first_role"), F.get("roles", F.lit(0))["feature"].alias("first_feature"))


@C.add("SELECT c_custkey, unnest([0, 1]) AS ord, unnest([c_nationkey::VARCHAR, 'q' || c_custkey]) AS mid, unnest([c_nationkey, 30]) AS first, unnest([c_nationkey + 2, 31]) AS end FROM customer")
def mentions_parse(spark: SparkSession, d: str) -> DataFrame:
    """Mention lines `(<mid> <start>-<end>)*`."""
    n = F.col("c_nationkey").cast("string")
    line = F.concat(F.lit("/m/"), n, F.lit(" "), n, F.lit("-"), (F.col("c_nationkey") + 2).cast("string"), F.lit(" /m/q"), F.col("c_custkey").cast("string"), F.lit(" 30-31"))
    return annotated.mentions(read(spark, d, "customer").select("c_custkey", line.alias("value")), "c_custkey")


@C.add(r"""WITH t AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+')) AS term FROM documents) WHERE regexp_full_match(term, '[a-z]+'))
SELECT term, (2 * count(*))::BIGINT AS df, 2 * (SELECT count(DISTINCT doc_id) FROM t) AS n_docs FROM t GROUP BY 1""")
def document_frequencies_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Document frequencies saved with the number of documents first; loading the table twice adds."""
    t = weights.whitespace_terms(read(spark, d, "documents")).filter(F.col("term").rlike("^[a-z]+$")).select("doc", "term").distinct()
    folder = _place(spark)
    text.write_document_frequencies(t.groupBy("term").agg(F.count("*").alias("df")), t.select("doc").distinct().count(), folder)
    return text.document_frequencies(spark, [folder, folder]).select("term", "df", "n_docs")


@C.add("SELECT 'segment' AS space, row_number() OVER (ORDER BY c_mktsegment) - 1 AS id, c_mktsegment AS value FROM (SELECT DISTINCT c_mktsegment FROM customer) UNION ALL SELECT 'name', row_number() OVER (ORDER BY p_name) - 1, p_name FROM (SELECT DISTINCT p_name FROM part)")
def dictionary_file_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Dictionaries of two spaces saved and loaded, ids checked to be dense."""
    seg = counts.dense_ids(read(spark, d, "customer").select(F.col("c_mktsegment").alias("value")).distinct(), ["value"], "id").select(F.lit("segment").alias("space"), "id", "value")
    name = counts.dense_ids(read(spark, d, "part").select(F.col("p_name").alias("value")).distinct(), ["value"], "id").select(F.lit("name").alias("space"), "id", "value")
    folder = _place(spark)
    text.write_pairs(seg.unionByName(name), folder)
    return text.dictionary(spark, folder)


@C.add("SELECT DISTINCT split_part(p_name, ' ', 1) AS word, 'noun' AS pos FROM part")
def index_words_read(spark: SparkSession, d: str) -> DataFrame:
    """Words of a lexicon's index file; comment lines begin with a blank."""
    p = read(spark, d, "part")
    lines = p.select(F.concat(F.substring_index("p_name", " ", 1), F.lit(" n 1 0")).alias("value")).unionByName(p.limit(3).select(F.lit("  1 a comment").alias("value")))
    return text.index_words(spark, _named(spark, lines, "index.noun"))


@C.add("SELECT o_orderstatus AS label, o_orderpriority || '+' || o_custkey AS left_parts, o_orderkey::VARCHAR AS right_parts FROM orders WHERE o_orderpriority NOT LIKE '% %'")
def labelled_keys_parse(spark: SparkSession, d: str) -> DataFrame:
    """Lines `<label> key:a/b ...`, the parts of two chosen keys."""
    o = read(spark, d, "orders").filter("o_orderpriority not like '% %'")
    line = F.concat("o_orderstatus", F.lit(" skip:z l:"), "o_orderpriority", F.lit("/"), F.col("o_custkey").cast("string"), F.lit("  r:"), F.col("o_orderkey").cast("string"))
    folder = _place(spark)
    text.write_lines(o.select(line.alias("value")), folder)
    k = text.labelled_keys(spark, folder, "l", "r")
    return k.select("label", F.array_join("left", "+").alias("left_parts"), F.array_join("right", "+").alias("right_parts"))


@C.add("SELECT c_custkey AS key, c_custkey * 2 AS doubled FROM customer")
def cache_filled(spark: SparkSession, d: str) -> DataFrame:
    """A cache asked for some keys, then for all, then spread over other shards: each key is computed once."""
    keys, folder = read(spark, d, "customer").select(F.col("c_custkey").alias("key")), _place(spark)
    compute = lambda missing: missing.withColumn("doubled", F.col("key") * 2)
    text.cached(keys.filter("key % 3 = 0"), f"{folder}/a", "key", compute)
    text.cached(keys, f"{folder}/a", "key", compute)
    text.rehash(spark, f"{folder}/a", f"{folder}/b", "key", 5)
    return spark.read.parquet(f"{folder}/b").select("key", "doubled")


@C.add("SELECT doc_id, kind AS label FROM documents")
def tool_layer(spark: SparkSession, d: str) -> DataFrame:
    """The annotations of one tool of several, exactly one for each document."""
    docs = read(spark, d, "documents").select("doc_id", F.col("kind").alias("label"))
    both = docs.withColumn("tool", F.lit("a")).unionByName(docs.select("doc_id", F.lit("other").alias("label"), F.lit("b").alias("tool")))
    return annotated.tool_rows(both, "a").select("doc_id", "label")


@C.add(f"""WITH {_CUR}, n AS (SELECT sent_id AS tree, id::BIGINT AS node, CASE WHEN regexp_full_match(head, '[0-9]+') THEN TRY_CAST(head AS BIGINT) END AS parent FROM cur)
SELECT tree, node FROM n a WHERE NOT (a.parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n b WHERE b.tree = a.tree AND b.parent = a.node))""")
def without_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Nodes without the leaves that only hold a word."""
    n = word_nodes(spark, d).withColumn("word", F.lit("w"))
    return layers.without_word_leaves(n, "tree").select("tree", "node")
