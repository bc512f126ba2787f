"""Queries over documents: terms, weights, shapes, n-grams, spans of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import spans, strings
from spanloom.operators import counts, features, joins, weights
from spanloom.plans.catalogue import Catalogue
from spanloom.session import cut
from spanloom.tables import read

C = Catalogue()
QUERIES, SQL = C.queries, C.sql

_WS = r"[ \t\n\r\f\x0B]+"
_TERMS = rf"""terms AS (SELECT doc_id AS doc, term FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '{_WS}')) AS term FROM documents) WHERE term <> '')"""
_TF = f"""{_TERMS}, tf AS (SELECT doc, term, count(*) AS tf FROM terms GROUP BY 1, 2), dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), nd AS (SELECT count(DISTINCT doc) AS n_docs FROM tf),
z AS (SELECT doc, CAST(sum(tf) AS BIGINT) AS z FROM tf GROUP BY 1), idf AS (SELECT term, df, ln(CAST((SELECT n_docs FROM nd) // df AS DOUBLE)) AS idf FROM dfs)"""


def _tf(spark: SparkSession, d: str) -> DataFrame:
    return weights.term_frequencies(weights.whitespace_terms(read(spark, d, "documents")))


@C.add(f"""WITH {_TF}, s AS (SELECT doc, term, tf * idf AS score FROM tf JOIN idf USING (term)), r AS (SELECT doc, term, score, row_number() OVER (PARTITION BY doc ORDER BY score DESC, term) AS rank FROM s WHERE score >= 1e-4)
SELECT doc, term, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def tfidf_top_terms(spark: SparkSession, d: str) -> DataFrame:
    return weights.important_terms(_tf(spark, d), 5).withColumn("score", F.round("score", 6))


@C.add(f"WITH {_TERMS} SELECT term, count(*) AS n FROM terms GROUP BY 1")
def term_counts(spark: SparkSession, d: str) -> DataFrame:
    return counts.counts(weights.whitespace_terms(read(spark, d, "documents")), "term")


@C.add(f"WITH {_TERMS} SELECT term, count(*) AS n, round(count(*) / (SELECT count(*) FROM terms), 9) AS share FROM terms GROUP BY 1")
def term_proportions(spark: SparkSession, d: str) -> DataFrame:
    return counts.proportions(term_counts(spark, d)).withColumn("share", F.round("share", 9))


@C.add(f"WITH {_TERMS} SELECT count(DISTINCT term) AS n_keys, count(*) AS total FROM terms")
def term_totals(spark: SparkSession, d: str) -> DataFrame:
    return counts.total_and_distinct(term_counts(spark, d))


@C.add(f"WITH {_TF} SELECT term, df FROM dfs WHERE df >= 5")
def doc_frequency_min_count(spark: SparkSession, d: str) -> DataFrame:
    return counts.at_least(weights.document_frequencies(_tf(spark, d)), 5, "df")


@C.add(f"""WITH t AS (SELECT source, unnest(regexp_split_to_array(text, '{_WS}')) AS term FROM documents WHERE source IS NOT NULL), c AS (SELECT source, term, count(*) AS n FROM t WHERE term <> '' GROUP BY 1, 2),
r AS (SELECT source, n, row_number() OVER (PARTITION BY source ORDER BY n DESC) AS rn FROM c) SELECT source, max(CASE WHEN n >= rn THEN rn ELSE 0 END) AS h FROM r GROUP BY 1""")
def h_index_by_source(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").filter("source is not null")
    t = weights.whitespace_terms(docs, "source").withColumnRenamed("doc", "source")
    return counts.h_index(counts.counts(t, "source", "term"), ["source"])


_SHAPE_SQL = "term"
for _p, _l in (*strings.SHAPE_CLASSES, *strings.SHAPE_RUNS):
    _SHAPE_SQL = f"regexp_replace({_SHAPE_SQL}, '{_p}', '{_l}', 'g')"


@C.add(f"WITH {_TERMS} SELECT {_SHAPE_SQL} AS shape, count(*) AS n FROM terms GROUP BY 1")
def word_shape_histogram(spark: SparkSession, d: str) -> DataFrame:
    t = weights.whitespace_terms(read(spark, d, "documents"))
    # each distinct term's shape is made once
    per = counts.counts(t, "term").select(strings.word_shape(F.col("term")).alias("shape"), "n")
    return per.groupBy("shape").agg(F.sum("n").alias("n"))


@C.add(f"WITH {_TF} SELECT doc, round((sum(idf * tf) + 1) / (sum(tf) + 1), 6) AS avg_idf FROM tf JOIN idf USING (term) GROUP BY 1")
def average_idf_by_doc(spark: SparkSession, d: str) -> DataFrame:
    return weights.average_idf(_tf(spark, d)).withColumn("avg_idf", F.round("avg_idf", 6))


# a sample small enough for SQL: every document whose id is divisible by 100, against the evaluation items; *_all takes all documents
_PAIR = rf"""b AS (SELECT item_id AS doc, unnest(regexp_split_to_array(text, '{_WS}')) AS term FROM benchmark),
terms AS (SELECT 'd' AS side, doc_id AS doc, term FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '{_WS}')) AS term FROM documents WHERE doc_id % 100 = 0) WHERE term <> '' UNION ALL SELECT 'b', doc, term FROM b WHERE term <> ''),
dt AS (SELECT doc_id AS doc, unnest(regexp_split_to_array(text, '{_WS}')) AS term FROM documents), alltf AS (SELECT doc, term, count(*) AS tf FROM dt WHERE term <> '' GROUP BY 1, 2),
nd AS (SELECT count(DISTINCT doc) AS n FROM alltf), dfs AS (SELECT term, count(*) AS df FROM alltf GROUP BY 1),
tf AS (SELECT side, doc, term, count(*) AS tf FROM terms GROUP BY 1, 2, 3), z AS (SELECT side, doc, sum(tf) AS z FROM tf GROUP BY 1, 2),
x AS (SELECT side, doc, term, tf / z AS share, ln(CAST((SELECT n FROM nd) // coalesce(df, 1) AS DOUBLE)) AS idf FROM tf JOIN z USING (side, doc) LEFT JOIN dfs USING (term))"""


def _pair_sides(spark: SparkSession, d: str, kind: str) -> tuple[DataFrame, DataFrame]:
    docs = read(spark, d, "documents")
    table = cut(weights.idf_table(_tf(spark, d)), "idf")
    left = weights.term_frequencies(weights.whitespace_terms(docs.filter("doc_id % 100 = 0")))
    right = weights.term_frequencies(weights.whitespace_terms(read(spark, d, "benchmark"), "item_id"))
    return weights.weighed(left, table, kind), weights.weighed(right, table, kind)


def _pair_sql(w: str) -> str:
    return f"""WITH {_PAIR}, w AS (SELECT side, doc, term, {w} AS w FROM x), nrm AS (SELECT side, doc, sqrt(sum(w * w)) AS nrm FROM w GROUP BY 1, 2)
SELECT l.doc AS doc_l, r.doc AS doc_r, round(sum(l.w * r.w) / (any_value(nl.nrm) * any_value(nr.nrm)), 6) AS sim FROM w l JOIN w r ON l.term = r.term AND l.side = 'd' AND r.side = 'b'
JOIN nrm nl ON nl.side = 'd' AND nl.doc = l.doc JOIN nrm nr ON nr.side = 'b' AND nr.doc = r.doc WHERE nl.nrm > 0 AND nr.nrm > 0 GROUP BY 1, 2"""


@C.add(_pair_sql("share * sqrt(idf)"))
def pair_cosine_tfidf(spark: SparkSession, d: str) -> DataFrame:
    return weights.cosine(*_pair_sides(spark, d, "plain")).withColumn("sim", F.round("sim", 6))


@C.add(_pair_sql("share * exp(sqrt(idf))"))
def pair_cosine_exp(spark: SparkSession, d: str) -> DataFrame:
    return weights.cosine(*_pair_sides(spark, d, "exp")).withColumn("sim", F.round("sim", 6))


@C.add(f"""WITH {_PAIR}, mx AS (SELECT side, doc, max(idf) AS m FROM x GROUP BY 1, 2), p AS (SELECT DISTINCT l.doc AS doc_l, r.doc AS doc_r FROM x l JOIN x r ON l.term = r.term AND l.side = 'd' AND r.side = 'b'),
pm AS (SELECT doc_l, doc_r, greatest(a.m, b.m) AS m FROM p JOIN mx a ON a.side = 'd' AND a.doc = doc_l JOIN mx b ON b.side = 'b' AND b.doc = doc_r),
v AS (SELECT doc_l, doc_r, side, term, share * sqrt(exp(idf / m)) AS v FROM pm JOIN x ON (x.side = 'd' AND x.doc = doc_l) OR (x.side = 'b' AND x.doc = doc_r)),
g AS (SELECT doc_l, doc_r, term, sum(v) FILTER (side = 'd') AS a, sum(v) FILTER (side = 'b') AS b FROM v GROUP BY 1, 2, 3)
SELECT doc_l, doc_r, round(sum(coalesce(a * b, 0)) / (sqrt(sum(coalesce(a * a, 0))) * sqrt(sum(coalesce(b * b, 0)))), 6) AS sim FROM g GROUP BY 1, 2""")
def pair_cosine_maxexp(spark: SparkSession, d: str) -> DataFrame:
    return weights.cosine_maxexp(*_pair_sides(spark, d, "maxexp")).withColumn("sim", F.round("sim", 6))


# all documents against the evaluation items; in SQL that takes one row per shared term of every pair, so there is none
def _all_sides(spark: SparkSession, d: str, kind: str) -> tuple[DataFrame, DataFrame]:
    tf = _tf(spark, d)
    table = cut(weights.idf_table(tf), "idf")
    right = weights.term_frequencies(weights.whitespace_terms(read(spark, d, "benchmark"), "item_id"))
    return weights.weighed(tf, table, kind), weights.weighed(right, table, kind)


@C.add()
def pair_cosine_tfidf_all(spark: SparkSession, d: str) -> DataFrame:
    return weights.cosine_against(*_all_sides(spark, d, "plain")).withColumn("sim", F.round("sim", 6))


@C.add()
def pair_cosine_exp_all(spark: SparkSession, d: str) -> DataFrame:
    return weights.cosine_against(*_all_sides(spark, d, "exp")).withColumn("sim", F.round("sim", 6))


@C.add()
def pair_cosine_maxexp_all(spark: SparkSession, d: str) -> DataFrame:
    return weights.cosine_against(*_all_sides(spark, d, "maxexp"), maxexp=True).withColumn("sim", F.round("sim", 6))


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return features.token_numbers(read(spark, d, "documents"))


_TOK = rf"""tok AS (SELECT doc_id, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS tok, unnest(w) AS word FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '{_WS}'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL))"""


@C.add(f"""WITH {_TOK}, g AS (SELECT word || ' ' || lead(word, 1) OVER w || ' ' || lead(word, 2) OVER w AS ngram FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY tok)) SELECT ngram, count(*) AS n FROM g WHERE ngram IS NOT NULL GROUP BY 1""")
def token_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return counts.counts(features.ngrams(_tokens(spark, d), ["doc_id"], "tok", "word", 3), "ngram")


@C.add(f"""WITH {_TOK}, f AS (SELECT word AS w0, coalesce(lag(word, 1) OVER w, '<S>') AS wm, coalesce(lead(word, 1) OVER w, '</S>') AS wp FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY tok)),
e AS (SELECT unnest(['word[0]=' || w0, 'word[-1]=' || wm || '*word[0]=' || w0, 'word[-1]=' || wm || '*word[1]=' || wp]) AS feature FROM f) SELECT feature, count(*) AS n FROM e GROUP BY 1""")
def context_window_templates(spark: SparkSession, d: str) -> DataFrame:
    t = features.Templates.context({"word": "word"})
    fired = features.extract(_tokens(spark, d), ["word[0]", "word[-1] * word[0]", "word[-1] * word[1]"], t, ["doc_id"], "tok")
    return counts.counts(fired, "feature")


@C.add(f"""WITH {_TOK}, h AS (SELECT doc_id, tok, lower(word) AS a, lower(lead(word) OVER (PARTITION BY doc_id ORDER BY tok)) AS b FROM tok) SELECT doc_id, tok FROM h WHERE a = 'in' AND b = 'section'""")
def string_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return features.occurrences(_tokens(spark, d), ["In", "section"], ["doc_id"], "tok", "word", ignore_case=True)


def line_spans(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, span, start, end: the tokens of each line of a document."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    sized = F.transform(lines, lambda x: F.size(F.filter(F.split(x, r"[ \t\n\r\f\x0B]+"), lambda w: w != "")))
    rows = read(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(F.filter(sized, lambda n: n > 0)).alias("span", "n"))
    return features.running_offsets(rows, ["doc_id"], "span", "n").select("doc_id", "span", F.col("first_tok").alias("start"), (F.col("first_tok") + F.col("n")).alias("end"))


_LINES = rf"""ln0 AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda l: len(list_filter(regexp_split_to_array(l, '{_WS}'), lambda x: x <> ''))), lambda n: n > 0)) AS n,
generate_subscripts(list_filter(list_transform(string_split(text, chr(10)), lambda l: len(list_filter(regexp_split_to_array(l, '{_WS}'), lambda x: x <> ''))), lambda n: n > 0), 1) - 1 AS span FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, span, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY span) - n AS BIGINT) AS "start", CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY span) AS BIGINT) AS "end" FROM ln0),
win AS (SELECT doc_id, CAST(unnest(range(0, total, 40)) AS BIGINT) AS start_r, total FROM (SELECT doc_id, max("end") AS total FROM lines GROUP BY 1)), wins AS (SELECT doc_id, start_r, least(start_r + 40, total) AS end_r FROM win)"""


def _windows(lines: DataFrame, width: int = 40) -> DataFrame:
    total = lines.groupBy("doc_id").agg(F.max("end").alias("total"))
    return total.select("doc_id", "total", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("total") - 1, F.lit(width).cast("bigint"))).alias("start_r")).select("doc_id", "start_r", F.least(F.col("start_r") + width, "total").alias("end_r"))


def _span_pairs(spark: SparkSession, d: str) -> DataFrame:
    lines = line_spans(spark, d)
    left = lines.select("doc_id", "span", F.col("start").alias("start_l"), F.col("end").alias("end_l"))
    return joins.overlap_join(left, _windows(lines), ["doc_id"])


def _rel(name: str):
    a = lambda: spans.span(F.col("start_l"), F.col("end_l"))
    b = lambda: spans.span(F.col("start_r"), F.col("end_r"))
    return getattr(spans, name)(a(), b())


_OVER = f"""WITH {_LINES}, p AS (SELECT l.doc_id, span, l."start" AS start_l, l."end" AS end_l, start_r, end_r FROM lines l JOIN wins w ON l.doc_id = w.doc_id AND l."start" < end_r AND start_r < l."end")"""


@C.add(_OVER + " SELECT doc_id, span, start_r, CAST(least(end_l, end_r) - greatest(start_l, start_r) AS BIGINT) AS shared FROM p")
def span_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    return _span_pairs(spark, d).select("doc_id", F.col("span").cast("bigint").alias("span"), "start_r", (F.least("end_l", "end_r") - F.greatest("start_l", "start_r")).alias("shared"))


@C.add(_OVER + " SELECT doc_id, span, start_r FROM p WHERE start_r <= start_l AND end_l <= end_r")
def span_cover_join(spark: SparkSession, d: str) -> DataFrame:
    covered = spans.covers(spans.span(F.col("start_r"), F.col("end_r")), spans.span(F.col("start_l"), F.col("end_l")))
    return _span_pairs(spark, d).filter(covered).select("doc_id", F.col("span").cast("bigint").alias("span"), "start_r")


@C.add(_OVER + " SELECT doc_id, span, start_r FROM p WHERE (start_l < start_r AND start_r < end_l AND end_l < end_r) OR (start_r < start_l AND start_l < end_r AND end_r < end_l)")
def span_cross(spark: SparkSession, d: str) -> DataFrame:
    return _span_pairs(spark, d).filter(_rel("crosses")).select("doc_id", F.col("span").cast("bigint").alias("span"), "start_r")


@C.add(f"""WITH {_LINES}, a AS (SELECT doc_id, span, "start", "end", lead("start", 2) OVER (PARTITION BY doc_id ORDER BY span) AS s2 FROM lines) SELECT doc_id, span, CAST(s2 - "end" AS BIGINT) AS gap FROM a WHERE s2 IS NOT NULL""")
def span_distance(spark: SparkSession, d: str) -> DataFrame:
    lines = line_spans(spark, d)
    a = lines.select("doc_id", "span", spans.span(F.col("start"), F.col("end")).alias("a"))
    b = lines.select("doc_id", (F.col("span") - 2).alias("span"), spans.span(F.col("start"), F.col("end")).alias("b"))
    return a.join(b, ["doc_id", "span"]).select("doc_id", F.col("span").cast("bigint").alias("span"), spans.distance(F.col("a"), F.col("b")).alias("gap"))


@C.add("""WITH n AS (SELECT unnest(range(1, 41)) AS n), s AS (SELECT n, s."start" AS st, e."end" AS en FROM n, LATERAL (SELECT unnest(range(1, n + 1)) AS "end") e, LATERAL (SELECT unnest(range(0, e."end")) AS "start") s)
SELECT n, st AS "start", en AS "end", en * (en - 1) // 2 + st AS ix, st + en * (40 + 1) AS code, st || '-' || en AS short FROM s""")
def all_spans_index(spark: SparkSession, d: str) -> DataFrame:
    n = spark.range(1, 41).select(F.col("id").alias("n"))
    s = n.select("n", F.explode(spans.all_spans(F.col("n").cast("int"))).alias("s")).select("n", F.col("s.start").cast("bigint").alias("start"), F.col("s.end").cast("bigint").alias("end"))
    return s.select("n", "start", "end", spans.dense_index(F.col("start"), F.col("end")).alias("ix"), spans.encode(F.col("start"), F.col("end"), 40).alias("code"), spans.short_text(F.col("start"), F.col("end")).alias("short"))


@C.add(f"""WITH {_TOK}, {_LINES} SELECT t.doc_id, t.tok, l.span FROM tok t JOIN lines l ON t.doc_id = l.doc_id AND t.tok >= l."start" AND t.tok < l."end" """)
def token_to_span(spark: SparkSession, d: str) -> DataFrame:
    lines = line_spans(spark, d).select("doc_id", F.col("span").cast("bigint").alias("span"), "start", (F.col("end") - 1).alias("last"))
    return joins.range_join(_tokens(spark, d), lines, ["doc_id"], "tok", "start", "last").select("doc_id", "tok", "span")


@C.add(f"""WITH {_TF}, w AS (SELECT DISTINCT term FROM terms), p AS (SELECT term, unnest(range(0, length(term) + 1)) AS k FROM terms) SELECT substring(term, 1, k) AS prefix, count(*) AS n FROM p GROUP BY 1""")
def prefix_counts(spark: SparkSession, d: str) -> DataFrame:
    # every prefix of every token; each distinct term is exploded once, with its count
    per = term_counts(spark, d)
    p = F.transform(F.sequence(F.lit(0), F.length("term")), lambda i: F.substring(F.col("term"), F.lit(1), i))
    return per.select(F.explode(p).alias("prefix"), "n").groupBy("prefix").agg(F.sum("n").alias("n"))


@C.add("""SELECT lang, count(*) AS n, count(*) FILTER (starts_with(lower(text), 'the ')) AS the_first, sum(CASE WHEN length(text) > 40 THEN 43 ELSE length(text) END)::BIGINT AS shown FROM documents GROUP BY 1""")
def text_scalars(spark: SparkSession, d: str) -> DataFrame:
    shown = F.length(strings.truncate(F.col("text"), 40))
    the = F.sum(F.when(strings.starts_with_ignore_case(F.col("text"), F.lit("The ")), 1).otherwise(0)).cast("bigint").alias("the_first")
    return read(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), the, F.sum(shown).cast("bigint").alias("shown"))


@C.add("""SELECT item_id, reverse(text) AS backwards, left(text, 17) || '...' AS pretty, regexp_replace(text, '[0-9]', '0', 'g') AS zeros FROM benchmark WHERE length(text) > 20""")
def text_rewrites(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return read(spark, d, "benchmark").filter(F.length(t) > 20).select("item_id", strings.reverse_text(t).alias("backwards"), strings.trim_pretty(t, 20).alias("pretty"), strings.zero_digits(t).alias("zeros"))
