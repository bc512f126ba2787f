"""Queries of the problems on large text collections (1, 3, 7, 8, 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import distinctive, encoding, frequency, leakage, look_sql, skeleton
from spanloom.tables import PLAIN_NUMBER, current_rows, current_words, read, specified


def form_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """FORM of the current plain-number words."""
    return current_words(read(spark, d, "conllu"), ["sent_id", "id", "form"]).filter(F.col("id").rlike(PLAIN_NUMBER) & specified("form")).select("sent_id", "form")


def word_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """Words of the cluster runs, each run and word once, with usable frequency."""
    usable = read(spark, d, "paths").filter("word is not null and frequency >= 1")
    return current_rows(usable, ["run_id", "word"], ["loaded_at"], ["frequency"])


def _form(spark: SparkSession, d: str) -> DataFrame:
    f = frequency.term_frequencies(form_occurrences(spark, d), "sent_id", "form")
    return frequency.mark(f, 3, F.col("records") > 0.05 * f.n_records).withColumn("field", F.lit("form"))


def _word(spark: SparkSession, d: str) -> DataFrame:
    f = frequency.term_frequencies(word_occurrences(spark, d), "run_id", "word", "frequency")
    return frequency.mark(f, 3, F.col("occurrences") > 0.005 * f.total).withColumn("field", F.lit("word"))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return _form(spark, d).unionByName(_word(spark, d)).select("field", "term", "occurrences", "records", "mark")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_counts(spark, d).filter("mark is not null").select("field", "term", "mark")


def text_terms(spark: SparkSession, d: str) -> DataFrame:
    """The term of each current plain-number word: LEMMA as spelled, else FORM in lower case, else none."""
    term = F.when(specified("lemma"), F.col("lemma")).when(specified("form"), F.lower("form"))
    return current_words(read(spark, d, "conllu"), ["text_id", "id", "lemma", "form"]).filter(F.col("id").rlike(PLAIN_NUMBER)).select("text_id", term.alias("term"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    scores = distinctive.distinctive_terms(text_terms(spark, d), "text_id", "term", least_d=2)
    return distinctive.top_terms(scores, "tfidf", 3, least_d=2).select(F.col("record").alias("text_id"), "term")


def p3_enriched(spark: SparkSession, d: str) -> DataFrame:
    scores = distinctive.discovery_adjusted(distinctive.distinctive_terms(text_terms(spark, d), "text_id", "term"))
    return scores.select(F.col("record").alias("text_id"), "term", "c", "d", "tfidf", F.round("enrichment", 4).alias("enrichment"), F.round("q", 4).alias("q"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(read(spark, d, "documents"), encoding.tokenizer_path("byte_bpe_50k.tiktoken"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    return encoding.decode(p7_ids(spark, d), encoding.tokenizer_path("byte_bpe_50k.tiktoken"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.leaks(read(spark, d, "documents"), read(spark, d, "benchmark"), run=8, errors=0)
    return found.filter("distance = 0").select("doc_id", "item_id")


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(read(spark, d, "documents"), read(spark, d, "benchmark"), run=8, errors=1)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return skeleton.look_alike_pairs(skeleton.skeleton_keys(read(spark, d, "documents")))


def p9_groups(spark: SparkSession, d: str) -> DataFrame:
    g = skeleton.look_alike_groups(read(spark, d, "documents"))
    return g.select("first_doc", "n_texts", "n_docs")


def p9_members(spark: SparkSession, d: str) -> DataFrame:
    m = skeleton.look_alike_members(read(spark, d, "documents"))
    return m.select("doc_id", F.col("first_doc").alias("class_id"), "n_texts", "n_docs")


QUERIES = {f.__name__: f for f in (p1_counts, p1_found, p3_found, p3_enriched, p7_ids, p7_decoded, p8_found, p8_near, p9_found, p9_groups, p9_members)}

_WORDS = """cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word_id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM conllu) WHERE rn = 1 AND regexp_full_match(id, '[0-9]+'))"""

_COUNTS = f"""WITH {_WORDS},
form AS (SELECT form AS term, count(*) AS occurrences, count(DISTINCT sent_id) AS records FROM cur WHERE form IS NOT NULL AND form NOT IN ('', '_') GROUP BY 1),
nf AS (SELECT count(DISTINCT sent_id) AS n FROM cur WHERE form IS NOT NULL AND form NOT IN ('', '_')),
usable AS (SELECT run_id, word, frequency FROM (SELECT *, row_number() OVER (PARTITION BY run_id, word ORDER BY loaded_at DESC NULLS LAST, frequency DESC) AS rn FROM paths WHERE word IS NOT NULL AND frequency >= 1) WHERE rn = 1),
word AS (SELECT word AS term, CAST(sum(frequency) AS BIGINT) AS occurrences, count(DISTINCT run_id) AS records FROM usable GROUP BY 1),
nw AS (SELECT sum(frequency) AS n FROM usable),
marked AS (
SELECT 'form' AS field, term, occurrences, records, CASE WHEN occurrences < 3 THEN 'rare' WHEN records > 0.05 * (SELECT n FROM nf) THEN 'common' END AS mark FROM form
UNION ALL
SELECT 'word', term, occurrences, records, CASE WHEN occurrences < 3 THEN 'rare' WHEN occurrences > 0.005 * (SELECT n FROM nw) THEN 'common' END FROM word)
"""

#: The point probability of x as a sum of log-gammas; the upper tail is summed as it stands.
_POINT = "lgamma(k + 1) - lgamma(x + 1) - lgamma(k - x + 1) + lgamma(m - k + 1) - lgamma(n - x + 1) - lgamma(m - k - n + x + 1) - lgamma(m + 1) + lgamma(n + 1) + lgamma(m - n + 1)"

_TERMS = f"""WITH {_WORDS},
t AS (SELECT text_id, CASE WHEN lemma IS NOT NULL AND lemma NOT IN ('', '_') THEN lemma WHEN form IS NOT NULL AND form NOT IN ('', '_') THEN lower(form) END AS term FROM cur WHERE text_id IS NOT NULL),
p AS (SELECT text_id, term, count(*) AS c FROM t WHERE term IS NOT NULL GROUP BY 1, 2),"""

SQL = {
    "p3_enriched": f"""{_TERMS} df AS (SELECT term, count(*) AS d, sum(c)::BIGINT AS k FROM p GROUP BY 1), l AS (SELECT text_id, sum(c)::BIGINT AS n FROM p GROUP BY 1), w AS (SELECT count(DISTINCT text_id) AS r, sum(c)::BIGINT AS m FROM p),
j AS (SELECT text_id, term, c, d, n, k, m, round(c * ln(r::DOUBLE / d), 9) AS tfidf FROM p JOIN df USING (term) JOIN l USING (text_id), w),
e AS (SELECT *, CASE WHEN c <= greatest(0, n + k - m) THEN 0.0 ELSE greatest(0.0, -ln(list_sum(list_transform(range(c, least(n, k) + 1), lambda x: exp({_POINT}))))) END AS enrichment FROM j),
o AS (SELECT *, enrichment + ln(row_number() OVER (ORDER BY enrichment DESC, text_id, term) / (SELECT count(*) FROM e)::DOUBLE) AS raw, row_number() OVER (ORDER BY enrichment DESC, text_id, term) AS i FROM e)
SELECT text_id, term, c, d, tfidf, round(enrichment, 4) AS enrichment, round(greatest(0.0, max(raw) OVER (ORDER BY i DESC)), 4) AS q FROM o""",
    "p1_counts": _COUNTS + "SELECT field, term, occurrences, records, mark FROM marked",
    "p1_found": _COUNTS + "SELECT field, term, mark FROM marked WHERE mark IS NOT NULL",
    "p3_found": f"""WITH {_WORDS},
t AS (SELECT text_id, CASE WHEN lemma IS NOT NULL AND lemma NOT IN ('', '_') THEN lemma WHEN form IS NOT NULL AND form NOT IN ('', '_') THEN lower(form) END AS term FROM cur),
p AS (SELECT text_id, term, count(*) AS c FROM t WHERE term IS NOT NULL GROUP BY 1, 2),
df AS (SELECT term, count(*) AS d FROM p GROUP BY 1),
n AS (SELECT count(DISTINCT text_id) AS n FROM p),
s AS (SELECT text_id, term, row_number() OVER (PARTITION BY text_id ORDER BY round(c * ln((SELECT n FROM n)::DOUBLE / d), 9) DESC, term COLLATE "C") AS r FROM p JOIN df USING (term) WHERE d >= 2)
SELECT text_id, term FROM s WHERE r <= 3""",
}
SQL |= look_sql.SQL
