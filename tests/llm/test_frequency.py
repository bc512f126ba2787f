import random
from collections import Counter

from pyspark.sql import functions as F

from spanloom.llm import frequency as fr


def brute(rows):
    occ, rec = Counter(), {}
    for r, t, w in rows:
        if t is not None:
            occ[t] += w or 0
            rec.setdefault(t, set()).add(r)
    return {t: (n, len(rec[t])) for t, n in occ.items()}, len({r for r, t, _ in rows if t is not None}), sum(occ.values())


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], "rec bigint, tok string, weight bigint, term string, n int")
    f = fr.term_frequencies(df, "rec", "tok", "weight", **kw)
    return {r.term: (r.occurrences, r.records) for r in f.counts.collect()}, f.n_records, f.total


def test_against_brute_force(spark):
    rnd = random.Random(1)
    words = ["the", "of", "", "naïve", "x" * 5000, *(f"w{i}" for i in range(300))]
    rows = [(rnd.randrange(40), rnd.choice(words[:5]) if rnd.random() < 0.6 else rnd.choice(words), rnd.choice([1, 2, None])) for _ in range(5000)]
    rows += [(None, "the", 1), (1, None, 5), (None, None, None)]
    for heavy in (1, 3, 1000):
        assert run(spark, rows, heavy_terms=heavy) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == ({}, 0, 0)
    assert run(spark, [(1, None, 1)]) == ({}, 0, 0)


def test_one_term_holds_nearly_all(spark):
    df = spark.range(60_000).select((F.col("id") % 7).alias("rec"), F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("w"), "id")).alias("tok"))
    f = fr.term_frequencies(df, "rec", "tok")
    assert f.counts.filter("term = 'hot'").head().asDict() == {"term": "hot", "occurrences": 54_000, "records": 7}
    assert f.counts.count() == 6001 and f.n_records == 7 and f.total == 60_000


def test_marks(spark):
    df = spark.createDataFrame([(i, "common") for i in range(10)] + [(1, "rare"), (2, "mid"), (2, "mid"), (3, "mid")], "rec bigint, tok string")
    f = fr.term_frequencies(df, "rec", "tok")
    assert {r.term: r.mark for r in fr.mark(f, 3, F.col("records") > 0.5 * f.n_records).collect()} == {"common": "common", "rare": "rare", "mid": None}
