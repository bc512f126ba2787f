"""Sketches, samples and streams: no SQL gives the same rows; bounds, sizes and equality with batch are tested instead."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import sampling, sketches, weights
from spanloom.plans.catalogue import Catalogue
from spanloom.session import shared_dir
from spanloom.streaming import stateful
from spanloom.tables import read

C = Catalogue()
QUERIES, SQL = C.queries, C.sql


@C.add()
def heavy_hitters_approx(spark: SparkSession, d: str) -> DataFrame:
    return sketches.heavy_hitters(weights.whitespace_terms(read(spark, d, "documents")), "term", 50)


def _error(spark: SparkSession, d: str, conservative: bool) -> DataFrame:
    t = weights.whitespace_terms(read(spark, d, "documents"))
    exact = t.groupBy("term").agg(F.count("*").alias("n"))
    return sketches.estimate(exact, "term", sketches.build(t, "term", conservative=conservative)).withColumn("error", F.col("estimate") - F.col("n"))


@C.add()
def count_min_error(spark: SparkSession, d: str) -> DataFrame:
    return _error(spark, d, False)


@C.add()
def count_min_conservative(spark: SparkSession, d: str) -> DataFrame:
    return _error(spark, d, True)


@C.add()
def sketch_capacity(spark: SparkSession, d: str) -> DataFrame:
    return sketches.capacity(sketches.build(weights.whitespace_terms(read(spark, d, "documents")), "term", bits=16))


_TERM_COUNTS = r"""WITH t AS (SELECT term, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+')) AS term FROM documents) WHERE term <> '' GROUP BY 1)"""


@C.add(_TERM_COUNTS + " SELECT kind, terms, 0::BIGINT AS below, true AS within FROM (SELECT count(*) AS terms FROM t), (VALUES ('conservative'), ('plain')) AS v(kind)")
def sketch_bounds(spark: SparkSession, d: str) -> DataFrame:
    """kind, terms, below, within: no estimate is below its count, and not more than 5 % of them exceed it by e N / width."""
    out = None
    for name, conservative in (("plain", False), ("conservative", True)):
        e = _error(spark, d, conservative)
        total = e.agg(F.sum("n").alias("total"))
        r = e.agg(F.count("*").alias("terms"), F.count_if(F.col("error") < 0).alias("below"), F.count_if(F.col("error") > 2.7183 / 4096 * total.scalar()).alias("over"))
        r = r.select(F.lit(name).alias("kind"), "terms", "below", (F.col("over") <= 0.05 * F.col("terms")).alias("within"))
        out = r if out is None else out.unionByName(r)
    return out


@C.add(_TERM_COUNTS + " SELECT term AS item, n FROM t ORDER BY n DESC, item LIMIT 10")
def heavy_hitters_top(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent terms of one mergeable pass."""
    return heavy_hitters_approx(spark, d).orderBy(F.desc("n"), "item").limit(10)


@C.add("""SELECT 'reservoir' AS kind, least(100, count(*)) AS n, least(100, count(*)) AS known FROM orders UNION ALL SELECT 'permutation', count(*), count(*) FROM orders
UNION ALL SELECT 'weighted', least(50, count(DISTINCT o_custkey)), least(50, count(DISTINCT o_custkey)) FROM orders UNION ALL SELECT 'span', count(*), count(*) FROM orders UNION ALL SELECT 'projection', count(DISTINCT c_mktsegment), count(DISTINCT c_mktsegment) FROM customer""")
def sample_facts(spark: SparkSession, d: str) -> DataFrame:
    """kind, n, known: sizes of samples, and how many of their rows are distinct and sound."""
    o = read(spark, d, "orders")
    keys = o.select("o_orderkey").distinct()
    n = lambda df, kind, key, of: df.join(of, key, "left_semi").agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.count_distinct(key).alias("known"))
    r = n(reservoir_sample(spark, d).select("o_orderkey"), "reservoir", "o_orderkey", keys)
    p = n(shuffled_orders(spark, d), "permutation", "o_orderkey", keys)
    w = n(weighted_key_sample(spark, d).select("o_custkey"), "weighted", "o_custkey", o.select("o_custkey").distinct())
    span = o.select(sampling.random_span(F.lit(30), ["o_orderkey"]).alias("s"))
    s = span.agg(F.lit("span").alias("kind"), F.count("*").alias("n"), F.count_if((F.col("s.start") >= 0) & (F.col("s.start") < F.col("s.end")) & (F.col("s.end") <= 30)).alias("known"))
    length = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    v = random_projection_customers(spark, d).agg(F.lit("projection").alias("kind"), F.count("*").alias("n"), F.count_if((F.size("vec") == 16) & (F.abs(length - 1) < 1e-9)).alias("known"))
    return r.unionByName(p).unionByName(w).unionByName(s).unionByName(v)


@C.add()
def reservoir_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.reservoir(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 100)


@C.add()
def shuffled_orders(spark: SparkSession, d: str) -> DataFrame:
    return sampling.permutation(read(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])


@C.add()
def weighted_key_sample(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return sampling.weighted_keys(n, "o_custkey", F.sqrt("n"), 50)


@C.add()
def random_projection_customers(spark: SparkSession, d: str) -> DataFrame:
    seg = read(spark, d, "customer").select("c_mktsegment").distinct()
    return seg.select("c_mktsegment", sampling.random_projection(F.col("c_mktsegment"), 16).alias("vec"))


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    # a pattern, as the table may be one file or a folder
    return stateful.read_folder(spark, f"{d}/events.parque[t]", read(spark, d, "events").schema)


def _where(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


@C.add("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_counts_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return stateful.drain(stateful.running_counts(_event_stream(spark, d), "event_type"), "counts", "complete", _where(spark))


@C.add("""SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    s = stateful.windowed_counts(_event_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 hour", "40 days")
    out = stateful.drain(s, "windows", "complete", _where(spark))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@C.add("SELECT user_id::VARCHAR AS item, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, item LIMIT 20")
def stream_topk(spark: SparkSession, d: str) -> DataFrame:
    """item, n: the 20 users with most events, exact; state is one number a user."""
    rows = stateful.drain(stateful.running_counts(_event_stream(spark, d), "user_id"), "top", "update", _where(spark))
    return stateful.top_of_counts(rows, "user_id", 20)
