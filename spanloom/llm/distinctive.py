"""How distinctive a term is of its record: hypergeometric enrichment beside inverse document frequency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.session import cut

#: Exact logarithms of factorials up to here; the Stirling series is exact to double precision beyond.
_TABLE = 256
_LOG_FACTORIAL = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, _TABLE)))])

#: A key is joined by broadcast if it holds more than 1 / HEAVY_SHARE of the rows, so at most HEAVY_SHARE keys are.
HEAVY_SHARE = 2_000


def log_factorial(n: np.ndarray) -> np.ndarray:
    """log n! = log-gamma(n + 1), elementwise."""
    n = np.asarray(n, dtype=np.float64)
    x = np.maximum(n, _TABLE - 1) + 1
    series = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(n < _TABLE, _LOG_FACTORIAL[np.minimum(n, _TABLE - 1).astype(np.int64)], series)


def log_upper_tail(c: np.ndarray, n: np.ndarray, k: np.ndarray, m: np.ndarray) -> np.ndarray:
    """log P(X >= c), X hypergeometric: n draws out of m, k of which are marked.

    The point probability comes from log-gamma sums; the tail is summed from there away from the mean, where the terms
    fall, until they no longer count: upwards if c is above the mean, else one minus the sum downwards.
    """
    c, n, k, m = (np.asarray(x, dtype=np.float64) for x in (c, n, k, m))

    def log_point(x):
        lf = log_factorial
        return lf(k) - lf(x) - lf(k - x) + lf(m - k) - lf(n - x) - lf(m - k - n + x) - lf(m) + lf(n) + lf(m - n)

    lowest = np.maximum(0.0, n + k - m)
    up = c > n * k / np.maximum(m, 1)
    start = np.where(up, c, np.maximum(c - 1, lowest))
    first = log_point(start)
    total, term, x = np.ones_like(c), np.ones_like(c), start.copy()
    live = np.ones(len(c), bool)
    while live.any():
        i = np.flatnonzero(live)
        xi, a = x[i], up[i]
        rise = (k[i] - xi) * (n[i] - xi) / ((xi + 1) * (m[i] - k[i] - n[i] + xi + 1))
        fall_den = (k[i] - xi + 1) * (n[i] - xi + 1)
        fall = xi * (m[i] - k[i] - n[i] + xi) / np.where(fall_den > 0, fall_den, 1)
        term[i] *= np.maximum(np.where(a, rise, fall), 0)
        x[i] += np.where(a, 1, -1)
        total[i] += term[i]
        live[i] = term[i] > 1e-17 * total[i]
    log_sum = first + np.log(total)
    below = np.minimum(np.exp(np.minimum(log_sum, 0)), 1 - 1e-16)
    return np.where(c <= lowest, 0.0, np.where(up, np.minimum(log_sum, 0), np.log1p(-below)))


def _enrich(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        c, n, k, m = (b.column(x).to_numpy(zero_copy_only=False) for x in ("c", "n", "k", "m"))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(-log_upper_tail(c, n, k, m))], names=[*b.schema.names, "enrichment"])


def bar(total: int) -> int:
    """The size above which a key of `total` rows counts as hot."""
    return max(total // HEAVY_SHARE, 1_000)


def join_by_size(left: DataFrame, right: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join with a table of one row per key whose column `size` says how many left rows the key has.

    Keys with more than 1 / HEAVY_SHARE of the rows are at most HEAVY_SHARE and go by broadcast, so no hot key is shuffled
    into one task; the others are shuffled. left is read twice and should be a written table.
    """
    heavy = F.broadcast(right.filter(F.col(size) > bar(total)))
    by_broadcast = left.join(heavy, key)
    by_shuffle = left.join(heavy.select(key), key, "left_anti").join(right.filter(F.col(size) <= bar(total)), key)
    return by_broadcast.unionByName(by_shuffle)


def distinctive_terms(occurrences: DataFrame, record: str, term: str, least_d: int = 1) -> DataFrame:
    """Scores of every term of every record: record, term, c, d, n_records, n, k, m, tfidf, enrichment.

    c occurrences in the record, n its length, d records with the term, k occurrences in all, m the length of all, n_records
    the records with any term. tfidf = c ln(n_records / d), rounded to 9 decimals. enrichment = -ln of the exact
    hypergeometric upper-tail probability of c, computed with vectorised log-gamma sums.

    Occurrences meet per (record, term) map-side first; hot terms and hot records are joined by broadcast (join_by_size).
    Terms of fewer than least_d records count in every sum but get no row. Null terms and null records don't count; repeated rows count as often as they occur; an empty table gives no rows.
    """
    rows = occurrences.select(F.col(record).alias("record"), F.col(term).cast("string").alias("term")).filter("record is not null and term is not null")
    pairs = cut(rows.groupBy("record", "term").agg(F.count(F.lit(1)).alias("c")), "pairs")
    records = cut(pairs.groupBy("record").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("__terms")), "records")
    terms = cut(pairs.groupBy("term").agg(F.count(F.lit(1)).alias("d"), F.sum("c").alias("k")), "terms")
    whole = records.agg(F.count(F.lit(1)).alias("r"), F.coalesce(F.sum("n"), F.lit(0)).alias("m"), F.coalesce(F.sum("__terms"), F.lit(0)).alias("p")).head()
    j = join_by_size(pairs, terms.filter(F.col("d") >= least_d), "term", "d", whole["p"])
    sized = cut(j, "sized") if _has_heavy_records(records, whole["p"]) else j
    j = join_by_size(sized, records, "record", "__terms", whole["p"]) if sized is not j else j.join(records, "record")
    j = j.select("record", "term", "c", "d", F.lit(whole["r"]).cast("bigint").alias("n_records"), "n", "k", F.lit(whole["m"]).cast("bigint").alias("m"))
    j = j.withColumn("tfidf", F.round(F.col("c") * F.log(F.col("n_records") / F.col("d")), 9))
    return j.mapInArrow(_enrich, f"{', '.join(f'{c} {t}' for c, t in j.dtypes)}, enrichment double")


def _has_heavy_records(records: DataFrame, total: int) -> bool:
    return not records.filter(F.col("__terms") > bar(total)).isEmpty()


def top_terms(scores: DataFrame, by: str, n: int, least_d: int = 1) -> DataFrame:
    """The n best terms of each record, ties in code-point order; the rank limit is applied before the shuffle."""
    w = Window.partitionBy("record").orderBy(F.col(by).desc(), F.col("term"))
    return scores.filter(F.col("d") >= least_d).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def discovery_adjusted(scores: DataFrame) -> DataFrame:
    """scores with `q`: -ln of the false-discovery adjusted probability (Benjamini-Hochberg over all tests).

    Rows are sorted by range of (enrichment, record, term), so equal enrichments spread like any others. A row's rank is the
    size of the ranges before it plus its rank in its range; the best of all later ranks is carried over ranges likewise. So
    as many numbers as there are ranges are collected twice, and nothing is joined but those.
    """
    scores = cut(scores, "scores")
    spark = scores.sparkSession
    order = [F.col("enrichment").desc(), F.col("record"), F.col("term")]
    ranged = scores.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    down = Window.partitionBy("__part").orderBy(*order)
    ranged = cut(ranged.withColumn("__rank", F.row_number().over(down)), "ranged")
    sizes = {r["__part"]: r["t"] for r in ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("t")).collect()}
    total, before, seen = max(sum(sizes.values()), 1), {}, 0
    for p in sorted(sizes):
        before[p], seen = seen, seen + sizes[p]
    offsets = F.broadcast(spark.createDataFrame(list(before.items()), "__part int, __before bigint"))
    # -ln(p m / rank) = enrichment + ln(rank / m); of equal enrichments the last has the best
    raw = ranged.join(offsets, "__part").withColumn("__q", F.col("enrichment") + F.log((F.col("__before") + F.col("__rank")) / F.lit(float(total))))
    best = {r["__part"]: r["q"] for r in raw.groupBy("__part").agg(F.max("__q").alias("q")).collect()}
    later, after = {}, float("-inf")
    for p in sorted(best, reverse=True):
        later[p], after = after, max(after, best[p])
    tail = F.broadcast(spark.createDataFrame([(p, float(v)) for p, v in later.items()], "__part int, __later double"))
    up = Window.partitionBy("__part").orderBy(F.col("__rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return raw.join(tail, "__part").withColumn("q", F.greatest(F.lit(0.0), F.col("__later"), F.max("__q").over(up))).select(*scores.columns, "q")
