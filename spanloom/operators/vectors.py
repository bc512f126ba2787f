"""Sparse named weights and dense vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aggregate_features(df: DataFrame, keys: list[str], name: str = "name", weight: str = "weight") -> DataFrame:
    """keys, name, sum_w, max_w: the weights of each name."""
    return df.groupBy(*keys, name).agg(F.sum(weight).alias("sum_w"), F.max(weight).alias("max_w"))


def first_wins(df: DataFrame, keys: list[str], name: str, weight: str, order: str) -> DataFrame:
    """keys, name, weight: of repeated names the first in order."""
    return df.groupBy(*keys, name).agg(F.min_by(weight, order).alias(weight))


def by_namespace(df: DataFrame, name: str = "name") -> DataFrame:
    """df with `ns` and `local`: what stands before and after the first slash; no slash means an empty namespace."""
    has = F.col(name).contains("/")
    return df.withColumn("ns", F.when(has, F.substring_index(name, "/", 1)).otherwise("")).withColumn("local", F.when(has, F.regexp_replace(name, "^[^/]*/", "")).otherwise(F.col(name)))


def product(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, name `a*b`, weight product of two feature sets of the same key."""
    a = left.select(*keys, F.col("name").alias("a"), F.col("weight").alias("wa"))
    b = right.select(*keys, F.col("name").alias("b"), F.col("weight").alias("wb"))
    return a.join(b, keys).select(*keys, F.concat("a", F.lit("*"), "b").alias("name"), (F.col("wa") * F.col("wb")).alias("weight"))


def dot(a: Column, b: Column) -> Column:
    """Dense dot product in double precision, in the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column, tiny: float = 1e-10) -> Column:
    """Cosine of two dense vectors; a dot product closer to 0 than `tiny` is returned as it is (M5); lengths must agree."""
    d = dot(a, b)
    same = F.size(a) == F.size(b)
    return F.when(~same, F.raise_error(F.lit("vectors differ in length")).cast("double")).when(F.abs(d) < tiny, d).otherwise(d / (norm(a) * norm(b)))


def normalize(v: Column, tiny: float = 1e-10) -> Column:
    """Divide by the L2 norm if that is above `tiny` (M6)."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > tiny, x.cast("double") / n).otherwise(x.cast("double")))


def sums(df: DataFrame, group: list[str], vector: str, average: bool = False) -> DataFrame:
    """group, vec: elementwise sum or mean by position (M7, A30); partial sums per (group, position) leave each task, never vectors."""
    agg = F.avg if average else F.sum
    flat = df.select(*group, F.posexplode(vector).alias("i", "x"))
    per = flat.groupBy(*group, "i").agg(agg(F.col("x").cast("double")).alias("x"))
    return per.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vec"))


#: Scores that a task holds at once.
SCORES = 4_000_000


def nearest(queries: DataFrame, base: DataFrame, vector: str, query_id: str, base_id: str, k: int) -> DataFrame:
    """query, neighbour, sim, rank: the k most similar vectors of each query, exact (M5).

    The stated queries are broadcast in blocks of a checked size against all vectors, which stay where they are; scores are
    one matrix product a batch, and each batch keeps only its k best of each query before anything is shuffled.
    """
    import numpy as np
    import pyarrow as pa

    from spanloom.operators.topk import top_per_group

    parts = None
    n = queries.count()
    blocks = max(1, -(-n // 5_000))
    for b in range(blocks):
        held = queries.filter(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b).select(query_id, vector).collect()
        if not held:
            continue
        ids = [r[0] for r in held]
        q = np.array([r[1] for r in held], dtype=np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

        def run(batches, ids=ids, q=q):
            for batch in batches:
                lists = batch.column(1)
                if not batch.num_rows:
                    continue
                v = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                base_ids = batch.column(0).to_numpy(zero_copy_only=False)
                m, some = min(k + 1, len(v)), max(1, SCORES // len(v))
                for lo in range(0, len(q), some):
                    s = q[lo : lo + some] @ v.T
                    # the rank is by the score rounded to 6 decimals, so all that may round like the last one kept are kept too
                    cut_at = -np.partition(-s, m - 1, axis=1)[:, m - 1 : m]
                    rows, cols = np.nonzero(s >= cut_at - 2e-6)
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(ids[lo : lo + some])[rows]), pa.array(base_ids[cols]), pa.array(s[rows, cols])], names=["query", "neighbour", "sim"])

        part = base.filter(F.col(vector).isNotNull()).select(F.col(base_id).cast("bigint"), vector).mapInArrow(run, "query bigint, neighbour bigint, sim double")
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return base.sparkSession.createDataFrame([], "query bigint, neighbour bigint, sim double, rank int")
    others = parts.filter("query <> neighbour").withColumn("sim", F.round("sim", 6))
    return top_per_group(others, ["query"], [F.col("sim").desc(), F.col("neighbour")], k)
