"""Shards, samples and shuffles; all depend on keys and a seed only, not on partitions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the default seed.
DEFAULT_SEED = 9001


def parse_shard(spec: str = "0/1") -> tuple[int, int]:
    """`k/n` (N2)."""
    k, _, n = spec.partition("/")
    if not 0 <= int(k) < int(n):
        raise ValueError(f"shard {spec}")
    return int(k), int(n)


def shard(df: DataFrame, key: Column, k: int, n: int) -> DataFrame:
    """Rows whose key falls into shard k of n (F3, F4): pushed to the scan, no shuffle; null keys are in none."""
    return df.filter(F.pmod(key, F.lit(n)) == k)


def shard_by_hash(df: DataFrame, keys: list[str], k: int, n: int) -> DataFrame:
    return shard(df, F.xxhash64(*keys), k, n)


def uniform(keys: list[str], seed: int) -> Column:
    """A number in (0, 1) that depends on the keys and the seed only."""
    h = F.shiftrightunsigned(F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)), 11)
    return (h + F.lit(0.5)) / F.lit(float(1 << 53))


def reservoir(df: DataFrame, keys: list[str], k: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """A uniform sample of k rows (U6): the k smallest of a seeded hash, taken per partition first."""
    return df.orderBy(F.xxhash64(*[F.col(c) for c in keys], F.lit(seed)), *keys).limit(k)


def permutation(df: DataFrame, keys: list[str], seed: int = DEFAULT_SEED) -> DataFrame:
    """All rows in a seeded random order (U7), by a range sort."""
    return df.orderBy(F.xxhash64(*[F.col(c) for c in keys], F.lit(seed)), *keys)


def weighted_keys(df: DataFrame, key: str, weight: Column, k: int = 1, seed: int = DEFAULT_SEED) -> DataFrame:
    """k keys drawn without replacement by weight (U8): the smallest -ln(u) / w; a negative weight is an error, weight 0 is never drawn."""
    checked = F.when(weight < 0, F.raise_error(F.lit("negative weight")).cast("double")).otherwise(weight)
    drawn = df.withColumn("__w", checked).filter("__w > 0").withColumn("__t", -F.log(uniform([key], seed)) / F.col("__w"))
    return drawn.orderBy("__t", key).limit(k).drop("__w", "__t")


def random_span(n: Column, keys: list[str], seed: int = DEFAULT_SEED) -> Column:
    """A random span within n tokens (U9): one of the n (n + 1) / 2, by its dense index."""
    ix = F.floor(uniform(keys, seed) * n * (n + 1) / 2)
    end = F.floor((F.sqrt(8 * ix + 1) - 1) / 2) + 1
    return F.struct((ix - F.floor(end * (end - 1) / 2)).alias("start"), end.alias("end"))


def random_projection(feature: Column, dim: int, seed: int = DEFAULT_SEED) -> Column:
    """A Gaussian vector of unit length that depends on the feature and the seed."""

    @F.pandas_udf("array<double>")
    def run(h: pd.Series) -> pd.Series:
        out = []
        for x in h:
            v = np.random.default_rng([seed, int(x) & 0xFFFFFFFF, (int(x) >> 32) & 0xFFFFFFFF]).standard_normal(dim)
            out.append((v / math.sqrt(float(v @ v))).tolist())
        return pd.Series(out)

    return run(F.xxhash64(feature))
