"""Validity checks that return the rows in violation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def roots_not_one(nodes: DataFrame, tree: str, is_root: str) -> DataFrame:
    """tree, roots: trees without exactly one root."""
    roots = nodes.groupBy(tree).agg(F.sum(F.when(F.col(is_root), 1).otherwise(0)).cast("bigint").alias("roots"))
    return roots.filter("roots <> 1")


def token_bounds(df: DataFrame, keys: list[str], first: str, last: str, n_tokens: str | None = None) -> DataFrame:
    """keys, problem: spans out of bounds (F16). Null bounds aren't checked."""
    problem = F.when(F.col(first) < 0, "first below 0").when(F.col(last) < F.col(first), "last before first")
    if n_tokens:
        problem = problem.when(F.col(last) >= F.col(n_tokens), "last beyond the text")
    return df.select(*keys, problem.alias("problem")).filter("problem is not null")


def out_of_dictionary(df: DataFrame, value: str, ids: DataFrame) -> DataFrame:
    """Distinct values that a dictionary lacks (F16)."""
    return df.select(value).distinct().join(ids.select(value), value, "left_anti")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_rows: what should be unique and isn't."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")
