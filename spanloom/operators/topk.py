"""Bounded best-of lists. Rank filters run as a limit before the shuffle (WindowGroupLimit)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.running import running


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """df with `rank`, the k best of each group by a total order; k <= 0 keeps all."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked if k <= 0 else ranked.filter(F.col("rank") <= k)


def evicted(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """What a beam of width k drops."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") > k)


def multi_objective(df: DataFrame, objectives: dict[str, Column], item: str, k: int) -> DataFrame:
    """objective, item, score, rank: each item goes to its highest objective (the first of equals; minus infinity or null is out), the k best of each (T5)."""
    low = F.lit(float("-inf"))
    scored = [F.struct(F.coalesce(c.cast("double"), low).alias("s"), F.lit(-i).alias("i"), F.lit(n).alias("objective")) for i, (n, c) in enumerate(objectives.items())]
    best = df.select(F.col(item).alias("item"), F.array_max(F.array(*scored)).alias("b")).filter(F.col("b.s") > low)
    flat = best.select(F.col("b.objective").alias("objective"), "item", F.col("b.s").alias("score"))
    return top_per_group(flat, ["objective"], [F.col("score").desc(), F.col("item")], k)


def prune(df: DataFrame, weight: str, eps: float) -> DataFrame:
    """|weight| above eps."""
    return df.filter(F.abs(weight) > eps)


def prune_by_ratio(df: DataFrame, group: list[str], weight: str, order: list[str], ratio: float) -> DataFrame:
    """The leading rows of each group until their cumulative share reaches ratio (W5); the row that crosses it stays.

    order names columns, a leading minus turns one; the sums run over a range sort, so no group is gathered in a task.
    """
    summed = running(df, group, order, {"__sum": F.col(weight)})
    return summed.filter((F.col("__sum") - F.col(weight)) / F.col("__sum_total") < ratio).select(*df.columns)


def by_magnitude(df: DataFrame, weight: str, tie: str, k: int) -> DataFrame:
    """The k rows with the largest |weight| (T8); a take-ordered, no full sort. k <= 0 keeps all, in order."""
    out = df.orderBy(F.abs(weight).desc(), tie)
    return out if k <= 0 else out.limit(k)
