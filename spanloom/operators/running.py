"""Running sums in a stated order, spread over the cluster: a range sort, and per range what went before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.session import cut, small


#: The longest list that is gathered into one row.
LIST_VALUES = 100_000


def ordering(names: list[str]) -> list[Column]:
    """Columns to sort by; a leading minus turns one."""
    return [F.col(n[1:]).desc() if n.startswith("-") else F.col(n) for n in names]


def running(df: DataFrame, group: list[str], order: list[str], amounts: dict[str, Column], lead: dict[str, str] | None = None) -> DataFrame:
    """df with, for each amount, `name` (its running sum within the group, this row included) and `name_total`, and for each lead the column's next value in the group.

    Rows are sorted by range of (group, order), so a group of any size is spread over as many tasks as its rows fill; the
    sums of the (group, range) cells, of which there are at most groups + ranges, give each cell what went before it, and
    the rest is a window inside a cell. order names columns, a leading minus turns one; it
    must be total within a group; null groups are a group.
    """
    lead = lead or {}
    held = df.withColumns({f"__a_{n}": a for n, a in amounts.items()})
    keys = ordering(order)
    ranged = cut(held.repartitionByRange(*[F.col(g) for g in group], *keys).withColumn("__part", F.spark_partition_id()), "ranged")
    local = Window.partitionBy(*group, "__part").orderBy(*keys)
    cells = ranged.groupBy(*group, "__part").agg(*[F.sum(f"__a_{n}").alias(f"__s_{n}") for n in amounts])
    if lead:
        firsts = ranged.withColumn("__rn", F.row_number().over(local)).filter("__rn = 1").select(*group, "__part", *[F.col(c).alias(f"__f_{n}") for n, c in lead.items()])
        cells = _join(cells, firsts, [*group, "__part"])
    cells = cut(cells, "cells")
    across, whole = Window.partitionBy(*group).orderBy("__part"), Window.partitionBy(*group)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(
        *group, "__part",
        *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in amounts],
        *[F.sum(f"__s_{n}").over(whole).alias(f"{n}_total") for n in amounts],
        *[F.lead(f"__f_{n}").over(across).alias(f"__n_{n}") for n in lead],
    )
    if small(offsets):
        offsets = F.broadcast(offsets)
    j = _join(ranged, offsets, [*group, "__part"])
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = j.withColumns({n: F.col(f"__b_{n}") + F.coalesce(F.sum(f"__a_{n}").over(upto), F.lit(0)) for n in amounts} | {n: F.coalesce(F.lead(c).over(local), F.col(f"__n_{n}")) for n, c in lead.items()})
    return out.select(*df.columns, *amounts, *[f"{n}_total" for n in amounts], *lead)


def in_parts(df: DataFrame, group: list[str], order: list[str], most: int = LIST_VALUES) -> DataFrame:
    """df with `part`: 0 in groups of at most `most` rows; larger groups are cut into parts of so many rows, in order.

    So whoever gathers (group, part) into a list gathers no more than `most` rows, and a group loses nothing. Sizes come from
    a map-side count; rows are only sorted, by range over the cluster, if there is a larger group.
    """
    large = df.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most)
    if large.isEmpty():
        return df.withColumn("part", F.lit(0).cast("bigint"))
    out = running(df, group, order, {"__n": F.lit(1)})
    return out.withColumn("part", F.floor((F.col("__n") - 1) / most)).drop("__n", "__n_total")


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be null."""
    r = right.select(*[F.col(k).alias(f"__j_{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__j_{i}"))
    return left.join(r, cond).drop(*[f"__j_{i}" for i in range(len(keys))])
