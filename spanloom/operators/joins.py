"""Joins by key set, by position and by range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def intersect_in_order(probe: DataFrame, build: DataFrame, key: str) -> DataFrame:
    """The distinct probe rows whose key the build side has."""
    return probe.dropDuplicates([key]).join(build.select(key), key, "left_semi")


def missing_keys(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The wanted rows whose key is not known: what a cache has to compute."""
    return wanted.join(known.select(key), key, "left_anti")


def once_each(df: DataFrame, same: str, key: str) -> DataFrame:
    """key (the smallest), n: rows whose column `same` is equal, once each (H9); repeats meet in a map-side minimum."""
    return df.groupBy(same).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("n")).drop(same)


def unique_match(df: DataFrame, condition: Column, what: str = "match", allow_none: bool = False) -> DataFrame:
    """The one row that meets the condition; an error if there are none (unless allowed) or several."""
    found = df.filter(condition)
    n = found.limit(2).count()
    if n > 1 or (n == 0 and not allow_none):
        raise ValueError(f"{what}: {'several rows match' if n else 'no row matches'}")
    return found


def lookup_in_order(refs: DataFrame, table: DataFrame, list_col: str, key: str) -> DataFrame:
    """refs with each referenced key's row, in list order; every reference must be found."""
    return refs.select("*", F.posexplode(list_col).alias("ord", key)).join(table, key, "left")


def zip_positions(left: DataFrame, right: DataFrame, ordinal: str) -> DataFrame:
    """Rows of equal ordinal side by side."""
    return left.join(right, ordinal)


def range_join(points: DataFrame, intervals: DataFrame, key: list[str], point: str, first: str, last: str, width: int = 64) -> DataFrame:
    """points with every interval [first, last] of the same key that covers them.

    An equi-join on the key and a bin of `width` positions: each interval is put into the bins it touches and each point
    into its own, so there is no nested loop and a hot key is spread over its bins.
    """
    bins = F.sequence(F.floor(F.col(first) / width), F.floor(F.col(last) / width))
    i = intervals.filter(F.col(first) <= F.col(last)).withColumn("__bin", F.explode(bins))
    p = points.withColumn("__bin", F.floor(F.col(point) / width))
    return p.join(i, [*key, "__bin"]).filter((F.col(point) >= F.col(first)) & (F.col(point) <= F.col(last))).drop("__bin")


def overlap_join(left: DataFrame, right: DataFrame, key: list[str], width: int = 64) -> DataFrame:
    """Pairs of half-open spans (start_l, end_l), (start_r, end_r) of the same key that overlap.

    Spans meet in the bins they touch; a pair is kept only in the bin where the later start lies, so it comes out once.
    """
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width)))
    a = left.filter("start_l < end_l").withColumn("__bin", bins("start_l", "end_l"))
    b = right.filter("start_r < end_r").withColumn("__bin", bins("start_r", "end_r"))
    j = a.join(b, [*key, "__bin"]).filter((F.col("start_l") < F.col("end_r")) & (F.col("start_r") < F.col("end_l")))
    return j.filter(F.col("__bin") == F.floor(F.greatest("start_l", "start_r") / width)).drop("__bin")


def symmetric_difference(a: Column, b: Column, relative: bool = False) -> Column:
    """How many items are in exactly one of two sets (J14, U3), perhaps as a share of both lengths."""
    d = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    return d / F.when(F.size(a) + F.size(b) > 0, F.size(a) + F.size(b)) if relative else d


def last_mention(tokens: DataFrame, mentions: DataFrame, key: list[str], token: str, start: str, end: str, order: str) -> DataFrame:
    """tokens with `mention`: the last mention [start, end) that covers each, -1 if none."""
    spans = mentions.select(*key, F.col(start).alias("__s"), (F.col(end) - 1).alias("__e"), F.col(order).alias("__o"))
    hit = range_join(tokens.select(*key, token), spans, key, token, "__s", "__e").groupBy(*key, token).agg(F.max("__o").alias("mention"))
    return tokens.join(hit, [*key, token], "left").withColumn("mention", F.coalesce("mention", F.lit(-1)))


def smallest_spans(constituents: DataFrame, key: list[str], first: str, last: str, depth: str, node: str) -> DataFrame:
    """key, first, last, node: the shallowest constituent of each span."""
    return constituents.groupBy(*key, first, last).agg(F.min_by(node, F.struct(depth, node)).alias(node))
