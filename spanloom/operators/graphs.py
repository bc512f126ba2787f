"""Labelled directed graphs as edge rows: graph, parent, child, label."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.running import LIST_VALUES, in_parts, running
from spanloom.session import cut


def both_directions(edges: DataFrame) -> DataFrame:
    """node, conode, label, outgoing: each edge seen from both ends (G1)."""
    out = edges.select(F.col("parent").alias("node"), F.col("child").alias("conode"), "label", F.lit(True).alias("outgoing"))
    return out.unionByName(edges.select(F.col("child").alias("node"), F.col("parent").alias("conode"), "label", F.lit(False).alias("outgoing")))


def degrees(edges: DataFrame) -> DataFrame:
    """node, n_children, n_parents."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    return both_directions(edges).groupBy("node").agg(n(F.col("outgoing")).alias("n_children"), n(~F.col("outgoing")).alias("n_parents"))


def neighbours(edges: DataFrame, outgoing: bool = True, most: int = LIST_VALUES) -> DataFrame:
    """node, part, list of (label, conode): children ascending, parents descending (G3); a node with more than `most` neighbours has several rows, in order of part."""
    lists = F.sort_array(F.collect_list(F.struct("label", "conode")), asc=outgoing)
    mine = both_directions(edges).filter(F.col("outgoing") == outgoing).drop("outgoing")
    mine = in_parts(mine, ["node"], ["label", "conode"] if outgoing else ["-label", "-conode"], most)
    return mine.groupBy("node", "part").agg(lists.alias("neighbours"))


def roots(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("parent").alias("node")).distinct().join(edges.select(F.col("child").alias("node")), "node", "left_anti")


def leaves(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("child").alias("node")).distinct().join(edges.select(F.col("parent").alias("node")), "node", "left_anti")


def induced(edges: DataFrame, first: int, last: int) -> DataFrame:
    """The subgraph on nodes first..last, nodes counted from 0."""
    inside = F.col("parent").between(first, last) & F.col("child").between(first, last)
    return edges.filter(inside).withColumn("parent", F.col("parent") - first).withColumn("child", F.col("child") - first)


def distances(edges: DataFrame, sources: DataFrame, bidirectional: bool = False, max_hops: int | None = None) -> DataFrame:
    """source, node, hops, via: breadth-first distances from stated sources (G5, G10), one join a level.

    Each level is written, so it is neither recomputed nor lost; nodes reached before leave by anti-join. `via` is the node
    before on a shortest path, the smallest of several. Goes on until no new node is reached; with max_hops, nodes farther
    away are left out. Nodes may be of any type.
    """
    step = edges.select(F.col("parent").alias("a"), F.col("child").alias("b"))
    step = (step.unionByName(edges.select(F.col("child").alias("a"), F.col("parent").alias("b"))) if bidirectional else step).distinct()
    step, kind = cut(step, "step"), dict(step.dtypes)["a"]
    front = sources.select(F.col("source"), F.col("source").alias("node"), F.lit(0).alias("hops"), F.lit(None).cast(kind).alias("via"))
    seen = cut(front, "seen")
    front = seen
    for hop in count(1) if max_hops is None else range(1, max_hops + 1):
        new = front.select("source", F.col("node").alias("a")).join(step, "a").groupBy("source", F.col("b").alias("node")).agg(F.min("a").alias("via"))
        new = new.join(seen.select("source", "node"), ["source", "node"], "left_anti")
        front = cut(new.select("source", "node", F.lit(hop).alias("hops"), "via"), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if hop % 16 == 0:  # so the plan doesn't grow with the distance
            seen = cut(seen, "seen")
    return seen


def walks(edges: DataFrame, k: int, starts: DataFrame) -> DataFrame:
    """start, end, path (labels joined by _), hops: all walks of at most k edges from the starts that don't go straight back."""
    level = starts.select(F.col("node").alias("start"), F.col("node").alias("end"), F.lit(None).cast("bigint").alias("prev"), F.lit("").alias("path"), F.lit(0).alias("hops"))
    out = None
    step = edges.select(F.col("parent").alias("end"), F.col("child").alias("next"), F.col("label").cast("string").alias("label"))
    for hop in range(1, k + 1):
        level = (
            level.join(step, "end").filter(F.col("prev").isNull() | (F.col("next") != F.col("prev")))
            .select("start", F.col("next").alias("end"), F.col("end").cast("bigint").alias("prev"), F.when(F.col("path") == "", F.col("label")).otherwise(F.concat_ws("_", "path", "label")).alias("path"), F.lit(hop).alias("hops"))
        )
        out = level if out is None else out.unionByName(level)
    return out.select("start", "end", "path", "hops")


def runs(df: DataFrame, group: list[str], order: str, flag: str) -> DataFrame:
    """group, first, last: maximal runs of consecutive positions where the flag holds (G9's compounds, gaps and islands); a group of any size is spread by range."""
    hit = running(df.filter(F.col(flag)).select(*group, order), group, [order], {"__n": F.lit(1)})
    return hit.withColumn("__i", F.col(order) - F.col("__n")).groupBy(*group, "__i").agg(F.min(order).alias("first"), F.max(order).alias("last")).drop("__i")


def suppress_repeats(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the row before (W7); the order must be total in a group, which is spread by range whatever its size."""
    back = running(df, group, [f"-{o}" for o in order], {"__n": F.lit(1)}, {"__prev": value})
    return back.filter(F.col("__prev").isNull() | (F.col("__prev") != F.col(value))).select(*df.columns)
