"""Arithmetic of features, edges and scores as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODE_BITS, LABEL_BITS = 24, 16


def inverse_document_frequency(n_docs: Column, df: Column, smooth: bool = False) -> Column:
    """ln(N div df) by integer division, an unseen term having df 1; smooth takes the real quotient (M1)."""
    df = F.coalesce(df, F.lit(1))
    return F.log(n_docs / df) if smooth else F.log(F.floor(n_docs / df))


def safe_ratio(num: Column, den: Column, empty: float = 1.0) -> Column:
    """num / den, `empty` where den is 0."""
    return F.when(den == 0, F.lit(empty)).otherwise(num / den)


def f_measure(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    """(1 + b^2) P R / (b^2 P + R), 0 where P + R is 0 (M9)."""
    if beta <= 0:
        raise ValueError("beta must be above 0")
    b2 = beta * beta
    return F.when(precision + recall == 0, F.lit(0.0)).otherwise((1 + b2) * precision * recall / (b2 * precision + recall))


def pack_edge(parent: Column, label: Column, child: Column, outgoing: Column | bool = True) -> Column:
    """parent, direction and label, child in 24, 16 and 24 bits; the top label bit is the direction."""
    out = F.lit(outgoing) if isinstance(outgoing, bool) else outgoing
    direction = F.when(out, F.lit(1 << (LABEL_BITS - 1)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    middle = label.cast("bigint").bitwiseOR(direction)
    return F.shiftleft(parent.cast("bigint"), LABEL_BITS + NODE_BITS).bitwiseOR(F.shiftleft(middle, NODE_BITS)).bitwiseOR(child.cast("bigint"))


def unpack_edge(edge: Column) -> Column:
    """The inverse of pack_edge: node, label, conode, outgoing."""
    mask = lambda n: (1 << n) - 1
    middle = F.shiftright(edge, NODE_BITS).bitwiseAND(F.lit(mask(LABEL_BITS)).cast("bigint"))
    return F.struct(
        F.shiftrightunsigned(edge, LABEL_BITS + NODE_BITS).alias("node"),
        middle.bitwiseAND(F.lit(mask(LABEL_BITS - 1)).cast("bigint")).alias("label"),
        edge.bitwiseAND(F.lit(mask(NODE_BITS)).cast("bigint")).alias("conode"),
        (F.shiftright(middle, LABEL_BITS - 1) == 1).alias("outgoing"),
    )


def mixed_radix(features: list[tuple[Column, int]]) -> Column:
    """One index of several features: each step is feature + previous * cardinality."""
    total = F.lit(0).cast("bigint")
    for value, cardinality in features:
        total = value.cast("bigint") + total * F.lit(cardinality).cast("bigint")
    return total


def hashed_index(size: int, *cols: Column) -> Column:
    """A stable index below `size`."""
    return F.pmod(F.xxhash64(*cols), F.lit(size))


def latency_bucket(ms: Column, buckets: int = 20) -> Column:
    """The power-of-two histogram bucket: bucket i holds times below 4 * 2^i ms."""
    return F.least(F.greatest(F.floor(F.log2(ms / 4)) + 1, F.lit(0)), F.lit(buckets - 1))


def expansion_priority(observations: Column, children: Column) -> Column:
    """Observations less the root of the number of children."""
    return observations - F.sqrt(children)


def contiguous(items: Column) -> Column:
    """Whether an array of numbers ascends in steps of one."""
    steps = F.when(F.size(items) < 2, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.size(items) - 1))
    return F.forall(steps, lambda i: F.element_at(items, i + 1) == F.element_at(items, i) + 1)
