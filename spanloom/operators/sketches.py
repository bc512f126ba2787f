"""Count-min sketches and heavy hitters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The largest count of a cell of 8, 16 or 32 bits.
CELL_MAX = {8: 127, 16: 32_767, 32: 2_147_483_647}


def rows_of(key_hash: np.ndarray, depth: int, log_width: int) -> np.ndarray:
    """The cell of each key in each row of the sketch: fields of a 64-bit hash, remixed per row."""
    h = key_hash.astype(np.int64).view(np.uint64)
    out = np.empty((depth, len(h)), np.int64)
    with np.errstate(over="ignore"):
        for d in range(depth):
            x = h ^ (np.uint64(0x9E3779B97F4A7C15) * np.uint64(d + 1))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out[d] = ((x ^ (x >> np.uint64(31))) >> np.uint64(64 - log_width)).astype(np.int64)
    return out


def build(df: DataFrame, key: str, depth: int = 4, log_width: int = 12, conservative: bool = False, bits: int = 32, shards: int = 8) -> DataFrame:
    """shard, shards, depth, log_width, n, cells (binary): one sketch per shard of the keys.

    A plain sketch is built by each task over its own rows and the tasks' cells are added, so no key is shuffled; it has one
    shard. A conservative one, where only the smallest cells are raised, can't be merged: keys are counted exactly within the
    shuffle's partial sums and each key lives in one shard, which is asked where all of a key's counts went. Cells stop at the
    largest count of their width.
    """
    if not conservative:
        return _merged(df.filter(F.col(key).isNotNull()).select(F.xxhash64(key).alias("h")), depth, log_width, CELL_MAX[bits])
    counted = df.filter(F.col(key).isNotNull()).groupBy(F.xxhash64(key).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    sharded = counted.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    most, width = CELL_MAX[bits], 1 << log_width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, int]] = {}
        for b in batches:
            shard, h, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "h", "n"))
            for s in np.unique(shard).tolist():
                cells, total = held.get(s, (np.zeros((depth, width), np.int64), 0))
                at = shard == s
                ix, add = rows_of(h[at], depth, log_width), n[at]
                for j, a in enumerate(add.tolist()):
                    c = ix[:, j]
                    now = cells[np.arange(depth), c]
                    cells[np.arange(depth), c] = np.maximum(now, now.min() + a)
                held[s] = cells, total + int(add.sum())
        rows = [(s, shards, depth, log_width, t, np.minimum(c, most).astype("<i4").tobytes()) for s, (c, t) in held.items()]
        names = ["shard", "shards", "depth", "log_width", "n", "cells"]
        types = [pa.int32()] * 4 + [pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    order = sharded.repartition(shards, "shard").sortWithinPartitions("h")
    return order.select("shard", "h", "n").mapInArrow(run, "shard int, shards int, depth int, log_width int, n bigint, cells binary")


def _merged(hashes: DataFrame, depth: int, log_width: int, most: int) -> DataFrame:
    width = 1 << log_width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((depth, width), np.int64)
        for b in batches:
            ix = rows_of(b.column("h").to_numpy(zero_copy_only=False), depth, log_width)
            for d in range(depth):
                cells[d] += np.bincount(ix[d], minlength=width)
        used = np.flatnonzero(cells.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(cells.ravel()[used])], names=["at", "n"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = np.zeros(depth * width, np.int64)
            for part in b.column("cells").to_pylist():
                for c in part or []:
                    cells[c["at"]] = c["n"]
            row = [pa.array([0], pa.int32()), pa.array([1], pa.int32()), pa.array([depth], pa.int32()), pa.array([log_width], pa.int32()), pa.array([int(cells[:width].sum())]), pa.array([np.minimum(cells, most).astype("<i4").tobytes()])]
            yield pa.RecordBatch.from_arrays(row, names=["shard", "shards", "depth", "log_width", "n", "cells"])

    added = hashes.mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n"))
    # depth x width cells, whatever the input
    return added.agg(F.collect_list(F.struct("at", "n")).alias("cells")).mapInArrow(pack, "shard int, shards int, depth int, log_width int, n bigint, cells binary")


def estimate(keys: DataFrame, key: str, sketches: DataFrame) -> DataFrame:
    """keys with `estimate`, never below the exact count while no cell is full. The sketches' size is fixed by their parameters."""
    held, shards = {}, 1
    for r in sketches.toLocalIterator():
        held[r["shard"]], shards = (r["depth"], r["log_width"], bytes(r["cells"])), r["shards"]

    @F.pandas_udf("bigint")
    def ask(h: pd.Series) -> pd.Series:
        h = h.to_numpy()
        out = np.zeros(len(h), np.int64)
        for s, (depth, log_width, raw) in held.items():
            at = np.mod(h, shards) == s
            if at.any():
                cells = np.frombuffer(raw, "<i4").reshape(depth, -1)
                ix = rows_of(h[at], depth, log_width)
                out[at] = np.min([cells[d][ix[d]] for d in range(depth)], axis=0)
        return pd.Series(out)

    return keys.withColumn("estimate", ask(F.xxhash64(key)))


def capacity(sketches: DataFrame) -> DataFrame:
    """shard, largest, and least, largest, mean of the column minima over the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for s, d, raw in zip(b.column("shard").to_pylist(), b.column("depth").to_pylist(), b.column("cells").to_pylist()):
                cells = np.frombuffer(raw, "<i4").reshape(d, -1)
                low = cells.min(axis=0)
                out.append((s, int(cells.max()), int(low.min()), int(low.max()), float(low.mean())))
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["shard", "largest", "min_of_minima", "max_of_minima", "mean_of_minima"])

    return sketches.mapInArrow(run, "shard int, largest bigint, min_of_minima bigint, max_of_minima bigint, mean_of_minima double")


def heavy_hitters(df: DataFrame, key: str | Column, k: int, tracked: int = 10_000) -> DataFrame:
    """item, n: the approximately k most frequent keys in one mergeable pass (A23, A24); exact while there are at most `tracked` keys."""
    c = F.col(key) if isinstance(key, str) else key
    top = df.select(c.alias("__key")).agg(F.expr(f"approx_top_k(__key, {k}, {tracked})").alias("t"))
    return top.select(F.explode("t").alias("t")).select(F.col("t.item").alias("item"), F.col("t.count").alias("n"))
