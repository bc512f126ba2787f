"""Streams: running counts, top lists, averages and samples with bounded state; snapshots by trigger."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_folder(spark, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_counts(stream: DataFrame, key: str) -> DataFrame:
    """key, n so far; state is one number a key."""
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """window, key, n with a watermark: rows later than `late` don't count and old windows leave the state."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.withWatermark(ts, late).groupBy(w.alias("window"), key).agg(F.count(F.lit(1)).alias("n"))


def sessions(stream: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("session"), key).agg(F.count(F.lit(1)).alias("n"))


def exponential_averages(stream: DataFrame, key: str, value: str, order: str, decay: float) -> DataFrame:
    """key, n, ema after each batch; the state of a key is two numbers (X2, A13). Rows of a batch are folded in `order`."""
    kind = dict(stream.dtypes)[key]

    def fold(k, batches: Iterator[pd.DataFrame], state: GroupState):
        n, ema = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(batches)).sort_values(order)[value].dropna()
        for x in rows:
            ema = float(x) if n == 0 else decay * ema + (1 - decay) * float(x)
            n += 1
        state.update((n, ema))
        yield pd.DataFrame({key: [k[0]], "n": [n], "ema": [ema]})

    return stream.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, n bigint, ema double", "n bigint, ema double", "update", GroupStateTimeout.NoTimeout)


def top_of_counts(rows: DataFrame, key: str, k: int) -> DataFrame:
    """item, n: the k most frequent keys, exact, from the rows that running_counts gave in update mode; equals by item."""
    # counts only grow, so the largest of a key is its last
    last = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("item")).agg(F.max("n").alias("n"))
    return last.orderBy(F.col("n").desc(), "item").limit(k)


def top_counts(stream: DataFrame, key: str, k: int, shards: int = 8) -> DataFrame:
    """shard, item, n, error, seen: about the k most frequent keys so far of each shard, with bounded state (space-saving; X2, X5, A23, A24).

    A shard holds 10 k keys; beyond them a new key takes over the smallest count, which is its `error`: the true count lies
    between n - error and n. `seen` counts the rows of the shard so far; see last_lists. For exact lists take top_of_counts.
    """
    sharded = stream.select(F.col(key).cast("string").alias("item"), F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard"))

    def fold(s, batches: Iterator[pd.DataFrame], state: GroupState):
        items, counts, errors, seen = state.get if state.exists else ([], [], [], 0)
        held, error = dict(zip(items, counts)), dict(zip(items, errors))
        for b in batches:
            seen += len(b)
            for item, n in b["item"].value_counts().sort_index().items():
                if item in held or len(held) < 10 * k:
                    held[item] = held.get(item, 0) + int(n)
                    error.setdefault(item, 0)
                else:
                    low = min(held, key=lambda i: (held[i], i))
                    error.pop(low)
                    error[item] = held.pop(low)
                    held[item] = error[item] + int(n)
        best = heapq.nsmallest(k, held.items(), key=lambda x: (-x[1], x[0]))
        state.update((list(held), list(held.values()), [error[i] for i in held], seen))
        yield pd.DataFrame({"shard": [s[0]] * len(best), "item": [i for i, _ in best], "n": [n for _, n in best], "error": [error[i] for i, _ in best], "seen": [seen] * len(best)})

    return sharded.groupBy("shard").applyInPandasWithState(
        fold, "shard int, item string, n bigint, error bigint, seen bigint", "items array<string>, counts array<bigint>, errors array<bigint>, seen bigint", "update", GroupStateTimeout.NoTimeout
    )


def last_lists(rows: DataFrame) -> DataFrame:
    """Of the rows that top_counts gave over many batches, each shard's last list."""
    return rows.join(rows.groupBy("shard").agg(F.max("seen").alias("seen")), ["shard", "seen"], "left_semi")


def snapshots(result: DataFrame, path: str, checkpoint: str, seconds: int = 600, mode: str = "complete") -> StreamingQuery:
    """Write the whole result every so many seconds as its own folder batch=<n>."""

    def save(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return result.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").foreachBatch(save).start()


def drain(result: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there and give the last batch's rows (complete) or all of them (append, update), for finite inputs."""
    spark = result.sparkSession
    rows: list[str] = []

    def save(df: DataFrame, batch: int) -> None:
        to = f"{checkpoint}-out/batch={batch}"
        df.write.mode("overwrite").parquet(to)
        rows.append(to)

    q = result.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).queryName(name).foreachBatch(save).start()
    q.awaitTermination()
    if not rows:
        return spark.createDataFrame([], result.schema)
    return spark.read.schema(result.schema).parquet(*(rows[-1:] if mode == "complete" else rows))
