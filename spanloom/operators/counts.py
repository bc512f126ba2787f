"""Counting, multimaps and dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.running import LIST_VALUES, in_parts, running
from spanloom.session import with_scalar


def counts(df: DataFrame, *keys: str) -> DataFrame:
    """keys, n: occurrences as bigint (A1); partial sums leave each task, so hot keys send one row per task."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def proportions(counted: DataFrame, n: str = "n") -> DataFrame:
    """counted with `share` of the total, 0 if the total is 0 (A2, A5). The total is one broadcast row, not a global window."""
    total = counted.agg(F.sum(n).alias("__total"))
    share = F.when(F.col("__total") > 0, F.col(n) / F.col("__total")).otherwise(0.0)
    return with_scalar(counted, total).withColumn("share", share).drop("__total")


def total_and_distinct(counted: DataFrame, n: str = "n") -> DataFrame:
    """n_keys with a count, total."""
    return counted.agg(F.sum(F.when(F.col(n) != 0, 1).otherwise(0)).alias("n_keys"), F.sum(n).alias("total"))


def at_least(counted: DataFrame, k: int, n: str = "n") -> DataFrame:
    """Keys counted at least k times (F12); k must be above 0."""
    if k <= 0:
        raise ValueError("the bound must be above 0")
    return counted.filter(F.col(n) >= k)


def less_than(counted: DataFrame, k: int, n: str = "n") -> DataFrame:
    if k <= 0:
        raise ValueError("the bound must be above 0")
    return counted.filter(F.col(n) < k)


def h_index(counted: DataFrame, group: list[str], n: str = "n") -> DataFrame:
    """group, h: the largest h such that h keys have a count of at least h (A4).

    Keys are first counted per (group, count), so what is ranked is the distinct counts of a group, few even in a huge group.
    """
    per = counted.groupBy(*group, n).agg(F.count(F.lit(1)).alias("__keys"))
    w = Window.partitionBy(*group).orderBy(F.col(n).desc())
    # with the keys of higher counts above it, a run of equal counts reaches min(n, keys so far)
    reach = F.least(F.col(n), F.sum("__keys").over(w))
    return per.withColumn("__h", reach).groupBy(*group).agg(F.max("__h").alias("h"))


def weighted_sums(df: DataFrame, key: str, weight: str) -> DataFrame:
    """key, total: real-valued counts."""
    return df.groupBy(key).agg(F.sum(weight).alias("total"))


def collect_values(df: DataFrame, key: str, value: str, order: list[str] | None = None, most: int = LIST_VALUES) -> DataFrame:
    """key, part, vals, n: all values of a key in a stated order (A25); a key with more than `most` values has several rows, in order of part."""
    item = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order or [value])], F.col(value).alias("v"))
    df = in_parts(df.select(*dict.fromkeys([key, *(order or []), value])), [key], list(dict.fromkeys([*(order or []), value])), most)
    return df.groupBy(key, "part").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]).alias("vals"), F.count(value).alias("n"))


def collect_unique(df: DataFrame, key: str, value: str, most: int = LIST_VALUES) -> DataFrame:
    """key, part, vals: the distinct values in order (A26); they are brought together per (key, value) first, so repeated rows never travel; parts as in collect_values."""
    one = in_parts(df.select(key, value).distinct(), [key], [value], most)
    return one.groupBy(key, "part").agg(F.array_sort(F.collect_list(value)).alias("vals"))


def project(entries: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The entries of a set of keys, repeats kept."""
    return entries.join(keys.select(key).distinct(), key, "left_semi")


def ordered_distinct(df: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with the position of the first."""
    return df.groupBy(value).agg(F.min(order).alias("first_at"))


def dictionary(df: DataFrame, value: str, order: str) -> DataFrame:
    """value, id: dense ids from 0 in order of first appearance, ties by value.

    Ids are ranks within ranges plus the sizes of the ranges before: the sort is spread over the cluster, no task sees all.
    """
    first = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias("__first"))
    return dense_ids(first, ["__first", value], "id").drop("__first")


def dense_ids(df: DataFrame, order: list[str], to: str) -> DataFrame:
    """df with ids 0, 1, ... in the given total order (a leading minus turns a column), by a range sort and per-range offsets."""
    out = running(df, [], order, {"__id": F.lit(1)})
    return out.withColumn(to, F.col("__id") - 1).drop("__id", "__id_total")


def encode(df: DataFrame, value: str, ids: DataFrame) -> DataFrame:
    """df with the id of a value, -1 if the dictionary lacks it."""
    return df.join(ids.select(F.col(value), F.col("id")), value, "left").withColumn("id", F.coalesce("id", F.lit(-1)))


def encode_columns(lines: DataFrame, line: str, order: str, columns: list[int]) -> tuple[DataFrame, dict[int, DataFrame]]:
    """Tab-separated lines with the values of chosen columns as ids, and the dictionary of each column (K8).

    Ids are dense from 0 in order of first appearance by `order`. A line that lacks a chosen column keeps an empty cell
    there. Other columns of the table stay.
    """
    cells = lines.withColumn("__cells", F.split(line, "\t", -1))
    ids = {}
    for c in columns:
        cells = cells.withColumn(f"__v{c}", F.get("__cells", F.lit(c)))
        ids[c] = dictionary(cells.select(F.col(f"__v{c}").alias("value"), order), "value", order)
    for c in columns:
        known = ids[c].select(F.col("value").alias(f"__v{c}"), F.col("id").cast("string").alias(f"__i{c}"))
        cells = cells.join(known, f"__v{c}", "left")

    def cell(x, i):
        for c in columns:
            x = F.when(i == c, F.coalesce(f"__i{c}", F.lit(""))).otherwise(x)
        return x

    put = F.transform("__cells", cell)
    return cells.withColumn(line, F.array_join(put, "\t")).select(*lines.columns), ids


def decode(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    return df.join(ids, id_col, "left")


def prefixes(df: DataFrame, text: str) -> DataFrame:
    """prefix, n: how many texts run through each prefix by code point; the empty prefix counts them all."""
    p = F.transform(F.sequence(F.lit(0), F.length(text)), lambda i: F.substring(F.col(text), F.lit(1), i))
    return df.filter(F.col(text).isNotNull()).select(F.explode(p).alias("prefix")).groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))


def path_prefixes(df: DataFrame, path: str) -> DataFrame:
    """path, n: how many paths (arrays) run through each prefix."""
    p = F.transform(F.sequence(F.lit(0), F.size(path)), lambda i: F.slice(F.col(path), F.lit(1), i))
    return df.filter(F.col(path).isNotNull()).select(F.explode(p).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def longest_frequent_prefix(words: DataFrame, word: str, counted: DataFrame, least: int) -> DataFrame:
    """word, prefix, n: the longest prefix of each distinct word that counts at least `least`."""
    w = words.select(word).distinct()
    each = w.select(word, F.explode(F.transform(F.sequence(F.lit(0), F.length(word)), lambda i: F.substring(F.col(word), F.lit(1), i))).alias("prefix"))
    hit = each.join(counted.filter(F.col("n") >= least), "prefix")
    best = hit.groupBy(word).agg(F.max_by(F.struct("prefix", "n"), F.length("prefix")).alias("b"))
    return best.select(word, "b.prefix", "b.n")


def completions(words: DataFrame, word: str, prefixes_: list[str]) -> DataFrame:
    """prefix, word, n: the words that complete each of a few given prefixes, with their counts."""
    per = counts(words, word)
    lengths = sorted({len(p) for p in prefixes_})
    heads = F.explode(F.array(*[F.substring(F.col(word), 1, k) for k in lengths])).alias("prefix")
    return per.select(word, "n", heads).filter(F.col("prefix").isin(*prefixes_)).distinct().select("prefix", word, "n")


def assign_feature_ids(counted: DataFrame, path: str, n: str = "n", least: int = 5, most: int | None = None) -> DataFrame:
    """path, id: dense unique ids of the paths seen at least `least` times, best first by n - sqrt(children); with `most`, only that many (V9)."""
    kept = counted.filter(F.col(n) >= least)
    parent = kept.filter(F.size(path) > 0).groupBy(F.slice(F.col(path), F.lit(1), F.size(path) - 1).alias(path)).agg(F.count(F.lit(1)).alias("__children"))
    ranked = kept.join(parent, path, "left").withColumn("priority", F.col(n) - F.sqrt(F.coalesce("__children", F.lit(0)))).drop("__children")
    out = dense_ids(ranked, ["-priority", path], "id")
    return out if most is None else out.filter(F.col("id") < most)


def prefix_changes(words: DataFrame, word: str, counted: DataFrame) -> DataFrame:
    """word, prefix, n, ratio: the counts along each distinct word's prefixes and how much of the count before each keeps."""
    w = words.select(word).distinct()
    each = w.select(word, F.explode(F.transform(F.sequence(F.lit(0), F.length(word)), lambda i: F.substring(F.col(word), F.lit(1), i))).alias("prefix"))
    along = Window.partitionBy(word).orderBy(F.length("prefix"))
    return each.join(counted, "prefix").select(word, "prefix", "n", (F.col("n") / F.lag("n").over(along)).alias("ratio"))


def path_ids(paths: DataFrame, keys: list[str], path: str, ids: DataFrame) -> DataFrame:
    """keys, id: the features along each path that have an id (V8). ids: path, id."""
    p = F.transform(F.sequence(F.lit(0), F.size(path)), lambda i: F.slice(F.col(path), F.lit(1), i))
    return paths.select(*keys, F.explode(p).alias("path")).join(ids, "path").select(*keys, "id")
