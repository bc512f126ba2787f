"""Reading the tables, and the current row of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Markers that stand for "no value" in annotated corpora, beside null.
UNSPECIFIED = ("", "_")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; Catalyst pushes the columns and filters of the query into this scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def specified(c: Column | str) -> Column:
    """True where a value is given: neither null, empty nor `_`."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~c.isin(*UNSPECIFIED)


def current_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The latest row of each key, with the columns `keep`.

    Repeated and outdated rows of a key meet in a map-side maximum, so a key that holds a third of all rows sends one
    row per partition. A null in `order` is the earliest; rows that tie in `order` are settled by the kept values
    themselves, so the result doesn't depend on the order of arrival. A null key forms a key of its own.
    """
    top = F.max(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]))
    out = df.groupBy(*keys).agg(top.alias("__top"))
    return out.select(*keys, *[F.col(f"__top.k{i}").alias(c) for i, c in enumerate(keep)])


PLAIN_NUMBER = r"^[0-9]+$"


def current_words(conllu: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The current row of each word_id of the table conllu, only the columns asked for."""
    return current_rows(conllu, ["word_id"], ["loaded_at"], keep)
