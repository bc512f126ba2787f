"""Lines that break a delimited format: parted from the valid rows, each with its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ten columns of the format.
CONLLU_COLUMNS = ("id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc")

_N1, _N0 = "[1-9][0-9]*", "(?:0|[1-9][0-9]*)"
_WORD, _RANGE, _EMPTY = f"^{_N1}$", f"^{_N1}-{_N1}$", rf"^{_N0}\.{_N1}$"
_NAME = r"\p{Lu}[\p{L}\p{N}]*(?:\[[\p{L}\p{N}]+\])?"
_PAIR = f"{_NAME}=[A-Z0-9][A-Za-z0-9]*(?:,[A-Z0-9][A-Za-z0-9]*)*"
_FEATS = rf"^{_PAIR}(?:\|{_PAIR})*$"

#: The rules, each (column index or -1 for the whole line, reason, rank). The lowest rank is the reason given.
RULES = ((-1, "columns", 1), (5, "quoting", 2), (0, "id", 3), (6, "head", 4), (5, "feats", 5))


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "col int, reason string, rank int")


def _greater(a: Column, b: Column) -> Column:
    """a > b for digits without leading zeros, of any length."""
    return (F.length(a) > F.length(b)) | ((F.length(a) == F.length(b)) & (a > b))


def _fails(reason: Column, value: Column, row_id: Column, n_cells: Column) -> Column:
    """Whether the cell breaks the rule; all patterns are constants."""
    quotes = F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))
    around = (quotes == 2) & (F.length(value) >= 2) & value.startswith('"') & value.endswith('"')
    bare = F.when(around, F.regexp_replace(value, '^"|"$', "")).otherwise(value)
    names = F.transform(F.split(bare, r"\|"), lambda x: F.substring_index(x, "=", 1))
    bad_feats = (bare != "_") & (~bare.rlike(_FEATS) | (F.size(F.array_distinct(names)) != F.size(names)))
    lo, hi = F.substring_index(value, "-", 1), F.substring_index(value, "-", -1)
    good_id = value.rlike(_WORD) | value.rlike(_EMPTY) | (value.rlike(_RANGE) & _greater(hi, lo))
    bad_head = F.when(row_id.rlike(_WORD), ~value.rlike(f"^{_N0}$") | (value == row_id)).otherwise(value != "_")
    return (
        F.when(reason == "columns", n_cells != len(CONLLU_COLUMNS))
        .when(reason == "quoting", (quotes > 0) & ~around)
        .when(reason == "id", ~good_id)
        .when(reason == "head", bad_head)
        .when(reason == "feats", bad_feats)
        .otherwise(False)
    )


def _parsed(lines: DataFrame, key: str, line: str) -> DataFrame:
    text = F.regexp_replace(F.regexp_replace(F.col(line), "^﻿", ""), "\r$", "")
    cells = F.split(F.col("__text"), "\t", -1)
    kept = lines.withColumn("__text", text).filter(F.col("__text").isNotNull() & ~F.col("__text").startswith("#") & ~F.col("__text").rlike(r"^\s*$"))
    return kept.withColumn("__cells", cells)


def faulty_lines(lines: DataFrame, key: str = "line_id", line: str = "line") -> DataFrame:
    """key, reason: each faulty line once, with the first reason that applies.

    Each line is exploded into (row, column, value), the rule table (five fixed rows, broadcast) is joined on the column,
    the validations are evaluated, and the failures of a row meet in a minimum of their rank; only failures are shuffled.
    A final carriage return and a leading byte-order mark aren't part of a line; comments, blank lines and null lines are
    no cases. A repeated key is one row: lines sent twice under one key give the first reason that any of them has. A line
    with a null key that fails comes out under the null key.
    """
    spark = lines.sparkSession
    rules = F.broadcast(rule_table(spark).withColumnRenamed("col", "__col"))
    cells = _parsed(lines, key, line).select(F.col(key).alias("__key"), F.get("__cells", F.lit(0)).alias("__id"), F.size("__cells").alias("__n"), F.posexplode(F.concat(F.array("__text"), F.col("__cells"))).alias("__pos", "__value"))
    cells = cells.withColumn("__col", F.col("__pos") - 1).filter(F.col("__col").isin(*sorted({r[0] for r in RULES})))
    failed = cells.join(rules, "__col").filter(_fails(F.col("reason"), F.col("__value"), F.col("__id"), F.col("__n")))
    first = failed.groupBy("__key").agg(F.min(F.struct("rank", "reason")).alias("f"))
    return first.select(F.col("__key").alias(key), F.col("f.reason").alias("reason"))


def valid_rows(lines: DataFrame, faulty: DataFrame, key: str = "line_id", line: str = "line", extra: tuple[str, ...] = ()) -> DataFrame:
    """The clean lines as rows of ten columns (FEATS without its quotes), by anti-join with the faulty keys."""
    bad = faulty.select(F.col(key).alias("__bad"))
    good = _parsed(lines, key, line).join(bad, F.col(key).eqNullSafe(F.col("__bad")), "left_anti")
    cols = [F.get("__cells", F.lit(i)).alias(c) for i, c in enumerate(CONLLU_COLUMNS)]
    out = good.select(F.col(key), *[F.col(x) for x in extra], *cols)
    return out.withColumn("feats", F.regexp_replace("feats", '^"(.*)"$', "$1"))
