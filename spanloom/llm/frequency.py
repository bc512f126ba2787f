"""Frequency of every distinct term: heavy terms in local counter arrays, the rest by shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.session import cut

#: Terms counted in local arrays, at most; each task holds two numbers for each.
HEAVY_TERMS = 1_000


@dataclass
class Frequencies:
    """counts: term, occurrences, records (in how many records it occurs). n_records: records with any counted term; total: all occurrences."""

    counts: DataFrame
    n_records: int
    total: int


def term_frequencies(occurrences: DataFrame, record: str, term: str, weight: str | None = None, heavy_terms: int = HEAVY_TERMS) -> Frequencies:
    """Exact occurrences and record counts of every distinct term.

    Occurrences first meet per (record, term), map-side before the shuffle, so neither a hot record nor a hot term gathers
    rows. Over these pairs one pass finds the number of records, the total and the terms with most pairs (a mergeable
    frequent-items sketch over all rows; it only decides where a term is counted, never its count). The heavy terms are
    broadcast; each task adds their counts in local arrays and passes the other terms on, and only those rows, plus one row
    per heavy term and task, are shuffled; the final sum unites both tables.

    Rows whose term is null don't count; a null weight counts 0, and terms are told apart exactly as spelled (the empty
    string is a term). A null record is one record. Repeated rows count as often as they occur; an empty table gives no
    rows, n_records 0 and total 0.
    """
    w = F.coalesce(F.col(weight).cast("bigint"), F.lit(0)) if weight else F.lit(1).cast("bigint")
    rows = occurrences.select(F.col(record).alias("record"), F.col(term).cast("string").alias("term"), w.alias("w")).filter("term is not null")
    pairs = cut(rows.groupBy("record", "term").agg(F.sum("w").alias("n")), "pairs")
    seen = pairs.agg(F.count_distinct(F.struct("record")).alias("r"), F.sum("n").alias("t"), F.expr(f"approx_top_k(term, {heavy_terms}, {max(10 * heavy_terms, 10_000)})").alias("top")).head()
    heavy = [x["item"] for x in seen["top"] or [] if x["item"] is not None and x["count"] > 1]

    def count_heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(heavy, pa.string())
        occurrences_of, records_of = np.zeros(len(heavy), np.int64), np.zeros(len(heavy), np.int64)
        for b in batches:
            at = pc.index_in(b.column("term"), value_set=names) if heavy else pa.nulls(b.num_rows, pa.int32())
            is_light = pc.is_null(at)
            ix = at.drop_null().to_numpy(zero_copy_only=False)
            n = b.column("n").filter(pc.invert(is_light)).to_numpy(zero_copy_only=False)
            np.add.at(occurrences_of, ix, n)
            records_of += np.bincount(ix, minlength=len(heavy)).astype(np.int64) if len(heavy) else 0
            light = b.filter(is_light)
            yield pa.RecordBatch.from_arrays([light.column("term"), light.column("n"), pa.array(np.ones(light.num_rows, np.int64))], names=["term", "occurrences", "records"])
        got = np.flatnonzero(records_of)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(got)), pa.array(occurrences_of[got]), pa.array(records_of[got])], names=["term", "occurrences", "records"])

    both = pairs.select("term", "n").mapInArrow(count_heavy, "term string, occurrences bigint, records bigint")
    counts = both.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return Frequencies(counts, int(seen["r"] or 0), int(seen["t"] or 0))


def mark(f: Frequencies, rare_below: int, common: Column) -> DataFrame:
    """f.counts with `mark`: rare, else common where the condition holds, else null."""
    return f.counts.withColumn("mark", F.when(F.col("occurrences") < rare_below, F.lit("rare")).when(common, F.lit("common")))
