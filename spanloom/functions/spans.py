"""Half-open spans [start, end) as columns; the null span is (0, 0), not SQL null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def span(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"))


def width(s: Column) -> Column:
    return s["end"] - s["start"]


def shift(s: Column, by: Column | int) -> Column:
    return span(s["start"] + by, s["end"] + by)


def before(a: Column, b: Column) -> Column:
    return a["end"] <= b["start"]


def after(a: Column, b: Column) -> Column:
    return a["start"] >= b["end"]


def covers(a: Column, b: Column) -> Column:
    return (a["start"] <= b["start"]) & (b["end"] <= a["end"])


def includes(a: Column, token: Column) -> Column:
    return (a["start"] <= token) & (token < a["end"])


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def crosses(a: Column, b: Column) -> Column:
    """Overlap without nesting or a shared endpoint (P5)."""
    return ((a["start"] < b["start"]) & (b["start"] < a["end"]) & (a["end"] < b["end"])) | ((b["start"] < a["start"]) & (a["start"] < b["end"]) & (b["end"] < a["end"]))


def distance(a: Column, b: Column) -> Column:
    """Tokens between two spans, -1 if they overlap."""
    return F.when(before(a, b), b["start"] - a["end"]).when(after(a, b), a["start"] - b["end"]).otherwise(F.lit(-1))


def dense_index(start: Column, end: Column) -> Column:
    """end (end - 1) / 2 + start."""
    return F.floor(end * (end - 1) / 2) + start


def dense_index_or_null_span(start: Column, end: Column) -> Column:
    """0 for the null span, the others one higher."""
    return F.when((start == 0) & (end == 0), F.lit(0).cast("bigint")).otherwise(dense_index(start, end) + 1)


def encode(start: Column, end: Column, n: Column | int) -> Column:
    """start + end (n + 1)."""
    return start + end * (F.lit(n) + 1 if isinstance(n, int) else n + 1)


def decode(code: Column, n: int) -> Column:
    return span(F.pmod(code, F.lit(n + 1)), F.floor(code / (n + 1)))


def short_text(start: Column, end: Column) -> Column:
    """`start-end`."""
    return F.concat_ws("-", start, end)


def parse_short_text(text: Column) -> Column:
    """The inverse; `-` or `,` between the numbers; null if it is neither."""
    pattern = "^([0-9]+)[-,]([0-9]+)$"
    part = lambda i: F.regexp_extract(text, pattern, i).cast("int")
    return F.when(text.rlike(pattern), span(part(1), part(2)))


def all_spans(n: Column) -> Column:
    """Every span with 0 <= start < end <= n, as an array."""
    ends = F.sequence(F.lit(1), n)
    return F.when(n >= 1, F.flatten(F.transform(ends, lambda e: F.transform(F.sequence(F.lit(0), e - 1), lambda s: span(s, e))))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def span_of(tokens: Column, strict: bool = True) -> Column:
    """The span of a list of tokens; strict gives null unless they ascend without a gap."""
    from spanloom.functions.numbers import contiguous

    whole = span(F.array_min(tokens), F.array_max(tokens) + 1)
    return F.when(contiguous(tokens), whole) if strict else whole
