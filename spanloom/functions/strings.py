"""String columns: shapes, prefixes, truncation, delexicalised paths. Null in, null out, unless said otherwise."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Class letters of a word shape, and how a run of each is written, longest run first.
SHAPE_CLASSES = (("[A-Z]", "X"), ("[a-z]", "x"), ("[0-9]", "0"))
SHAPE_RUNS = (("X{4,}", "X+"), ("XXX", "X3"), ("XX", "X2"), ("x{4,}", "x+"), ("xxx", "x3"), ("xx", "x2"), ("0{5,}", "0+"))


def word_shape(word: Column) -> Column:
    """ASCII letters and digits by class, runs collapsed (C1): McDonald -> XxXx+, abc123456 -> x30+."""
    for pattern, letter in (*SHAPE_CLASSES, *SHAPE_RUNS):
        word = F.regexp_replace(word, pattern, letter)
    return word


def starts_with_ignore_case(text: Column, prefix: Column) -> Column:
    """Case-insensitive prefix test."""
    return F.lower(text).startswith(F.lower(prefix))


def truncate(text: Column, limit: int) -> Column:
    """Cut at limit and say so with dots after it."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def trim_to(text: Column, limit: int) -> Column:
    """Cut at limit."""
    return F.substring(text, 1, limit)


def trim_pretty(text: Column, limit: int) -> Column:
    """Cut so that the dots fit inside the limit."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, max(limit - 3, 0)), F.lit("..."))).otherwise(text)


def trim_pretty_words(text: Column, limit: int) -> Column:
    """Cut at the last blank before the limit and say how many words went."""
    head = F.substring(text, 1, limit)
    kept = F.when(F.instr(head, " ") > 0, F.regexp_replace(head, r" [^ ]*$", "")).otherwise(head)
    gone = F.size(F.split(F.trim(text), r"\s+")) - F.size(F.split(F.trim(kept), r"\s+"))
    return F.when(F.length(text) > limit, F.concat(kept, F.lit(" ... "), gone.cast("string"), F.lit(" words"))).otherwise(text)


def join_items(items: Column, separator: str) -> Column:
    """Array to text, null items as `null` (C4)."""
    return F.array_join(items, separator, "null")


def ascii_to_real(text: Column) -> Column:
    """Order-preserving map of ASCII text into [0, 1): base-127 digits from the left."""
    digits = F.transform(F.reverse(F.filter(F.split(text, ""), lambda ch: ch != "")), lambda ch: F.ascii(ch))
    return F.aggregate(digits, F.lit(0.0), lambda acc, ch: ch / 127.0 + F.lit(0.999999999999) * (acc / 127.0))


def reverse_text(text: Column) -> Column:
    """Reverse by code point."""
    return F.reverse(text)


_NODE = re.compile(r"\(([^(),]*),([^(),]*)\)")
_KEPT = re.compile(r"^[A-Z]{2,}$")


def delexicalize(paths: Iterable[str | None]) -> list[str | None]:
    """Lexical nodes of dependency paths as numbered variables, first seen first; words of two or more capitals stay."""
    out: list[str | None] = []
    for path in paths:
        if path is None:
            out.append(None)
            continue
        known: dict[str, str] = {}

        def name(word: str, known=known) -> str:
            return word if _KEPT.match(word) else known.setdefault(word, f"#{len(known) + 1}")

        def edge(m: re.Match) -> str:
            # an edge that runs upwards has its new node on the left
            return f"({name(m[1])},{name(m[2])})"

        out.append(_NODE.sub(edge, path))
    return out


def delexicalized(path: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(delexicalize(None if x is None or x != x else x for x in s))

    return run(path)


def zero_digits(text: Column) -> Column:
    """Digits as 0."""
    return F.regexp_replace(text, "[0-9]", "0")


def edge_text(label: Column, head: Column, mod: Column) -> Column:
    """label(head,mod) (C11)."""
    return F.concat(label, F.lit("("), head, F.lit(","), mod, F.lit(")"))


def parse_mapping(text: Column) -> Column:
    """`k:v,k:v` as a map (R2); a key given twice is an error under the session's map-key policy."""
    return F.str_to_map(text, F.lit(","), F.lit(":"))


def uuid_halves(uuid: Column) -> Column:
    """A UUID's text as two signed 64-bit halves."""
    bare = F.replace(uuid, F.lit("-"), F.lit(""))
    half = lambda start: F.conv(F.substring(bare, start, 16), 16, -10).cast("bigint")
    return F.struct(half(1).alias("high"), half(17).alias("low"))


def uuid_text(high: Column, low: Column) -> Column:
    """The inverse of uuid_halves."""
    hexed = F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))
    return F.regexp_replace(hexed, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def show_weights(names: Column, weights: Column, max_chars: int) -> Column:
    """The sum and as many named weights, largest first, as fit into max_chars, then how many more there are."""

    @F.pandas_udf("string")
    def run(ns: pd.Series, ws: pd.Series) -> pd.Series:
        out = []
        for n, w in zip(ns, ws):
            items = sorted(zip(w, n), key=lambda x: (-abs(x[0]), x[1]))
            text = f"{sum(w):.2f}"
            shown = 0
            for value, name in items:
                more = f" {name}:{value:.2f}"
                if len(text) + len(more) > max_chars:
                    break
                text, shown = text + more, shown + 1
            out.append(text + (f" and {len(items) - shown} more" if shown < len(items) else ""))
        return pd.Series(out)

    return run(names, weights)
