"""Token context templates, feature products and n-grams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, END = "<S>", "</S>"


class Templates:
    """Named templates: functions of a window to a string column; null means the template doesn't fire (V1, V5)."""

    def __init__(self) -> None:
        self._by_name: dict[str, Callable[[Window], Column]] = {}

    def add(self, name: str, make: Callable[[Window], Column]) -> None:
        if "+" in name or "*" in name:
            raise ValueError(f"a template's name may not contain + or *: {name}")
        if name in self._by_name:
            raise ValueError(f"template {name} is there already")
        self._by_name[name] = make

    def __getitem__(self, name: str) -> Callable[[Window], Column]:
        return self._by_name[name]

    def __iter__(self):
        return iter(self._by_name)

    @classmethod
    def context(cls, columns: dict[str, str], reach: int = 3) -> Templates:
        """column[i] for each column and i in -reach..reach, padded at both ends."""
        out = cls()
        for name, c in columns.items():
            for i in range(-reach, reach + 1):
                out.add(f"{name}[{i}]", lambda w, c=c, i=i: F.col(c) if i == 0 else F.lag(c, -i, BEGIN).over(w) if i < 0 else F.lead(c, i, END).over(w))
        return out


def extract(tokens: DataFrame, products: list[str], templates: Templates, group: list[str], order: str) -> DataFrame:
    """group, order, feature: the products that fire at each token, written name=value joined by * (V2, V3, V4).

    All templates share one window, so there is one sort; products are plain columns over it and Catalyst shares their
    common parts. A product is written `a * b`; it fires if all its templates do.
    """
    w = Window.partitionBy(*group).orderBy(order)
    names = list(dict.fromkeys(t.strip() for p in products for t in p.split("*")))
    with_values = tokens.select(*group, order, *[templates[n](w).alias(f"t{i}") for i, n in enumerate(names)])
    at = {n: f"t{i}" for i, n in enumerate(names)}
    fired = []
    for p in products:
        parts = [t.strip() for t in p.split("*")]
        all_there = F.lit(True)
        for t in parts:
            all_there = all_there & F.col(at[t]).isNotNull()
        fired.append(F.when(all_there, F.concat_ws("*", *[F.concat(F.lit(f"{t}="), F.col(at[t])) for t in parts])))
    return with_values.select(*group, order, F.explode(F.array_compact(F.array(*fired))).alias("feature"))


def hashed(features: DataFrame, size: int = 1 << 20) -> DataFrame:
    """features with a stable index below size."""
    return features.withColumn("index", F.pmod(F.xxhash64("feature"), F.lit(size)))


def ngrams(tokens: DataFrame, group: list[str], order: str, word: str, n: int, pad: bool = False) -> DataFrame:
    """group, order, ngram over one window (W3); without padding the last n - 1 positions of a group have none."""
    w = Window.partitionBy(*group).orderBy(order)
    parts = [F.col(word), *[F.lead(word, i, END if pad else None).over(w) for i in range(1, n)]]
    full = F.lit(True)
    for p in parts:
        full = full & p.isNotNull()
    return tokens.select(*group, order, F.when(full, F.concat_ws(" ", *parts)).alias("ngram")).filter("ngram is not null")


def score(features: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label, score: the sum of each label's weights over the features that fire (V6); features without weight add nothing."""
    return features.join(weights, "feature").groupBy(*keys, "label").agg(F.sum("weight").alias("score"))


def occurrences(tokens: DataFrame, needles: list[str], group: list[str], order: str, word: str, ignore_case: bool = False) -> DataFrame:
    """group, order: where a sequence of words begins (P10); one window, no self-join."""
    w = Window.partitionBy(*group).orderBy(order)
    fold = F.lower if ignore_case else (lambda c: c)
    hit = F.lit(True)
    for i, n in enumerate(needles):
        here = F.col(word) if i == 0 else F.lead(word, i).over(w)
        hit = hit & (fold(here) == (n.lower() if ignore_case else n))
    return tokens.select(*group, order, hit.alias("__hit")).filter("__hit").drop("__hit")


def token_numbers(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, tok, word: the tokens between white space, numbered from 0 within their text, without a shuffle."""
    words = F.filter(F.split(F.col(text), r"[ \t\n\r\f\x0B]+"), lambda w: w != "")
    return docs.select(F.col(doc_id), F.posexplode(words).alias("tok", "word"))


def running_offsets(sentences: DataFrame, group: list[str], order: str, length: str) -> DataFrame:
    """sentences with first_tok: the tokens before each in its document."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sentences.withColumn("first_tok", F.coalesce(F.sum(length).over(w), F.lit(0)))
