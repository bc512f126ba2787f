"""Annotation layers built from their parts: sections, situations, mentions, parses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spans_of_parts(parts: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
    """keys, first, last, n_parts: the span from the first to the last token of a group's parts."""
    return parts.groupBy(*keys).agg(F.min(first).alias(first), F.max(last).alias(last), F.count(F.lit(1)).alias("n_parts"))


def situations(predicates: DataFrame, arguments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, part, role, first, last: a situation's predicate (part 0) and its arguments (from 1, by position) as child rows."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("first", "last", "role")
    args = arguments.select(*keys, F.row_number().over(w).alias("part"), "role", "first", "last")
    return predicates.select(*keys, F.lit(0).alias("part"), F.lit("predicate").alias("role"), "first", "last").unionByName(args)


def contiguous_mentions(tokens: DataFrame, keys: list[str], token: str) -> DataFrame:
    """keys, first, last: mentions given as token rows; those with a gap are left out (E15). A mention's tokens are counted, not gathered."""
    g = tokens.groupBy(*keys).agg(F.min(token).alias("first"), F.max(token).alias("last"), F.count_distinct(token).alias("n"))
    return g.filter(F.col("last") - F.col("first") + 1 == F.col("n")).drop("n")


def entity_sets(mentions: DataFrame, entity: str, mention: str) -> DataFrame:
    """entity, mentions: clusters written back as sets (K10); a mention in two entities is an error."""
    from spanloom.operators.checks import repeated_keys

    twice = repeated_keys(mentions.select(entity, mention).distinct(), [mention]).limit(1).collect()
    if twice:
        raise ValueError(f"mention {twice[0][mention]!r} is in several entities")
    return mentions.groupBy(entity).agg(F.array_sort(F.collect_set(mention)).alias("mentions"))


def without_word_leaves(nodes: DataFrame, key: str, node: str = "node", parent: str = "parent", word: str = "word") -> DataFrame:
    """Parse nodes without the leaves that only repeat their parent's word."""
    inner = nodes.filter(F.col(parent).isNotNull()).select(key, F.col(parent).alias(node)).distinct()
    leaf = nodes.join(inner, [key, node], "left_anti").filter(F.col(word).isNotNull() & F.col(parent).isNotNull())
    return nodes.join(leaf.select(key, node), [key, node], "left_anti")


def document_tokens(tokens: DataFrame, sentences: DataFrame, keys: list[str], sentence: str, token: str) -> DataFrame:
    """tokens with doc_tok: sentence-relative positions made document-relative (J11, W2). sentences: keys, sentence, length."""
    from spanloom.operators.features import running_offsets

    offsets = running_offsets(sentences, keys, sentence, "length").select(*keys, sentence, "first_tok")
    return tokens.join(offsets, [*keys, sentence]).withColumn("doc_tok", F.col("first_tok") + F.col(token)).drop("first_tok")


def slices(tokens: DataFrame, spans: DataFrame, keys: list[str], token: str, word: str, first: str, last: str, span_id: str) -> DataFrame:
    """keys, span_id, text: the words of stated spans in order."""
    from spanloom.operators.joins import range_join

    hit = range_join(tokens.select(*keys, token, word), spans.select(*keys, span_id, first, last), keys, token, first, last)
    words = F.transform(F.array_sort(F.collect_list(F.struct(token, word))), lambda x: x[word])
    return hit.groupBy(*keys, span_id).agg(F.array_join(words, " ").alias("text"))
