"""Encoding of a whole corpus with a public byte-level BPE, and decoding."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.session import cut

#: Fixed value: the pattern that splits text before the merges, with Unicode white space as the vocabulary's library has it.
PRE_TOKEN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A chunk of texts ends with the text that brings it to so many words; a longer text is a chunk of its own.
CHUNK_WORDS = 250_000


def tokenizer_path(name: str) -> str:
    """Where the file of a public tokenizer is, from the installed package of vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a rank file: base64 token and id on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """item, piece: the id and the bytes of every token of the rank file; as large as the vocabulary."""
    return spark.createDataFrame([(i, bytearray(t)) for t, i in load_ranks(path).items()], "item int, piece binary")


def _encode_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        # a word is one piece for this pattern
        encoder = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=load_ranks(path), special_tokens={})
        for b in batches:
            ids = [encoder.encode_ordinary(w) for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(ids, pa.list_(pa.int32())), b.column("n")], names=["word", "ids", "n"])

    return run


def _encoded(counted: DataFrame, path: str) -> DataFrame:
    return counted.mapInArrow(_encode_words(path), "word string, ids array<int>, n bigint")


def word_table(texts: DataFrame, path: str) -> DataFrame:
    """word, ids, n: every distinct pre-token of the column `text`, encoded once, with its number of occurrences."""
    tokens = texts.select(F.explode(F.regexp_extract_all("text", F.lit(PRE_TOKEN), F.lit(0))).alias("word"))
    return _encoded(tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n")), path)


def _chunked(size: int):
    """Rows (key, items) in chunks: each row's items as numbers into the chunk's own list of distinct items, which its last row carries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[pa.Array, pa.ListArray]] = []
        words = 0

        def close() -> pa.RecordBatch:
            nonlocal n
            keys, lists = pa.concat_arrays([k for k, _ in held]), pa.concat_arrays([x for _, x in held])
            null = lists.is_null()
            lists = lists.fill_null(pa.scalar([], lists.type)) if lists.null_count else lists
            coded = lists.flatten().dictionary_encode(null_encoding="encode")
            offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int32)
            codes = pa.ListArray.from_arrays(pa.array(offsets), coded.indices.cast(pa.int32()))
            ends = np.zeros(len(keys) + 1, np.int32)
            ends[-1] = len(coded.dictionary)
            items = pa.ListArray.from_arrays(pa.array(ends), coded.dictionary)
            chunk = pa.array(np.full(len(keys), base + n))
            n += 1
            return pa.RecordBatch.from_arrays([keys, chunk, codes, null, items], names=["key", "chunk", "codes", "none", "items"])

        for b in batches:
            lists = b.column("items")
            upto = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            start = 0
            while start < b.num_rows:
                before = upto[start - 1] if start else 0
                stop = min(b.num_rows, int(np.searchsorted(upto, before + size - words)) + 1)
                held.append((b.column("key").slice(start, stop - start), lists.slice(start, stop - start)))
                words += int(upto[stop - 1] - before)
                if words >= size:
                    yield close()
                    held, words = [], 0
                start = stop
        if held:
            yield close()

    return run


def _looked_up(rows: DataFrame, item: str, table: Callable[[DataFrame], DataFrame], finish: Callable, out: str, size: int) -> DataFrame:
    """rows (key, items) with every item replaced by its piece from a table (item, piece): key and what `finish` makes of the pieces.

    Texts are cut into chunks, and each distinct item of a chunk is exploded once, with its position in the chunk's list:
    these (chunk, position, item) rows go through the shuffle by item, meet the table, and go back by chunk, where they are
    put in order of position and the texts are put together from them. So every item takes the same way, an item that stands
    everywhere is one row for each chunk rather than one for each occurrence, and no group is larger than a chunk.
    """
    kind = dict(rows.dtypes)["key"]
    chunks = cut(rows.mapInArrow(_chunked(size), f"key {kind}, chunk bigint, codes array<int>, none boolean, items array<{item}>"), "chunks")
    wanted = chunks.filter(F.size("items") > 0).select("chunk", F.posexplode("items").alias("at", "item"))
    found = wanted.join(table(wanted), "item").select(F.col("chunk").alias("of"), "at", "piece")

    def together(texts: pa.Table, pieces: pa.Table) -> pa.Table:
        codes = texts.column("codes").combine_chunks()
        order = pc.sort_indices(pieces.column("at"))
        known = pieces.column("piece").combine_chunks().take(order)
        there = np.full(_last(codes) + 1, -1, np.int64)
        there[pieces.column("at").combine_chunks().take(order).to_numpy()] = np.arange(len(order))
        flat = there[codes.flatten().to_numpy()]
        return pa.Table.from_arrays([texts.column("key"), finish(known, flat, codes, texts.column("none").combine_chunks())], names=["key", "out"])

    both = chunks.select("key", "chunk", "codes", "none").groupBy("chunk").cogroup(found.groupBy("of"))
    return both.applyInArrow(together, f"key {kind}, out {out}")


def _last(codes: pa.ListArray) -> int:
    flat = codes.flatten()
    return int(pc.max(flat).as_py()) if len(flat) else -1


def _ids(known: pa.ListArray, flat: np.ndarray, codes: pa.ListArray, none: pa.Array) -> pa.ListArray:
    """The ids of all words of each text, one after the other; no step is per word in Python."""
    sizes = pc.list_value_length(known).to_numpy(zero_copy_only=False).astype(np.int64) if len(known) else np.zeros(0, np.int64)
    pool = known.flatten().to_numpy(zero_copy_only=False) if len(known) else np.zeros(0, np.int32)
    starts = np.cumsum(sizes) - sizes
    n = sizes[flat]
    upto = np.concatenate([[0], np.cumsum(n)])
    ids = pool[np.repeat(starts[flat] - upto[:-1], n) + np.arange(upto[-1])]
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(codes).to_numpy(zero_copy_only=False))])
    return pa.ListArray.from_arrays(pa.array(upto[bounds].astype(np.int32)), pa.array(ids.astype(np.int32)))


def _texts(known: pa.Array, flat: np.ndarray, codes: pa.ListArray, none: pa.Array) -> pa.Array:
    """The bytes of all tokens of each text, read as UTF-8; null for a null list and for a list with an unknown id."""
    tokens = known.to_pylist()
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(codes).to_numpy(zero_copy_only=False))])
    out = []
    for a, b, null in zip(bounds[:-1], bounds[1:], none.to_pylist()):
        here = flat[a:b]
        parts = None if null or (here < 0).any() else [tokens[i] for i in here.tolist()]
        out.append(None if parts is None or None in parts else b"".join(parts).decode("utf-8", "replace"))
    return pa.array(out, pa.string())


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """key, ids: every text by the vocabulary of the rank file at `path`, without special tokens; one row for each row.

    Texts are split into pre-tokens in the JVM. The distinct words of all chunks of texts are exploded with their positions
    and shuffled by word; every distinct word of the corpus is encoded once; the ids are joined back and put together by
    position (_looked_up). Every word, however frequent, takes this way.

    Null and empty texts give the empty list. Repeated rows come out as often as they occur, whatever their key, null keys
    included. Extra columns are left out; an empty table gives no rows.
    """
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PRE_TOKEN), F.lit(0))

    def table(wanted: DataFrame) -> DataFrame:
        counted = wanted.groupBy(F.col("item").alias("word")).agg(F.count(F.lit(1)).alias("n"))
        return _encoded(counted, path).select(F.col("word").alias("item"), F.col("ids").alias("piece"))

    out = _looked_up(docs.select(F.col(key).alias("key"), words.alias("items")), "string", table, _ids, "array<int>", chunk_words)
    return out.select(F.col("key").alias(key), F.col("out").alias("ids"))


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids", chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """key, text: the distinct ids of all chunks joined with the token-byte table, put together by position and read as UTF-8.

    The token table is as large as the vocabulary, which bounds its broadcast. A list with an id that the vocabulary lacks
    and a null list give null; the empty list gives the empty text.
    """
    table = F.broadcast(token_table(encoded.sparkSession, path))
    rows = encoded.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("items"))
    out = _looked_up(rows, "int", lambda wanted: table, _texts, "string", chunk_words)
    return out.select(F.col("key").alias(key), F.col("out").alias("text"))
