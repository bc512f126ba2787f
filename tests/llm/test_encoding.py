import random

import pytest

from spanloom.llm import encoding as en

pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

TEXTS = [
    "Hello, world! It's we'll they've  two  spaces\n\n\nlines\t\ttabs ", " lead", "trail   ", "<|endoftext|> plain", "naïve café — „quotes“ 例文語彙 👩‍💻 ​ x y　z", "123 4567 ١٢٣ ²³ Ⅷ",
    "''s 'S 'll''ve", "é ä ﬁ", "\r\n\r\n x\r\ny", "\x85 \x1c \x00 \x7f", "a" * 20_000, " ".join(f"w{i}" for i in range(5_000)), " ", "\n", "  ", "ＦＵＬＬ ｗｉｄｔｈ", "🙂" * 50,
]


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(en.tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, words string, k int")
    return en.encode(df, en.tokenizer_path("byte_bpe_50k.tiktoken"), **kw)


@pytest.mark.parametrize("chunk", [1, 50, 250_000])
def test_equals_the_library(spark, reference, chunk):
    rows = list(enumerate(TEXTS))
    got = {r.doc_id: list(r.ids) for r in run(spark, rows, chunk_words=chunk).collect()}
    for i, t in rows:
        assert got[i] == reference(t), repr(t[:60])


def test_random_characters(spark, reference):
    rnd = random.Random(4)
    pool = "aB'sd ll\n\t.,!é́例🙂‍\xa0 ١9²_-"
    rows = [(i, "".join(rnd.choice(pool) for _ in range(60))) for i in range(300)]
    got = {r.doc_id: list(r.ids) for r in run(spark, rows).collect()}
    assert all(got[i] == reference(t) for i, t in rows)


def test_null_empty_repeated(spark):
    rows = [(1, None), (2, ""), (3, "same"), (3, "same"), (4, "same"), (4, "other"), (None, "same"), (None, None)]
    same, other = ([list(r.ids) for r in run(spark, [(0, t)]).collect()][0] for t in ("same", "other"))
    for chunk in (1, 3, 1000):
        got = sorted((r.doc_id if r.doc_id is not None else -1, list(r.ids)) for r in run(spark, rows, chunk_words=chunk).collect())
        assert got == sorted([(-1, []), (-1, same), (1, []), (2, []), (3, same), (3, same), (4, same), (4, other)])
    assert run(spark, []).count() == 0 and run(spark, []).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]


def test_round_trip(spark):
    rows = [*enumerate(TEXTS), (900, "")]
    path = en.tokenizer_path("byte_bpe_50k.tiktoken")
    got = {r.doc_id: r.text for r in en.decode(run(spark, rows), path).collect()}
    assert got == dict(rows)


def test_each_word_is_encoded_once(spark):
    df = spark.createDataFrame([("a b a b a",), ("b a",)], "text string")
    t = {r.word: r.n for r in en.word_table(df, en.tokenizer_path("byte_bpe_50k.tiktoken")).collect()}
    assert t == {"a": 1, " b": 2, " a": 3, "b": 1}


def test_decoding_defines_every_case(spark):
    path = en.tokenizer_path("byte_bpe_50k.tiktoken")
    df = spark.createDataFrame([(1, [15496, 11]), (2, []), (3, None), (4, [15496, 999_999]), (5, [220]), (5, [220]), (None, [15496]), (6, [None, 11])], "doc_id bigint, ids array<int>")
    got = sorted(((r.doc_id or 0, r.text) for r in en.decode(df, path, chunk_words=3).collect()), key=str)
    assert got == sorted([(0, "Hello"), (1, "Hello,"), (2, ""), (3, None), (4, None), (5, " "), (5, " "), (6, None)], key=str)
    assert en.decode(df.limit(0), path).count() == 0
