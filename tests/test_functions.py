import hashlib
import random
import struct
import uuid

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.functions import hashes, numbers, spans, strings, tags


def one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).head()["y"]


def test_word_shapes(spark):
    want = {"McDonald": "XxXx+", "USA": "X3", "abc123456": "x30+", "FOOb": "X3x", "ab": "x2", "": "", "Ä9É": "Ä0É", "12345": "0+", "1234": "0000"}
    df = spark.createDataFrame(list(want.items()), "w string, s string")
    assert all(r.got == r.s for r in df.select("s", strings.word_shape(F.col("w")).alias("got")).collect())
    assert one(spark, None, "string", strings.word_shape) is None


@pytest.mark.parametrize("path,want", [
    ("appos(SOURCE,graduate)-prep(graduate,from)-pobj(from,TARGET)", "appos(SOURCE,#1)-prep(#1,#2)-pobj(#2,TARGET)"), ("foo(SOURCE,0000-0000)", "foo(SOURCE,#1)"),
    ("appos*(president,SOURCE)-conj*(minister,president)-nn(minister,TARGET)", "appos*(#1,SOURCE)-conj*(#2,#1)-nn(#2,TARGET)"), (None, None), ("", ""),
])
def test_delexicalize(path, want):
    assert strings.delexicalize([path]) == [want]


def test_delexicalized_column(spark):
    assert one(spark, "foo(SOURCE,x)", "string", strings.delexicalized) == "foo(SOURCE,#1)"


def test_truncation(spark):
    assert one(spark, "abcdefghij", "string", lambda c: strings.truncate(c, 4)) == "abcd..."
    assert one(spark, "abcdefghij", "string", lambda c: strings.trim_to(c, 4)) == "abcd"
    assert one(spark, "abcdefghij", "string", lambda c: strings.trim_pretty(c, 6)) == "abc..."
    assert one(spark, "aa bb cc dd", "string", lambda c: strings.trim_pretty_words(c, 7)) == "aa bb ... 2 words"
    assert one(spark, "abc", "string", lambda c: strings.trim_pretty_words(c, 7)) == "abc"


def test_ascii_order(spark):
    rnd = random.Random(1)
    words = ["".join(chr(rnd.randint(33, 126)) for _ in range(rnd.randint(1, 6))) for _ in range(200)]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", strings.ascii_to_real(F.col("w")).alias("r")).collect()
    assert all(0 <= r.r < 1 for r in got)
    assert [r.w for r in sorted(got, key=lambda r: r.r)] == sorted(words) or all(a.r <= b.r for a, b in zip(sorted(got, key=lambda r: r.w), sorted(got, key=lambda r: r.w)[1:]))


def test_uuid_round_trip(spark):
    u = [str(uuid.UUID(int=random.Random(i).getrandbits(128))) for i in range(50)]
    df = spark.createDataFrame([(x,) for x in u], "u string").withColumn("h", strings.uuid_halves(F.col("u")))
    assert all(r.u == r.back for r in df.select("u", strings.uuid_text(F.col("h.high"), F.col("h.low")).alias("back")).collect())


def test_small_strings(spark):
    assert one(spark, "Hello", "string", lambda c: strings.starts_with_ignore_case(c, F.lit("hE"))) is True
    assert one(spark, ["a", None], "array<string>", lambda c: strings.join_items(c, "-")) == "a-null"
    assert one(spark, "a:1,b:2", "string", strings.parse_mapping) == {"a": "1", "b": "2"}
    assert spark.range(1).select(strings.edge_text(F.lit("nn"), F.lit("a"), F.lit("b"))).head()[0] == "nn(a,b)"


def java_int(x):
    x &= 0xFFFFFFFF
    return x - (1 << 32) if x >> 31 else x


def test_hashes():
    assert hashes.one_at_a_time(None) == 0 and hashes.one_at_a_time("") == 0
    h = java_int(97)
    h = java_int(h + (h << 10))
    h ^= h >> 6
    h = java_int(h + (h << 3))
    h ^= h >> 11
    assert hashes.one_at_a_time("a") == java_int(h + (h << 15))
    # published values of the standard function
    assert hashes.murmur3_32(b"", 0) == 0 and hashes.murmur3_32(b"", 1) & 0xFFFFFFFF == 0x514E28B7
    assert hashes.murmur3_32(b"Hello, world!", 0x9747B28C) & 0xFFFFFFFF == 0x24884CBA and hashes.murmur3_32(b"aaa", 0x9747B28C) & 0xFFFFFFFF == 0x283E0130
    first = hashlib.sha256(b"x").digest()[:8]
    if all(b < 128 for b in first[1:]):
        assert hashes.sha_fold("x") == struct.unpack(">q", first)[0]
    assert hashes.mix64(np.array([0]), np.array([0]))[0] == 0


def test_hash_columns(spark):
    df = spark.createDataFrame([("abc", 5), (None, 7), ("", -1)], "s string, n bigint")
    got = df.select(hashes.jenkins(F.col("s")).alias("j"), hashes.murmur3(F.col("s")).alias("m"), hashes.sha256_long(F.col("s")).alias("h"), hashes.mixed(F.col("n"), F.lit(3)).alias("x")).collect()
    assert got[0].j == hashes.one_at_a_time("abc") and got[1].j == 0 and got[1].m is None and got[1].h is None
    assert got[0].m == hashes.murmur3_32(b"abc") and got[2].h == hashes.sha_fold("") and got[2].x == hashes.mix64(np.array([-1]), np.array([3]))[0]
    d = spark.createDataFrame([(bytearray([0b10110101, 0b00000011]),)], "b binary")
    assert [d.select(hashes.bit_field(F.col("b"), i, 3)).head()[0] for i in range(3)] == [0b101, 0b110, 0b110]


def test_edges(spark):
    assert spark.range(1).select(numbers.pack_edge(F.lit(5), F.lit(3), F.lit(7))).head()[0] == 6047364284423
    rnd = random.Random(9001)
    rows = [(rnd.randrange(1 << 24), rnd.randrange(1 << 15), rnd.randrange(1 << 24), rnd.random() < 0.5) for _ in range(300)]
    df = spark.createDataFrame(rows, "p bigint, l bigint, c bigint, o boolean")
    u = df.withColumn("u", numbers.unpack_edge(numbers.pack_edge(F.col("p"), F.col("l"), F.col("c"), F.col("o"))))
    assert all((r.u.node, r.u.label, r.u.conode, r.u.outgoing) == (r.p, r.l, r.c, r.o) for r in u.collect())


def test_span_algebra(spark):
    n = 7
    rows = [(a, b, c, d) for a in range(n) for b in range(a + 1, n + 1) for c in range(n) for d in range(c + 1, n + 1)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    x, y = spans.span(F.col("a"), F.col("b")), spans.span(F.col("c"), F.col("d"))
    got = df.select("*", *[getattr(spans, f)(x, y).alias(f) for f in ("before", "after", "covers", "overlaps", "crosses", "distance")]).collect()
    for r in got:
        p, q = set(range(r.a, r.b)), set(range(r.c, r.d))
        assert r.overlaps == bool(p & q) and r.covers == (q <= p)
        assert r.before == (max(p) < min(q)) and r.after == (min(p) > max(q))
        assert r.crosses == (bool(p & q) and not p <= q and not q <= p)
        assert r.distance == (-1 if p & q else min(abs(i - j) for i in p for j in q) - 1)


def test_span_codes(spark):
    assert spark.range(1).select(spans.dense_index(F.lit(2), F.lit(4)), spans.dense_index_or_null_span(F.lit(0), F.lit(0)), spans.dense_index_or_null_span(F.lit(2), F.lit(4))).head()[:] == (8, 0, 9)
    s = spark.range(1).select(F.explode(spans.all_spans(F.lit(9))).alias("s")).select("s", spans.dense_index(F.col("s.start"), F.col("s.end")).alias("i"), spans.decode(spans.encode(F.col("s.start"), F.col("s.end"), 9), 9).alias("d"))
    rows = s.collect()
    assert sorted(r.i for r in rows) == list(range(45)) and all((r.s.start, r.s.end) == (r.d.start, r.d.end) for r in rows)
    assert one(spark, "3-7", "string", spans.parse_short_text)[:] == (3, 7) and one(spark, "3,7", "string", spans.parse_short_text)[:] == (3, 7) and one(spark, "3:7", "string", spans.parse_short_text) is None
    assert one(spark, [4, 5, 6], "array<int>", spans.span_of)[:] == (4, 7) and one(spark, [4, 6], "array<int>", spans.span_of) is None


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=30))
def test_hash_of_any_text(s):
    assert -(1 << 31) <= hashes.one_at_a_time(s) < 1 << 31 and -(1 << 63) <= hashes.sha_fold(s.encode("utf-8", "ignore").decode()) < 1 << 63


def test_tags(spark):
    df = spark.createDataFrame([(t,) for t in ("VB", "VBD", "NNP", "PRP$", "JJ", "IN", None)], "t string")
    got = {r.t: r for r in df.select("t", tags.is_verb(F.col("t")).alias("v"), tags.is_noun(F.col("t")).alias("n"), tags.is_pronoun(F.col("t")).alias("p"), tags.lexical_category(F.col("t")).alias("c"), tags.frame_tag(F.col("t")).alias("f")).collect()}
    assert not got["VB"].v and got["VBD"].v and got["NNP"].n and got["PRP$"].p and got["JJ"].c == "ADJECTIVE" and got["IN"].f == "PREP" and got["VB"].f == "V" and got[None].c is None


def test_idf_and_f(spark):
    r = spark.range(1).select(numbers.inverse_document_frequency(F.lit(1000), F.lit(300)), numbers.inverse_document_frequency(F.lit(1000), F.lit(300), smooth=True), numbers.inverse_document_frequency(F.lit(1000), F.lit(None).cast("int")), numbers.f_measure(F.lit(0.5), F.lit(1.0), 2.0)).head()
    assert [round(x, 4) for x in r] == [1.0986, 1.2040, 6.9078, 0.8333]
    with pytest.raises(ValueError):
        numbers.f_measure(F.lit(1.0), F.lit(1.0), 0)
