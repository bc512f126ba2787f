import random
import unicodedata

import pytest

from spanloom.llm import skeleton as sk

SAME = [
    ("The café", "The café"), ("The file", "Тhе ﬁlе"), ("abc 12", "ａｂｃ　１２"), ("a-b", "a‑b"), ("soft", "so­ft"), ("x y", "x y"), ("x y", "x y"), ("zero", "ze​ro﻿"), ("naïve", "naı̈ve".replace("ı", "i")),
    ("good", "ɡood"), ("ό", "ó"), ("office", "oﬃce"), ("a", "a️"), ("Å", "Å"), ("Κ", "K"),
]
DIFFER = [("café", "cafe"), ("The", "the"), ("2", "²"), ("a.b", "a,b"), ("a  b", "a b"), ("a–b", "a-b"), ("word", "words"), ("l1", "ll"), ("a,b", "a，b"), ("x\ny", "x y"), ("ß", "ss"), ("½", "1/2")]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert sk.skeleton(a) == sk.skeleton(b)


@pytest.mark.parametrize("a,b", DIFFER)
def test_different(a, b):
    assert sk.skeleton(a) != sk.skeleton(b)


def test_idempotent_and_table_is_small():
    rnd = random.Random(0)
    for _ in range(300):
        t = "".join(chr(rnd.choice([rnd.randrange(32, 0x250), rnd.randrange(0x370, 0x530), rnd.randrange(0x2000, 0x2070), rnd.randrange(0xFB00, 0xFB07), rnd.randrange(0xFF01, 0xFF5F)])) for _ in range(20))
        s = sk.skeleton(t)
        assert sk.skeleton(s) == s and unicodedata.normalize("NFD", s) == s
    assert len(sk.LOOK_ALIKES) < 200


def pairs(spark, rows):
    df = spark.createDataFrame([(*r, "clash", None) for r in rows], "doc_id bigint, text string, look string, exact string")
    return sorted(tuple(r) for r in sk.look_alike_pairs(sk.skeleton_keys(df)).collect())


def test_pairs(spark):
    rows = [(1, "file"), (2, "ﬁle"), (3, "file"), (4, "fіle"), (5, "other"), (5, "other"), (6, None), (7, ""), (8, " "), (9, " "), (10, "​"), (None, "ﬁle"), (11, "FILE"), (3, "file")]
    assert pairs(spark, rows) == [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4)]
    assert pairs(spark, []) == [] and pairs(spark, [(1, "x")]) == []


def test_many_copies_and_one_variant(spark):
    rows = [(i, "same text") for i in range(2000)] + [(5000, "ѕame text"), (5001, "x" * 500_000), (5002, "х" + "x" * 499_999)]
    assert pairs(spark, rows) == [(i, 5000) for i in range(2000)] + [(5001, 5002)]


def test_groups_and_column(spark):
    df = spark.createDataFrame([(1, "file"), (2, "ﬁle"), (3, "file"), (4, "z"), (5, None)], "doc_id bigint, text string")
    assert sorted((r.n_texts, r.n_docs, r.first_doc) for r in sk.look_alike_groups(df).collect()) == [(1, 1, 4), (2, 3, 1)]
    assert [r.skeleton for r in sk.with_skeleton(df).orderBy("doc_id").collect()] == ["file", "file", "file", "z", None]


UNICODE_LOOKS = [
    ("ρ", "p"), ("α", "a"), ("ι", "i"), ("υ", "u"), ("γ", "y"), ("ѵ", "v"), ("Ѵ", "V"), ("З", "3"), ("Ь", "b"), ("ɑ", "a"), ("ո", "n"), ("ⅰ", "i"), ("Ⅴ", "V"), ("Ⅳ", "IV"), ("𝐀", "A"), ("𝐈", "I"), ("𝟏", "1"),
    ("Ꭺ", "A"), ("ꓐ", "B"), ("ⲣ", "p"), ("г", "r"), ("κ", "к"), ("І", "I"), ("Ӏ", "I"), ("ӏ", "l"), ("о", "o"), ("ё", "ë"), ("ԝ", "w"),
]
UNICODE_APART = [("ı", "i"), ("œ", "oe"), ("æ", "ae"), ("ø", "o"), ("ł", "l"), ("ß", "ss"), ("ю", "lo"), ("в", "b"), ("в", "B"), ("к", "k"), ("м", "m"), ("т", "t"), ("н", "h"), ("ا", "l"), ("0", "O"), ("1", "l"), ("I", "l"), ("rn", "m"), ("²", "2"), ("①", "1"), ("—", "-")]


def test_unicode_security_data(spark):
    table = sk.look_alike_table(spark)
    for a, b in UNICODE_LOOKS + SAME:
        assert sk.skeleton(a, table) == sk.skeleton(b, table), (a, b)
    for a, b in UNICODE_APART + DIFFER:
        assert sk.skeleton(a, table) != sk.skeleton(b, table), (a, b)
    every = "".join(chr(c) for c in range(0x20, 0x20000) if not 0xD800 <= c < 0xE000)
    assert sk.skeleton(sk.skeleton(every, table), table) == sk.skeleton(every, table)
    assert 300 < len(table.confusable) < 5_000


def test_members(spark):
    df = spark.createDataFrame([(1, "file"), (2, "ﬁle"), (3, "file"), (4, "z"), (5, None), (6, " "), (None, "z")], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.n_texts, r.n_docs) for r in sk.look_alike_members(df).collect())
    assert got == [(0, 1, 2), (1, 2, 3), (2, 2, 3), (3, 2, 3), (4, 1, 2)]
