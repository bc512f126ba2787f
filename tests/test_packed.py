import pytest

from spanloom.operators import packed

CASES = [
    ("A=b|C=d", ["A=b", "C=d"]),
    ("Mood=Ind|Number=Plur;Person=1,3,Tense=Pres|VerbForm=Ger", ["Mood=Ind", "Number=Plur", "Person=1,3", "Tense=Pres", "VerbForm=Ger"]),
    ('"Case=Gen; Definite=Ind; Gender=Fem,Masc"', ["Case=Gen", "Definite=Ind", "Gender=Fem,Masc"]),
    ('"Degree=Sup","PronType=Int"', ["Degree=Sup", "PronType=Int"]),
    ('Gloss="a=b;C=d";Degree=Sup', ["Gloss=a=b;C=d", "Degree=Sup"]),
    ("Poss=Yes|\"Gloss=up, down\"", ["Poss=Yes", "Gloss=up, down"]),
    ("Gloss='salt;sand'/Foreign=Yes", ["Gloss=salt;sand", "Foreign=Yes"]),
    ('"Gloss=""Sing, Number=two""; Person=2"', ["Gloss=Sing, Number=two", "Person=2"]),
    (" Case=Nom ;Number[psor]=Plur ", ["Case=Nom", "Number[psor]=Plur"]),
    ("Gender=Neut||Case=Acc|", ["Gender=Neut", "Case=Acc"]),
    ("Case=Nom Number=Sing", ["Case=Nom", "Number=Sing"]),
    ("Case=Nom¦Number=Sing", ["Case=Nom", "Number=Sing"]),
    ("Gloss=dry land|Case=Nom", ["Gloss=dry land", "Case=Nom"]),
    ("nothing here", []),
    ("_", []), ("", []), (None, []), ("   ", []), ('""', []),
]

DEPS = [
    ("4:nsubj; 18:ref", ["4:nsubj", "18:ref"]),
    ('2:conj:and|8.1:obj|"1:conj:plus|minus"', ["2:conj:and", "8.1:obj", "1:conj:plus|minus"]),
    ('"8:advmod|4:""nmod:such_as;like""|1.2:obj"', ["8:advmod", "4:nmod:such_as;like", "1.2:obj"]),
    ('10:nsubj/1:"nmod:per|1:each"/9.1:conj:or', ["10:nsubj", "1:nmod:per|1:each", "9.1:conj:or"]),
    ("5:conj:and/or|6:dep", ["5:conj:and/or", "6:dep"]),
]


def split(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id bigint, src string, feats string, deps string, item string, field int, s string")
    out = packed.split_packed(df, ["id"], "src", {"feats": packed.FEATURE, "deps": packed.DEPENDENCY}, **kw)
    assert out.dtypes == [("id", "bigint"), ("field", "string"), ("pos", "int"), ("item", "string")]
    got = {}
    for r in sorted(out.collect(), key=lambda r: (str(r.id), r.field, r.pos)):
        got.setdefault((r.id, r.field), []).append(r["item"])
    return got


def test_items(spark):
    rows = [(i, "x", f, None, "clash", 1, "s") for i, (f, _) in enumerate(CASES)] + [(100 + i, "x", None, d, "clash", 1, None) for i, (d, _) in enumerate(DEPS)]
    got = split(spark, rows)
    for i, (_, want) in enumerate(CASES):
        assert got.get((i, "feats"), []) == want
    for i, (_, want) in enumerate(DEPS):
        assert got.get((100 + i, "deps"), []) == want


def test_empty_null_repeated_and_long(spark):
    assert split(spark, []) == {}
    long = "|".join(f"F{i}=V{i}" for i in range(20_000))
    got = split(spark, [(1, None, long, None, None, None, None), (None, None, "A=b", None, None, None, None), (2, "y", "A=b", None, None, None, None), (2, "y", "A=b", None, None, None, None)])
    assert len(got[1, "feats"]) == 20_000 and got[1, "feats"][-1] == "F19999=V19999"
    assert got[None, "feats"] == ["A=b"]
    assert got[2, "feats"] == ["A=b", "A=b"]


def test_scores_per_source(spark):
    rows = [("a", "A=b|C=d"), ("a", "A=b|C=d,e"), ("b", "A=b;C=d"), ("b", "A=b/c;C=d"), (None, "A=b")]
    s = {(r.source, r.delimiter): r for r in packed.delimiter_scores(spark.createDataFrame(rows, "src string, f string"), "src", {"f": packed.FEATURE}).collect()}
    assert s["a", "bar"].cuts == 2 and s["a", "bar"].regularity == 1 and s["a", "bar"].consistency == 1
    assert s["a", "comma"].cuts == 0 and s["a", "comma"].plain == 1
    assert s["b", "semicolon"].cuts == 2 and s["b", "slash"].cuts == 0
    assert s[None, "bar"].cuts == 0


def test_separator_that_never_separates_is_ordinary(spark):
    # within source b a bar stands before what looks like an item in one field only, and elsewhere never
    got = split(spark, [(1, "b", "A=x;C=y", None, "", 0, ""), (2, "b", "A=x/y;C=z", None, "", 0, "")])
    assert got[2, "feats"] == ["A=x/y", "C=z"]


def test_apostrophe_inside_a_value(spark):
    assert split(spark, [(1, "b", "Gloss=don't|Case=Nom", None, "", 0, "")])[1, "feats"] == ["Gloss=don't", "Case=Nom"]


@pytest.mark.parametrize("text,want", [('"a"', "a"), ("'a'", "a"), ('"a","b"', '"a","b"'), ('"a ""b"" c"', 'a "b" c'), ('"', '"')])
def test_unwrap(spark, text, want):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(text,)], "t string").select(packed.unwrap(F.col("t"))).head()[0] == want


def test_a_stray_row_admits_no_separator(spark):
    rows = [(i, f"s{i % 5}", "A=b;C=d", None, None, None, None) for i in range(400)]
    stray = [(1000, "s1", "A=b/c;Gloss=up/Down=e", None, None, None, None), (1001, "s1", "A=b C=d", None, None, None, None)]
    plain, got = split(spark, rows), split(spark, rows + stray)
    assert {k: v for k, v in got.items() if k[0] < 1000} == plain
    assert got[1000, "feats"] == ["A=b/c", "Gloss=up/Down=e"]  # the slash is an ordinary character of this collection
    assert got[1001, "feats"] == ["A=b C=d"]
    used = [(2000 + i, "s2", "A=b/C=d", None, None, None, None) for i in range(20)]
    assert split(spark, rows + stray + used)[1000, "feats"] == ["A=b/c", "Gloss=up", "Down=e"]  # a separator that the collection uses
