from datetime import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from spanloom.operators import wide

INVENTORY = [
    ("Case", "category", "Nom", "Nominative"), ("Case", "category", "Acc", "Accusative"), ("Number[psor]", "category", "Sing", "Singular"),
    ("Person", "whole", "1", "first"), ("Person", "whole", "2", "second"), ("NumValue", "whole", None, None), ("Poss", "flag", "true", "Yes"), ("Poss", "flag", "false", "No"),
]
T = [dt(2024, 1, d) for d in range(1, 10)]


def run(spark, rows):
    df = spark.createDataFrame(rows, "row_no bigint, word_id bigint, attr string, val string, loaded_at timestamp, cells string, unread int")
    inv = spark.createDataFrame(INVENTORY, "attr string, val_type string, val string, long_name string")
    return df, inv, wide.pivot_typed(df, inv, "word_id", "attr", "val", ["loaded_at", "row_no"])


READINGS = [
    ("Case", "Nom", ("Case", "Nom")), (" case ", "nominative", ("Case", "Nom")), ("UD:case", "ACC.", ("Case", "Acc")), ("feats.number_psor", " sing", ("Number[psor]", "Sing")),
    ("number psor", "Singular", ("Number[psor]", "Sing")), ("Person", "second", ("Person", "2")), ("Person", "02", ("Person", "2")), ("Person", "3", None), ("Person", "-2", None), ("Person", "-1", None), ("Person", "1.2", None), ("Person", "4.3", None), ("Person", "(2)", None),
    ("Person", "2.0", ("Person", "2")), ("Person", " FIRST ", ("Person", "1")), ("Person", "first?", ("Person", "1")), ("Person", "1 or 2", None), ("Person", "", None), ("num-value", "+0012", ("NumValue", "12")),
    ("NumValue", "3482.00", ("NumValue", "3482")), ("NumValue", "4.5", None), ("NumValue", "-2", None), ("NumValue", "0", ("NumValue", "0")), ("NumValue", "000", ("NumValue", "0")),
    ("NumValue", "9" * 60, ("NumValue", "9" * 60)), ("NumValue", "1-3", None), ("poss", "Y", ("Poss", "true")), ("Poss", "0", ("Poss", "false")), ("Poss", "FALSE", ("Poss", "false")), ("Poss", "yes/no", None),
    ("Poss", "2", None), ("Poss", "-1", None), ("Poss", "+1", None), ("Poss", "yes.", ("Poss", "true")), ("Colour", "Yes", None), ("", "Yes", None), (None, "Yes", None), ("Case", None, None), ("Case", "not Nom", None), ("Case", "", None),
]


def test_readings(spark):
    _, _, w = run(spark, [(1, i, attr, val, T[0], "x", 1) for i, (attr, val, _) in enumerate(READINGS)])
    got = {r.word_id: (r.attr, r.val) for r in wide.cells_of(w, "word_id").collect()}
    for i, (attr, val, want) in enumerate(READINGS):
        assert got.get(i) == want, (attr, val)


def test_latest_readable_counts_and_types(spark):
    rows = [
        (1, 1, "Case", "Nom", T[0], "", 0), (2, 1, "case", "Acc", T[2], "", 0), (3, 1, "Case", "???", T[3], "", 0), (4, 1, "Case", "Nom", T[1], "", 0),
        (5, 1, "Poss", "maybe", T[0], "", 0), (6, 1, "Poss", "partly", T[1], "", 0), (7, 1, "NumValue", "1" * 50, T[0], "", 0), (8, 1, "Person", "1", None, "", 0),
        (9, 1, "Person", "2", None, "", 0), (10, None, "Case", "Nom", T[0], "", 0), (11, 2, "Case", "Nom", T[0], "", 0), (11, 2, "Case", "Nom", T[0], "", 0),
    ]
    df, inv, w = run(spark, rows)
    got = {r.word_id: r for r in w.collect()}
    assert set(got) == {1, 2}
    assert got[1].cells == {"Case": "Acc", "NumValue": "1" * 50, "Person": "2"}
    assert got[1].case == "Acc" and got[1].person == Decimal(2) and got[1].numvalue is None and got[1].poss is None
    assert got[1].unread == {"Poss": "partly"}
    clash = df.withColumns({"attr_known": F.lit(1), "val_read": F.lit("x"), "reason": F.lit("y")})
    assert {r.row_no: r.reason for r in wide.failures(clash, inv).collect()} == {3: "unreadable value", 5: "unreadable value", 6: "unreadable value"}


def test_empty(spark):
    _, _, w = run(spark, [])
    assert w.count() == 0 and "poss" in w.columns


def test_one_entity_with_many_rows(spark):
    rows = spark.range(50_000).select(F.col("id").alias("row_no"), F.lit(1).cast("bigint").alias("word_id"), F.lit("NumValue").alias("attr"), F.col("id").cast("string").alias("val"), F.lit(None).cast("timestamp").alias("loaded_at"))
    inv = spark.createDataFrame(INVENTORY, "attr string, val_type string, val string, long_name string")
    assert wide.pivot_typed(rows, inv, "word_id", "attr", "val", ["loaded_at", "row_no"]).head().cells == {"NumValue": "49999"}
