import pytest

from spanloom.operators import rejects

GOOD = "1\ta\ta\tX\tY\t_\t0\troot\t_\t_"


def line(id="1", feats="_", head="0", n=10):
    cells = [id, "a", "a", "X", "Y", feats, head, "dep", "_", "_"]
    return "\t".join((cells + ["_"] * 5)[:n])


CASES = [
    (GOOD, None), (GOOD + "\r", None), ("﻿" + GOOD, None), ("# comment\twith\ttabs", None), ("", None), ("\r", None), ("  ", None), (None, None), ("﻿# x", None),
    ("a b c", "columns"), (line(n=9), "columns"), (line(n=11), "columns"), (line(n=9, feats='"'), "columns"),
    (line(feats='"A=B'), "quoting"), (line(feats='"A=B"|"C=D"'), "quoting"), (line(feats='"A=B""'), "quoting"), (line(feats='A="B"'), "quoting"), (line(feats='"A=B"'), None), (line(feats='""'), "feats"),
    (line(id="0"), "id"), (line(id="01"), "id"), (line(id="2-2", head="_"), "id"), (line(id="10-9", head="_"), "id"), (line(id="9-10", head="_"), None), (line(id="0.1", head="_"), None), (line(id="5.0", head="_"), "id"),
    (line(id="٣"), "id"), (line(id=" 1"), "id"), (line(id=""), "id"), (line(id="1e1"), "id"), (line(id="99999999999999999999-100000000000000000000", head="_"), None),
    (line(id="1", head="1"), "head"), (line(head="01"), "head"), (line(head="_"), "head"), (line(head="²"), "head"), (line(id="1-2", head="0"), "head"), (line(id="1.1", head="0"), "head"),
    (line(feats=""), "feats"), (line(feats="A=B|A=C"), "feats"), (line(feats="A=B|"), "feats"), (line(feats="a=B"), "feats"), (line(feats="A=b"), "feats"), (line(feats="A=B,"), "feats"), (line(feats="A=B,,C"), "feats"),
    (line(feats="A=B,C|D[psor]=1"), None), (line(feats="A=B;C=D"), "feats"), (line(feats="A[psor]=B|A=B"), None),
    (line(id="x", head="x", feats="x"), "id"),
]


def test_reasons(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, (t, _) in enumerate(CASES)], "line_id bigint, line string, reason string")
    bad = rejects.faulty_lines(df)
    got = {r.line_id: r.reason for r in bad.collect()}
    for i, (t, want) in enumerate(CASES):
        assert got.get(i) == want, (t, got.get(i), want)
    good = {r.line_id for r in rejects.valid_rows(df, bad).collect()}
    assert good == {i for i, (t, want) in enumerate(CASES) if want is None and t and t.lstrip("﻿").strip() and not t.lstrip("﻿").startswith("#")}


def test_valid_rows_are_unquoted(spark):
    df = spark.createDataFrame([(1, line(feats='"A=B"'), "f")], "line_id bigint, line string, file_name string")
    r = rejects.valid_rows(df, rejects.faulty_lines(df), extra=("file_name",)).head()
    assert r.feats == "A=B" and r.head == "0" and r.file_name == "f"


def test_null_key_repeats_empty_long(spark):
    rows = [(None, line(id="0")), (None, line(id="0")), (1, line(id="0")), (1, line(head="x")), (2, "x" * 1_000_000)]
    df = spark.createDataFrame(rows, "line_id bigint, line string")
    assert sorted((r.line_id or -1, r.reason) for r in rejects.faulty_lines(df).collect()) == [(-1, "id"), (1, "id"), (2, "columns")]
    assert rejects.faulty_lines(df.limit(0)).count() == 0
    assert rejects.valid_rows(df, rejects.faulty_lines(df)).count() == 0


@pytest.mark.parametrize("n", [1, 3])
def test_rule_table_is_fixed(spark, n):
    assert rejects.rule_table(spark).count() == len(rejects.RULES)
