import numpy as np
import pytest
from oracle import same

from spanloom.llm import queries as q


@pytest.mark.parametrize("name", list(q.SQL))
def test_query_equals_sql(spark, data, name):
    same(q.QUERIES[name](spark, data), data, q.SQL[name])


COLUMNS = {"p1_found": ["field", "term", "mark"], "p3_found": ["text_id", "term"], "p7_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id_1", "doc_id_2"]}


@pytest.mark.parametrize("name", [n for n in q.QUERIES if n not in q.SQL])
def test_query_runs(spark, data, name):
    df = q.QUERIES[name](spark, data)
    assert df.columns == COLUMNS.get(name, df.columns)
    assert df.count() >= 0


def test_p8_found_against_brute_force(spark, data):
    from spanloom.llm.leakage import _Keys, words
    from spanloom.llm.skeleton import look_alike_table
    from spanloom.tables import read

    table = _Keys(look_alike_table(spark))
    docs = [(r.doc_id, words(r.text, r.kind, table)) for r in read(spark, data, "documents").collect()]
    items = {r.item_id: words(r.text, None, table) for r in read(spark, data, "benchmark").collect()}
    runs = {}
    for i, ws in items.items():
        for k in range(len(ws) - 7):
            runs.setdefault(tuple(ws[k : k + 8]), set()).add(i)
    want = {(d, i) for d, ws in docs for k in range(len(ws) - 7) for i in runs.get(tuple(ws[k : k + 8]), ())}
    assert {tuple(r) for r in q.p8_found(spark, data).collect()} == want


def test_p9_found_against_brute_force(spark, data):
    from spanloom.llm.skeleton import look_alike_table, skeleton
    from spanloom.tables import read

    table = look_alike_table(spark)
    by = {}
    for r in read(spark, data, "documents").filter("text is not null").collect():
        if skeleton(r.text, table).strip():
            by.setdefault(skeleton(r.text, table), []).append((r.doc_id, r.text))
    want = {(a, b) for g in by.values() for a, x in g for b, y in g if a < b and x != y}
    assert {tuple(r) for r in q.p9_found(spark, data).collect()} == want


def brute_distances(docs, items, run):
    """(doc, item) -> least edit distance of any `run` words of the item to any stretch of the document, by the plain table, a row at a time over all documents."""
    ids = {}
    number = lambda w: ids.setdefault(w, len(ids))
    flat, owner = [], []
    for d, ws in docs:
        flat += [number(w) for w in ws] + [-1] * (run + 1)
        owner += [d] * (len(ws) + run + 1)
    text, owner = np.array(flat), np.array(owner)
    at = np.arange(len(text))
    out = {}
    for i, ws in items.items():
        best = np.full(len(text), run)
        for k in range(len(ws) - run + 1):
            row = np.zeros(len(text), np.int64)
            for n, w in enumerate(ws[k : k + run], 1):
                diagonal = np.concatenate([[n - 1], row[:-1]]) + (text != number(w))
                new = np.minimum(diagonal, row + 1)
                row = np.minimum.accumulate(new - at) + at
            best = np.minimum(best, row)
        for p in np.flatnonzero(best <= 1):
            out[owner[p], i] = min(int(best[p]), out.get((owner[p], i), run))
    return out


def test_p8_near_finds_all_of_brute_force(spark, data):
    from spanloom.llm.leakage import _Keys, words
    from spanloom.llm.skeleton import look_alike_table
    from spanloom.tables import read

    keys = _Keys(look_alike_table(spark))
    docs = [(r.doc_id, words(r.text, r.kind, keys)) for r in read(spark, data, "documents").collect()]
    items = {r.item_id: words(r.text, None, keys) for r in read(spark, data, "benchmark").collect()}
    want = {(d, i): e for (d, i), e in brute_distances(docs, items, 8).items()}
    got = {(r.doc_id, r.item_id): r.distance for r in q.p8_near(spark, data).collect()}
    print("true", len(want), "found", len(got), "both", len(want.keys() & got.keys()))
    assert got == want
