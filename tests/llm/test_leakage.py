import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import leakage as le
from spanloom.llm.skeleton import look_alike_table

ITEM = "One two three four five six seven eight nine ten eleven twelve."


def edit_search(p, t):
    """The least edit distance of p to any stretch of t, by the plain table."""
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=30))
def test_myers(p, t):
    assert le.myers_distance(p, t) == edit_search(p, t)


@pytest.mark.parametrize("text,kind,want", [
    ("The Café-\nteria, x_y 3.5", "prose", "the caféteria x y 3 5"), ("or­\nTwo", "prose", "or two"), ("batch-list end-", None, "batch list end"), ("a-\n   b", "guide", "ab"),
    ("the/X Café/NN nichts,/X , denn/X", "tagged", "the café nichts denn"), ("(S (X When the) (NN role) (X x))", "bracket", "when the role x"), ("1\tThe\tthe\tX\t0\n2\tDog\tdog\tNN\t1", "columns", "the dog"),
    ("１\tＴｈｅ\tｔｈｅ\tＸ\t０", "columns", "the"), ("Тhе ѕуntах​ ﬁle", "log", "the syntax file"), ("", "prose", ""), (None, None, ""), ("café", "prose", "café"),
])
def test_words(text, kind, want):
    assert " ".join(le.words(text, kind)) == want


def test_pieces_are_pigeonholes():
    for run in range(1, 40):
        for errors in range(0, 5):
            q = le.piece_length(run, errors)
            if run >= 2 * errors + 1:
                for start in range(q):
                    whole = sum(1 for a in range(0, start + run, q) if a >= start and a + q <= start + run)
                    assert whole >= errors + 1


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id bigint, text string, kind string, item_id string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    return {(r.doc_id, r.item_id): r.distance for r in le.leaks(d, i, **kw).collect()}


def test_boundaries(spark):
    ws = ITEM.lower().rstrip(".").split()
    docs = [(i, "zz " + " ".join(ws[i : i + 8]) + " yy", "prose") for i in range(5)] + [(10 + i, "zz " + " ".join(ws[i : i + 7]) + " yy", "prose") for i in range(6)]
    docs += [(20, " ".join(ws[:4] + ["x"] + ws[4:8]), "prose"), (21, ITEM, None), (22, None, "prose"), (23, "", "prose"), (24, "\n".join(f"{i}\t{w}\t{w}\tX\t0" for i, w in enumerate(ws[2:10], 1)), "columns")]
    items = [(1, ITEM), (2, "too short"), (3, None), (None, ITEM), (4, "")]
    assert run(spark, docs, items) == {(i, 1): 0 for i in [0, 1, 2, 3, 4, 21, 24]}
    assert run(spark, [], items) == {} and run(spark, docs, []) == {}


def test_repeats_and_long(spark):
    docs = [(1, ITEM, "prose"), (1, ITEM, "prose"), (2, "x " * 300_000 + ITEM, "prose")]
    items = [(i, f"{ITEM} {i}") for i in range(20)] + [(0, f"{ITEM} 0")]
    assert run(spark, docs, items) == {(d, i): 0 for d in (1, 2) for i in range(20)}


@pytest.mark.parametrize("errors", [0, 1, 2])
def test_against_brute_force(spark, errors):
    rnd = random.Random(errors)
    vocab = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(14))) for i in range(6)]
    docs = []
    for d in range(60):
        base = rnd.choice(items)[1].split()
        a = rnd.randrange(6)
        cut = base[a : a + rnd.randint(6, 10)]
        for _ in range(rnd.randint(0, 3)):
            cut[rnd.randrange(len(cut))] = rnd.choice(vocab)
        docs.append((d, " ".join([rnd.choice(vocab) for _ in range(5)] + cut + [rnd.choice(vocab) for _ in range(5)]), "prose"))
    want = {}
    for d, t, _ in docs:
        for i, it in items:
            ws = it.split()
            best = min(edit_search(ws[s : s + 8], t.split()) for s in range(len(ws) - 7))
            if best <= errors:
                want[d, i] = best
    assert run(spark, docs, items, errors=errors) == want
    assert run(spark, docs, items, errors=errors, held_characters=10) == want


def test_letters_that_are_one_by_case_or_look(spark):
    table = le._Keys(look_alike_table(spark))
    for a, b in [("ВОЙНА И МИР В К", "война и мир в к"), ("ΝΑΙ ΤΟΥ", "ναι του"), ("сору", "COPY"), ("Том", "ТОМ"), ("Вack", "back"), ("ΣΟΦΙΑ ΚΑΙ", "σοφια και"), ("Ёлка", "ёлка"), ("ＦＵＬＬ", "full"), ("Тhе", "THE")]:
        assert le.words(a, None, table) == le.words(b, None, table), (a, b)
    assert le.words("naïve", None, table) != le.words("naive", None, table)
    assert le.words("слово", None, table) != le.words("слова", None, table)
