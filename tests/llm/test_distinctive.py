import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import distinctive as di


def exact_tail(c, n, k, m):
    return Fraction(sum(math.comb(k, x) * math.comb(m - k, n - x) for x in range(c, min(n, k) + 1)), math.comb(m, n))


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_tail_is_exact(data):
    m = data.draw(st.integers(1, 400))
    n, k = data.draw(st.integers(1, m)), data.draw(st.integers(1, m))
    c = data.draw(st.integers(max(0, n + k - m), min(n, k)))
    p = exact_tail(c, n, k, m)
    got = di.log_upper_tail([c], [n], [k], [m])[0]
    assert abs(got - (math.log(p.numerator) - math.log(p.denominator))) < 1e-8


def test_log_factorial():
    n = np.array([0, 1, 5, 254, 255, 256, 257, 1000, 10**6])
    assert np.allclose(di.log_factorial(n), [math.lgamma(x + 1) for x in n], rtol=1e-13)


def test_large_numbers_end():
    got = di.log_upper_tail([5, 50_000, 60_000, 1], [10**6] * 4, [10**8] * 4, [2 * 10**9] * 4)
    assert np.isfinite(got).all() and got[0] == 0 and got[2] < got[1] < 0


def run(spark, rows):
    return di.distinctive_terms(spark.createDataFrame([(*r, 1.0) for r in rows], "txt bigint, w string, tfidf double"), "txt", "w")


def sample(seed=3):
    rnd = random.Random(seed)
    return [(rnd.randrange(12), rnd.choice("abcdefghij") * rnd.randint(1, 3)) for _ in range(2000)]


def test_scores(spark):
    rows = [*sample(), (None, "a"), (1, None)]
    good = [(t, w) for t, w in rows if t is not None and w is not None]
    c, n, k = Counter(good), Counter(t for t, _ in good), Counter(w for _, w in good)
    d, texts = Counter(w for _, w in c), len({t for t, _ in good})
    got = run(spark, rows).collect()
    assert len(got) == len(c)
    for r in got:
        assert (r.c, r.d, r.n, r.k, r.m, r.n_records) == (c[r.record, r.term], d[r.term], n[r.record], k[r.term], len(good), texts)
        assert abs(r.tfidf - round(r.c * math.log(texts / r.d), 9)) < 1e-8
        assert abs(r.enrichment + math.log(exact_tail(r.c, r.n, r.k, r.m))) < 1e-7


def test_hot_keys_by_broadcast(spark, monkeypatch):
    rows = sample(5)
    want = sorted(tuple(r) for r in run(spark, rows).collect())
    monkeypatch.setattr(di, "bar", lambda total: 5)
    assert sorted(tuple(r) for r in run(spark, rows).collect()) == want


def test_ties_by_code_point(spark):
    rows = [(1, w) for w in ("b", "Z", "é", "a", "z")] + [(2, w) for w in ("b", "Z", "é", "a", "z", "q")] + [(3, "q")]
    top = di.top_terms(run(spark, rows), "tfidf", 3, least_d=2).collect()
    assert [r.term for r in sorted(top, key=lambda r: r["rank"]) if r.record == 1] == ["Z", "a", "b"]


def test_discovery_adjusted(spark):
    s = run(spark, sample(9))
    got = di.discovery_adjusted(s).collect()
    p = sorted(math.exp(-r.enrichment) for r in got)
    m, best, adjusted = len(p), 1.0, {}
    for i in range(m, 0, -1):
        best = min(best, p[i - 1] * m / i)
        adjusted.setdefault(round(-math.log(p[i - 1]), 6), best)
    for r in got:
        assert abs(math.exp(-r.q) - adjusted[round(r.enrichment, 6)]) < 1e-6


def test_empty(spark):
    assert run(spark, []).count() == 0
    assert di.discovery_adjusted(run(spark, [])).count() == 0
