import importlib

import pytest
from oracle import same

import __spark_entry__ as contract

MODULES = [importlib.import_module(m) for m in contract.MODULES]
WITH_SQL = [(n, m) for m in MODULES for n in m.SQL]
WITHOUT = [(n, m) for m in MODULES for n in m.QUERIES if n not in m.SQL]


@pytest.mark.parametrize("name,module", WITH_SQL, ids=[n for n, _ in WITH_SQL])
def test_query_equals_sql(spark, data, name, module):
    same(module.QUERIES[name](spark, data), data, module.SQL[name])


@pytest.mark.parametrize("name,module", WITHOUT, ids=[n for n, _ in WITHOUT])
def test_query_runs(spark, data, name, module):
    df = module.QUERIES[name](spark, data)
    assert df.count() >= 0
    assert len(set(df.columns)) == len(df.columns)


def test_entry_runs(spark, data):
    assert contract.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", ["token_to_span", "span_overlap_join", "leaf_covering_constituents", "mention_heads", "pair_cosine_tfidf"])
def test_no_nested_loop(spark, data, name):
    plan = next(m for m in MODULES if name in m.QUERIES).QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_needed_columns_only(spark, data):
    plan = next(m for m in MODULES if "shard_filter" in m.QUERIES).QUERIES["shard_filter"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
    assert "Exchange" not in plan
