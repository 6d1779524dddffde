"""Every registered query: Spark result equals its DuckDB oracle (sf0.001);
queries without an oracle run over the whole tables and return rows."""

import pytest

from caseflow.plans.catalog import load_all
from tests.oracle import compare, duck

REG = load_all()
WITH_SQL = sorted(n for n, s in REG.items() if s.sql)
ROWS_ONLY = sorted(n for n, s in REG.items() if not s.sql)


@pytest.fixture(scope="module")
def con(smoke_dir):
    return duck(smoke_dir)


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_oracle(spark, smoke_dir, con, name):
    r = compare(spark, name, REG[name].build, REG[name].sql, smoke_dir, con)
    assert r["cols_match"], r
    assert r["types_match"], r
    assert r["spark_rows"] == r["duck_rows"], r
    assert r["hash_match"], r


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_runs(spark, smoke_dir, name):
    assert REG[name].build(spark, smoke_dir).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert df.columns == ["Case_Type", "avg_days", "closed"]


def test_every_query_names_survey_operators():
    for name, spec in REG.items():
        assert spec.ops, name
        assert spec.doc, name


PAIR_OPERATORS = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.mark.parametrize("name", sorted(REG))
def test_no_cross_or_nested_loop_join(spark, smoke_dir, name):
    """No registered plan pairs every row with every row."""
    plan = REG[name].build(spark, smoke_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(op in plan for op in PAIR_OPERATORS), name
