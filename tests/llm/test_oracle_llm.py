"""Registered queries against DuckDB, row by row, over whole tables."""

import pytest

from caseflow.llm import queries as Q
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, smoke_dir, name):
    r = compare(spark, name, Q.QUERIES[name], Q.SQL[name], smoke_dir)
    assert r["hash_match"] and r["cols_match"] and r["types_match"], r
    assert r["spark_rows"] > 0


def test_every_query_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {x.split("_")[0] + "_" for x in names if x.startswith("op")}
    assert "pipeline" in names
