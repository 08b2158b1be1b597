"""Every registered query equals its DuckDB SQL (row count, column names, values)."""

import pytest

import __spark_entry__ as E
from conftest import SF_MID, SF_SMALL
from hourglass.plans.check import compare, duckdb_connection, type_mismatches

NAMES = sorted(E.core_sql())


@pytest.fixture(scope="module")
def con_small():
    return duckdb_connection(SF_SMALL)


def test_every_query_has_oracle_or_is_model():
    q, s = E.core_queries(), E.core_sql()
    assert set(s) <= set(q)
    assert set(q) - set(s) == {"linear_forecast", "linear_moments", "forest_forecast"}


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle_sf0001(spark, con_small, name):
    r = compare(spark, name, SF_SMALL, E.queries()[name], E.oracle_sql()[name], con_small)
    assert r["columns_match"], (r["spark_columns"], r["oracle_columns"])
    assert r["spark_rows"] == r["oracle_rows"]
    assert r["exact"], r.get("first_diffs")


@pytest.mark.parametrize("name", ["clean_hourly", "panel_windows", "score_v2", "request_lookup", "eval_cases"])
def test_query_matches_oracle_sf001(spark, name):
    r = compare(spark, name, SF_MID, E.queries()[name], E.oracle_sql()[name])
    assert r["spark_rows"] == r["oracle_rows"] and r["exact"], r.get("first_diffs")


def test_entry_smoke(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["test_examples"] > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_types_match_oracle(spark, con_small, name):
    df = E.queries()[name](spark, SF_SMALL)
    assert type_mismatches(df, con_small, E.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", [n for n in sorted(E.core_queries()) if n not in ("forest_forecast", "linear_forecast")])
def test_no_cartesian_or_nested_loop_plans(spark, name):
    plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
