"""Every registered query with a SQL twin gives the twin's rows; the others run and keep their schema."""

import pytest
from oracle import connect, spark_rows, sql_rows

from corpuslake.plans.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, small, con, name):
    df = QUERIES[name](spark, small)
    assert spark_rows(df) == sql_rows(con, ORACLE_SQL[name], df.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.columns and df.count() >= 0


def test_no_python_in_relational_plans(spark, small):
    for name in ("a10_promotion_scan", "f18_structured_search", "w1_turn_pairing", "a11_period_summary", "x15_chunking", "w5_budget_shares"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan, name


def test_entry_module_names_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) >= len(QUERIES)
