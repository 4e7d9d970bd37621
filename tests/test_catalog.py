import pytest
from compare import SF, same_rows

from tessella.plans.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF), duck.sql(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0


def test_topk_is_an_ordered_take_and_prunes_columns(spark):
    plan = QUERIES["keyset_first_page"](spark, SF)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan
    plan = QUERIES["corpus_by_source"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<source:string>" in plan
    plan = QUERIES["owner_alive_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id" in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
