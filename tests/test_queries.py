"""Every registered query against its SQL twin, on the smallest data set."""

import os

import pytest
from oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries
from modelward.operators import quality

FOLDER = os.environ.get("MODELWARD_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_twin(name, spark, con):
    df = queries()[name](spark, FOLDER)
    sql = oracle_sql().get(name)
    if sql is None:
        assert df.count() >= 0
    else:
        assert compare(df, sql, con) == ""


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", ["contract_assessment", "evaluation_metrics", "ks_drift", "vote_outcomes", "project_daily_costs", "point_in_time_training_set", "sustained_breaches"])
def test_no_cross_joins(name, spark):
    plan = queries()[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan
    physical = queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in physical and "BroadcastNestedLoopJoin" not in physical


def test_sketch_stats_scan_once(spark):
    df = quality.quick_stats(spark.read.parquet(f"{FOLDER}/customer.parquet"))
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_top_per_key_is_cut_before_the_shuffle(spark):
    plan = queries()["latest_config_per_project"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
