"""Layer 4: scale guards on physical plans."""

from conftest import SF_SMALL

import __spark_entry__ as E  # noqa: E402

Q = E.queries()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_row_at_a_time_python_udfs(spark):
    for key in ["top_k_group", "frequency_encode", "oof_target_encode", "transform_chain", "customer_history",
                "rolling_mean_30", "categorical_target_assoc", "value_counts_long", "threshold_table"]:
        p = plan_of(Q[key](spark, SF_SMALL))
        assert "BatchEvalPython" not in p, key


def test_encoders_use_no_row_window(spark):
    for key in ["frequency_encode", "oof_target_encode", "rare_by_min_count", "loo_group_mean"]:
        p = plan_of(Q[key](spark, SF_SMALL))
        assert "Window" not in p, key


def test_filters_and_columns_reach_the_scan(spark):
    df = Q["date_range_filter"](spark, SF_SMALL)
    p = plan_of(df)
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz>" in p
