"""Physical plans: no Python in the hot path, bounded sorts, pushed filters."""

import pytest

from hourgrid.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["feature_table", "corr_matrix", "region_site", "energy_outer", "sequence_24"])
def test_no_python_udfs(spark, name):
    plan = _plan(QUERIES[name](spark, SF))
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_lags_and_means_share_one_exchange(spark):
    """Small series: one exchange and one sort behind the written hours."""
    plan = _plan(QUERIES["feature_table"](spark, SF))
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_windows_of_large_series_are_by_block(spark):
    from hourgrid.plans.catalog import BLOCK_CONF

    spark.conf.set(BLOCK_CONF, "40")
    try:
        plan = _plan(QUERIES["feature_table"](spark, SF))
    finally:
        spark.conf.unset(BLOCK_CONF)
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert windows and all("_blk" in x for x in windows)


def test_scan_prunes_columns(spark):
    from hourgrid.sources.bindings import panel

    plan = _plan(panel(spark, SF))
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double" in plan
    assert "l_partkey" not in plan and "l_orderkey" not in plan
    # the written hourly table is read back with only the columns each branch needs
    ft = _plan(QUERIES["feature_table"](spark, SF))
    assert "datetime" not in ft.split("ReadSchema")[-1]
