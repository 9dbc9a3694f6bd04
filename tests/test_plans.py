"""Plan-shape checks: pruning/pushdown, one exchange for both gold window
families, partial WindowGroupLimit for top-k."""

from ranklab.operators.gold import circuit_features, entrant_features
from ranklab.operators.standings import circuit_winners
from ranklab.plans.layers import silver_from_tables
from ranklab.sources.tables import read_table

from conftest import SF0001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_prunes_columns_and_pushes_filters(spark):
    li = read_table(spark, SF0001, "lineitem", "l_suppkey", "l_quantity").filter("l_quantity > 10")
    p = _plan(li)
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in p
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double>" in p


def test_gold_windows_share_one_exchange(spark):
    silver = silver_from_tables(spark, SF0001, skew_safe=False)
    df = circuit_features(entrant_features(silver.withColumn("GridPosition", silver.GridPosition * 1.0)))
    df = df.select("FullName", "CircuitAvgFinish", "AvgFinishLast5", "DNFRateLast10")
    p = spark.sparkContext._jvm.org.apache.spark.sql.execution.SparkPlanInfo  # noqa: F841
    plan = df._jdf.queryExecution().sparkPlan().toString()
    windows = plan.count("Window [")
    assert windows >= 2
    text = df._jdf.queryExecution().executedPlan().toString()
    # the windows keyed (FullName) and (FullName, Circuit) sit above one hash exchange on FullName
    assert "hashpartitioning(FullName" in text
    assert "hashpartitioning(FullName#" in text and "hashpartitioning(FullName, Circuit" not in text


def test_top_k_uses_window_group_limit(spark):
    top = circuit_winners(silver_from_tables(spark, SF0001, skew_safe=False))
    p = top._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in p
