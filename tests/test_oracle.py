"""Every registered query with oracle SQL equals DuckDB on the driver tables
(sf0.001; the driver repeats this at sf0.01)."""

import pytest

from ranklab.plans.catalog import REGISTRY
from ranklab.plans.verify import compare, duck

from conftest import SF0001

NAMES = [n for n, q in REGISTRY.items() if q.oracle is not None]


@pytest.fixture(scope="module")
def con():
    return duck(SF0001)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    q = REGISTRY[name]
    res = compare(q.build(spark, SF0001), con, q.oracle)
    assert res["ok"], res


SLICED = ["gold_features", "season_standings", "historical_stats", "two_stage_forecast",
          "leaderboard", "compat_features", "strategy_predictions"]


@pytest.mark.parametrize("name", SLICED)
def test_sliced_plans_match_oracle(spark, con, name):
    """The same queries with every group over the window limit, so each
    rank/rolling frame takes the sliced (skew-safe) plan."""
    spark.conf.set("ranklab.windowGroupRows", "5")
    try:
        q = REGISTRY[name]
        res = compare(q.build(spark, SF0001), con, q.oracle)
    finally:
        spark.conf.unset("ranklab.windowGroupRows")
    assert res["ok"], res
