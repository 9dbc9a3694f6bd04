"""Composed layers over the driver tables (results fixture -> silver -> gold)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ranklab.operators.gold import build_gold
from ranklab.operators.ranking import stored
from ranklab.operators.silver import with_event_index
from ranklab.sources.fixture import event_results, qualifying

SILVER_COLUMNS = ("Year", "Circuit", "FullName", "TeamName", "Position", "GridPosition",
                  "Points", "RaceIndex")


def silver_from_tables(spark: SparkSession, sf_dir: str, skew_safe: bool | None = None) -> DataFrame:
    """Typed results with RaceIndex (CLN6/JON1) straight from the tables."""
    return with_event_index(event_results(spark, sf_dir, skew_safe)).select(*SILVER_COLUMNS)


def gold_from_tables(spark: SparkSession, sf_dir: str, skew_safe: bool | None = None,
                     with_qualifying: bool = True) -> DataFrame:
    """Gold features; the grid comes from the qualifying sessions (CLN7)."""
    # the event index, the size checks, the team table and the qualifying sessions all read the results
    res = stored(event_results(spark, sf_dir, skew_safe, with_quali_grid=with_qualifying))
    silver = with_event_index(res)
    quali = qualifying(res) if with_qualifying else None
    # gold is a layer: written once, read by every consumer branch
    return stored(build_gold(silver.drop("_qgrid", "EntrantKey"), quali, skew_safe=skew_safe))


GOLD_COLUMNS = (
    "Year", "Circuit", "FullName", "TeamName", "RaceIndex", "Position", "ClassifiedPosition",
    "GridPosition", "Points", "AvgFinishLast3", "AvgFinishLast5", "AvgFinishLast10",
    "AvgGridLast5", "DNFRateLast10", "TeamPointsLast5", "TeamForm", "CircuitAvgFinish",
    "CircuitWins", "CumPoints", "ChampPos", "IsWinner", "IsTop3", "IsTop10",
)


def gold_table(spark: SparkSession, sf_dir: str, skew_safe: bool | None = None) -> DataFrame:
    return gold_from_tables(spark, sf_dir, skew_safe).select(*GOLD_COLUMNS)

