"""Layers are written once and read by columns; rows that cannot be among an
event's first are not sorted."""

from pyspark.sql import functions as F

from conftest import SF0001
from ranklab.operators import ledger as LG
from ranklab.operators.gold import build_gold, grid_number
from ranklab.operators.silver import clean_silver
from ranklab.plans.layers import gold_table


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_gold_is_read_by_columns(spark):
    assert "ReadSchema: struct<FullName:string>" in _plan(gold_table(spark, SF0001).select("FullName"))


def test_silver_does_not_go_back_to_the_bronze_files(spark, tmpdir_path):
    rows = [("A", "T", "1", "2", "25"), ("B", "T", "2", "1", "18")]
    spark.createDataFrame(rows, "FullName string, TeamName string, Position string, GridPosition string, Points string").write.option(
        "header", "true").csv(tmpdir_path + "/b")
    raw = spark.read.option("header", "true").csv(tmpdir_path + "/b").withColumns({"Year": F.lit(2024), "Circuit": F.lit("X")})
    silver = clean_silver(raw)
    assert "csv" not in _plan(silver).lower()
    # the team table is made of the stored rows, not of the joined ones
    gold = build_gold(silver, raw.select("Year", "Circuit", "FullName", "GridPosition", F.lit(1).alias("Session")))
    assert {r.FullName: r.GridPosition for r in gold.collect()} == {"A": 2.0, "B": 1.0}


def test_grids_that_are_numbers_do_not_pass_through_text(spark):
    df = spark.createDataFrame([(1.5,), (float("nan"),), (None,)], "GridPosition double")
    assert "string" not in str(grid_number(df))
    assert [r.g for r in df.select(grid_number(df).alias("g")).collect()] == [1.5, None, None]


def test_top_rows_are_found_past_odd_keys(spark):
    keys = [None, float("nan"), float("inf"), -3.0, 0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 3.0, 700.0, 800.0, 5e300]
    rows = [(2024, "X", f"d{i:02d}", "t", k, k, k) for i, k in enumerate(keys)]
    gold = spark.createDataFrame(rows, "Year int, Circuit string, FullName string, TeamName string, GridPosition double, "
                                       "AvgFinishLast5 double, ChampPos double")
    bands = [r.b for r in gold.filter("GridPosition IS NOT NULL").orderBy("GridPosition").select(LG.key_band("GridPosition").alias("b")).collect()]
    assert bands == sorted(bands)
    for n in (1, 3, 5, 10, 13, 20):
        want = [r.FullName for r in gold.orderBy(F.col("GridPosition").asc_nulls_last(), "FullName").limit(n).collect()]
        got = LG.strategy_predictions(gold, n).filter("user_id = 1").orderBy("pos")
        assert [r.driver for r in got.collect()] == want


def test_the_schedule_does_not_sort_line_items(spark):
    from ranklab.operators.schedule import raw_schedule
    plan = raw_schedule(spark, SF0001)._jdf.queryExecution().sparkPlan().toString()
    # the lowest aggregates, next to the join, hash; only those over one row a type word may sort
    lowest = [line for line in plan.splitlines() if "Aggregate(" in line][-2:]
    assert all("HashAggregate" in line for line in lowest), plan
