"""The reference's own test and sample rows, re-expressed (FIXTURES A1, A2)."""

from pyspark.sql import functions as F

from ranklab.operators.standings import entrant_form, heuristic_pick


def _standings(spark, rows):
    df = spark.createDataFrame(rows, "full_name string, team_name string, driver_points int")
    return df.select(F.lit(2025).alias("Year"), F.col("full_name").alias("FullName"),
                     F.col("team_name").alias("TeamName"), F.col("driver_points").alias("Points"))


def test_baseline_pick_two_rows(spark):
    """SRC9 + AGG19: A1 rows (A,T1,10) (B,T2,20) -> pole = winner = B, team T2."""
    r = heuristic_pick(_standings(spark, [("A", "T1", 10), ("B", "T2", 20)])).collect()
    assert len(r) == 1
    assert (r[0].PoleSetter, r[0].RaceWinner, r[0].WinningConstructor) == ("B", "B", "T2")


def test_weekly_rows_form_and_pick(spark):
    """A2: five literal rows -> AGG1 counts and AGG19 picks."""
    rows = [(12, "Kimi Antonelli", "Mercedes", 1, 72), (63, "George Russell", "Mercedes", 2, 63),
            (16, "Charles Leclerc", "Ferrari", 3, 49), (44, "Lewis Hamilton", "Ferrari", 4, 41),
            (4, "Lando Norris", "McLaren", 5, 25)]
    df = spark.createDataFrame(rows, "driver_number int, full_name string, team_name string, "
                                     "position int, driver_points int")
    res = df.select(F.col("full_name").alias("FullName"), F.col("team_name").alias("TeamName"),
                    F.col("position").alias("Position"), F.col("driver_points").alias("Points"))
    form = {r.FullName: r for r in entrant_form(res).collect()}
    assert all(r.starts == 1 for r in form.values())
    assert [n for n, r in form.items() if r.wins == 1] == ["Kimi Antonelli"]
    assert sorted(n for n, r in form.items() if r.podiums == 1) == [
        "Charles Leclerc", "George Russell", "Kimi Antonelli"]
    pick = heuristic_pick(res.withColumn("Year", F.lit(2025))).collect()[0]
    assert pick.RaceWinner == "Kimi Antonelli" and pick.WinningConstructor == "Mercedes"
