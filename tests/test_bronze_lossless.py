"""Bronze and ingest results must not depend on how an event is cut into files."""

import os

import pytest
from pyspark.sql import functions as F

from ranklab.operators.forecast import entrant_profile
from ranklab.operators.gold import grid_with_qualifying, team_form
from ranklab.sources.bronze import scan_bronze
from ranklab.sources.sinks import scratch_path
from ranklab.streaming.ingest import ingest, read_silver

HEAD = "FullName,TeamName,Position,GridPosition,Points\n"


def _part(root, event, number, names, head=HEAD):
    folder = os.path.join(root, f"Source={event}")
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, f"part-{number:05d}.csv"), "w") as fh:
        fh.write(head + "".join(f"{n},T,{i + 1},{i + 1},0\n" for i, n in enumerate(names)))


@pytest.mark.parametrize("max_files", [1, 1000])
def test_event_in_several_files_is_whole(spark, tmpdir_path, max_files):
    for k in range(3):
        _part(tmpdir_path, "2024_Bahrain_results.csv", k, [f"Entrant number {k}-{i}" for i in range(5)])
    silver, ck = scratch_path(spark, "silver"), scratch_path(spark, "ck")
    assert ingest(spark, tmpdir_path, silver, ck, max_files=max_files) == 3
    assert read_silver(spark, silver).count() == 15


def test_size_rule_is_of_the_event(spark, tmpdir_path):
    _part(tmpdir_path, "2024_Bahrain_results.csv", 0, [f"Entrant number {i}" for i in range(30)])
    _part(tmpdir_path, "2024_Bahrain_results.csv", 1, ["A", "B"])
    _part(tmpdir_path, "2024_Tiny_results.csv", 0, ["A"])
    raw = scan_bronze(spark, tmpdir_path)
    assert raw.count() == 32 and raw.select("Circuit").distinct().count() == 1


def test_season_without_files_raises_and_nested_files_are_found(spark, tmpdir_path):
    names = [f"Entrant number {i}" for i in range(20)]
    _part(tmpdir_path, "2024_Bahrain_results.csv", 0, names)
    _part(os.path.join(tmpdir_path, "more", "deep"), "2024_Monaco_results.csv", 0, names)
    assert scan_bronze(spark, tmpdir_path, years=[2024]).count() == 40
    with pytest.raises(FileNotFoundError):
        scan_bronze(spark, tmpdir_path, years=[2020])


def test_headers_in_other_order_inside_one_event(spark, tmpdir_path):
    names = [f"Entrant number {i}" for i in range(20)]
    _part(tmpdir_path, "2024_Bahrain_results.csv", 0, names)
    _part(tmpdir_path, "2024_Bahrain_results.csv", 1, ["x"] * 3, head="TeamName,FullName,Position,Extra,Points\n")
    rows = scan_bronze(spark, tmpdir_path).filter("FullName = 'T'").collect()
    assert len(rows) == 3 and {(r.TeamName, r.GridPosition, r.Extra) for r in rows} == {("x", None, str(i)) for i in (1, 2, 3)}


def test_qualifying_order_and_absent_columns(spark):
    silver = spark.createDataFrame([(2024, "A", "E", None)], "Year int, Circuit string, FullName string, GridPosition double")
    quali = spark.createDataFrame([(2024, "A", "E", "5", "f", 1), (2024, "A", "E", "2", "f", 2)],
                                  "Year int, Circuit string, FullName string, GridPosition string, Source string, _row int")
    assert grid_with_qualifying(silver, quali).first().GridPosition == 2.0
    with pytest.raises(ValueError):
        grid_with_qualifying(silver, quali.drop("_row"))
    assert grid_with_qualifying(silver, quali.drop("GridPosition")).first().GridPosition == 10.0
    assert team_form(silver).first().TeamForm == 0.0


def test_profile_defaults(spark):
    rows = [(2024, c, e, t, float(p), None, 10.0, float(pts), i)
            for i, c in enumerate(("A", "B", "C"))
            for e, t, p, pts in (("E1", "T1", 1, 25), ("E2", "T2", 2, 18), ("E3", "T3", 3, 15), ("E4", None, 4, 12))]
    hist = spark.createDataFrame(rows, "Year int, Circuit string, FullName string, TeamName string, Position double, "
                                       "RawGrid double, GridPosition double, Points double, RaceIndex int")
    targets = spark.createDataFrame([(2024, "D")], "Year int, Circuit string")
    got = entrant_profile(hist, targets).collect()
    assert {r.avg_quali_pos for r in got} == {12.0}          # no grid known anywhere
    # forms 75, 54, 45 and the filled median 54
    assert {r.team_form_p75 for r in got} == {59.25} and {r.team_form for r in got if r.FullName == "E4"} == {54.0}
    assert hist.filter(F.col("TeamName").isNull()).count() == 3
