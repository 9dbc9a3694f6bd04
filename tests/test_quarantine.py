"""Damaged files and records go to a side table; the rest is read."""

import gzip
import os

from pyspark.sql import functions as F

from ranklab.operators import forecast as FC
from ranklab.sources.quarantine import cells_of, scan_with_quarantine

HEAD = "FullName,TeamName,Position\n"


def put(root, event, data, name="part-0.csv"):
    folder = os.path.join(root, f"Source={event}_results.csv")
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())


def rows(n):
    return "".join(f"Entrant {i},Team,{i}\n" for i in range(n))


def test_each_kind_of_damage(spark, tmpdir_path):
    packed = gzip.compress((HEAD + rows(5000)).encode())
    put(tmpdir_path, "2024_Whole", packed, "part-0.csv.gz")
    put(tmpdir_path, "2024_Cut", packed[: len(packed) // 2], "part-0.csv.gz")
    put(tmpdir_path, "2024_Cut", HEAD + rows(30), "part-1.csv")
    put(tmpdir_path, "2024_Odd", (HEAD + rows(20)).encode() + b"one,too,many,cells\nfew,cells\nbad \xff\xfe,T,7\n"
        + '"two\nlines, quoted ""so""",T,8\n'.encode())
    put(tmpdir_path, "2024_Other", "Position,Extra,FullName,TeamName\n" + "".join(f"{i},x,Name {i},T\n" for i in range(20)) + "1,x,short\n")
    good, bad = scan_with_quarantine(spark, tmpdir_path)
    per = {r.Circuit: r["count"] for r in good.groupBy("Circuit").count().collect()}
    assert per == {"Whole": 5000, "Cut": 30, "Odd": 21, "Other": 20}
    assert good.filter("FullName = 'two\nlines, quoted \"so\"'").select("Position").first()[0] == "8"
    assert {(r.FullName, r.Position) for r in good.filter("Circuit = 'Other'").collect()} == {(f"Name {i}", str(i)) for i in range(20)}
    tally = {(r.Source, r.reason): r["count"] for r in bad.groupBy("Source", "reason").count().collect()}
    assert tally == {("2024_Cut_results.csv", "unreadable file"): 1, ("2024_Odd_results.csv", "column count"): 2,
                     ("2024_Odd_results.csv", "bad bytes"): 1, ("2024_Other_results.csv", "column count"): 1}
    assert {r.record for r in bad.filter("reason = 'column count'").collect()} == {"one,too,many,cells", "few,cells", "1,x,short"}
    assert bad.filter("reason = 'unreadable file'").first().path.endswith("part-0.csv.gz")


def test_nothing_left_to_read(spark, tmpdir_path):
    put(tmpdir_path, "2024_Cut", gzip.compress((HEAD + rows(900)).encode())[:900], "part-0.csv.gz")
    good, bad = scan_with_quarantine(spark, tmpdir_path)
    assert good is None and [r.reason for r in bad.collect()] == ["unreadable file"]


def test_cells(spark):
    texts = {"a,b,c": 3, "": 1, ",": 2, '"a,b",c': 2, '"a ""x, y"" b",c,': 3, '"open, and\nnever closed': 1}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", cells_of(F.col("t")).alias("n"))
    assert {r.t: r.n for r in df.collect()} == texts


def test_urls_reach_forecast_and_profile(spark):
    rows = [(2023, "A Race", 0, "X", "u1"), (2023, "B Race", 1, "X", "u2"), (2023, "C Race", 2, "X", None), (2023, "C Race", 2, "Y", "v")]
    hist = spark.createDataFrame(rows, "Year int, Circuit string, RaceIndex int, FullName string, HeadshotUrl string").withColumns(
        {c: F.lit(3.0) for c in ("Position", "GridPosition", "Points", "CircuitAvgFinish", *FC.LAST_FALLBACKS)} | {"TeamName": F.lit("T")})
    targets = FC.target_events(spark.createDataFrame([(2023, "D Race")], "Year int, race_name string"))
    fc = {r.FullName: r.HeadshotUrl for r in FC.two_stage_forecast(FC.feature_rows(hist, targets)).collect()}
    assert fc == {"X": None, "Y": "v"}  # the latest event's
    profile = FC.entrant_profile(hist, targets)
    assert {r.FullName: r.HeadshotUrl for r in profile.collect()} == {"X": "u2", "Y": "v"}  # the last that there is
    assert "HeadshotUrl" in FC.legacy_forecast(profile).columns
    assert "HeadshotUrl" not in FC.feature_rows(hist.drop("HeadshotUrl"), targets).columns
