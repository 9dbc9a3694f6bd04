"""Active-set rules (C10), bronze CSV edge cases (C5) and streaming ingest."""

import os

from pyspark.sql import functions as F

from ranklab.operators.forecast import active_entrants
from ranklab.operators.silver import clean_silver, keep_last
from ranklab.sources.bronze import scan_bronze
from ranklab.sources.fixture import bronze_results, event_results
from ranklab.sources.sinks import scratch_path, write_bronze
from ranklab.streaming.ingest import ingest, read_silver

from conftest import SF0001


def _hist(spark, rows):
    return spark.createDataFrame(rows, "Year int, Circuit string, FullName string")


def test_active_set_pulls_previous_season(spark):
    base = [(2023, c, "Old") for c in ("A", "B", "C")]
    two = _hist(spark, base + [(2024, "A", "New"), (2024, "B", "New")])
    three = _hist(spark, base + [(2024, c, "New") for c in ("A", "B", "C")])
    t = spark.createDataFrame([(2024, "D")], "Year int, Circuit string")
    assert sorted(r.FullName for r in active_entrants(two, t).collect()) == ["New", "Old"]
    assert sorted(r.FullName for r in active_entrants(three, t).collect()) == ["New"]


def _write(path, text):
    with open(path, "w") as fh:
        fh.write(text)


def test_bronze_messy_files(spark, tmpdir_path):
    d = tmpdir_path
    pad = "".join(f"Filler {i},T,{i + 3},{i + 3},0\n" for i in range(12))
    _write(os.path.join(d, "2024_Miami_Grand_Prix_results.csv"),
           "FullName,TeamName,Position,GridPosition,Points\n"
           " Andrea Kimi Antonelli ,Mercedes,1,2,25\nNico Hülkenberg,Sauber, 5 ,,10\n" + pad)
    _write(os.path.join(d, "2024_Monaco_Grand_Prix_results.csv"),
           "Points,Position,FullName,TeamName,Extra\n25,1,ANTONELLI,Mercedes,x\n0,R,Retired,Haas,y\n"
           "0,NA,NoFinish,Haas,z\n18,nan,Nan Finish,Haas,w\n15,3,,Haas,v\n"
           + "".join(f"0,{i + 4},Filler {i},T,q\n" for i in range(12)))
    _write(os.path.join(d, "2024_Tiny_results.csv"), "FullName,Position\nA,1\n")
    raw = scan_bronze(spark, d)
    assert raw.select("Source").distinct().count() == 2           # tiny file skipped
    s = {(r.Circuit, r.FullName): r for r in clean_silver(raw).collect()}
    assert s[("Miami Grand Prix", "Kimi Antonelli")].Position == 1  # trimmed + alias
    assert s[("Monaco Grand Prix", "Kimi Antonelli")].Points == 25.0  # header order differs
    hulk = s[("Miami Grand Prix", "Nico Hulkenberg")]
    assert hulk.Position == 5 and hulk.GridPosition is None
    assert ("Monaco Grand Prix", "Retired") not in s and ("Monaco Grand Prix", "NoFinish") not in s
    assert ("Monaco Grand Prix", "Nan Finish") not in s
    assert s[("Monaco Grand Prix", "Unknown")].Position == 3       # null name -> Unknown
    assert {r.RaceIndex for r in s.values()} == {0, 1}


def test_bronze_season_scan_and_keep_last(spark, tmpdir_path):
    d = tmpdir_path
    rows = "".join(f"E{i},T,{i},{i},0\n" for i in range(1, 14))
    _write(os.path.join(d, "2023_Bahrain_results.csv"), "FullName,TeamName,Position,GridPosition,Points\n" + rows)
    _write(os.path.join(d, "2024_Bahrain_results.csv"),
           "FullName,TeamName,Position,GridPosition,Points\n" + rows + "E1,T,9,9,0\n")
    one = scan_bronze(spark, d, years=[2024])
    assert {r.Year for r in one.select("Year").distinct().collect()} == {2024}
    dedup = keep_last(one, ["Year", "Circuit", "FullName"], ["Source", "_row"])
    assert dedup.filter(F.col("FullName") == "E1").first().Position == "9"   # last row wins


def test_streaming_ingest_incremental(spark):
    root, silver, ck = (scratch_path(spark, n) for n in ("bronze", "silver", "ck"))
    b = bronze_results(event_results(spark, SF0001)).withColumn(
        "_y", F.substring("Source", 1, 4).cast("int")).cache()
    write_bronze(b.filter("_y <= 1996").drop("_y"), root)
    n1 = ingest(spark, root, silver, ck)
    write_bronze(b.filter("_y > 1996").drop("_y"), root, mode="append")
    n2 = ingest(spark, root, silver, ck)
    n3 = ingest(spark, root, silver, ck)
    assert n1 > 0 and n2 > 0 and n3 == 0
    assert read_silver(spark, silver).count() == b.count()


def test_standings_on_typed_bronze_keep_unclassified_points(spark, tmpdir_path):
    from ranklab.operators.silver import typed_bronze
    from ranklab.operators.standings import season_standings
    d = tmpdir_path
    rows = "".join(f"E{i},T,{i},{i},{max(0, 11 - i)}\n" for i in range(1, 14))
    _write(os.path.join(d, "2024_Bahrain_results.csv"),
           "FullName,TeamName,Position,GridPosition,Points\n" + rows + "Late,T,R,20,3\n")
    raw = scan_bronze(spark, d)
    st = {r.FullName: r for r in season_standings(typed_bronze(raw)).collect()}
    assert st["Late"].Points == 3 and st["Late"].Races == 0    # points kept, no classified race
    assert "Late" not in {r.FullName for r in clean_silver(raw).collect()}
