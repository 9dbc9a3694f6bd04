"""Stored ledgers of which a merge rewrites only the partitions it touches."""

import pytest
from pyspark.sql import functions as F

from ranklab.operators import ledger as LG
from ranklab.sources import partitions as PT
from ranklab.sources.sinks import scratch_path


def _table(spark, rows):
    return spark.createDataFrame(rows, "year int, event string, user long, score double")


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def _files(spark, root):
    """The live data files by partition keys."""
    data = spark.read.parquet(f"{root}/data").select("_commit", "_part", F.col("_metadata.file_path").alias("f"))
    live = PT.manifest(spark, root, PT.current(spark, root)).join(data, ["_commit", "_part"])
    return {(r.year, r.event): r.f for r in live.select("year", "event", "f").distinct().collect()}


def test_other_partitions_keep_their_files(spark):
    root = scratch_path(spark, "parts")
    assert PT.current(spark, root) is None and PT.read(spark, root) is None
    first = [(2023, "A", 1, 1.0), (2023, "A", 2, 2.0), (2024, "A", 1, 3.0), (None, None, 1, 4.0), (None, "", 1, 5.0)]
    v1 = PT.commit(_table(spark, first), root, ["year", "event"], None)
    before = _files(spark, root)
    v2 = PT.commit(_table(spark, [(2024, "A", 1, 9.0), (2024, "B", 7, 7.0)]), root, ["year", "event"], v1)
    after = _files(spark, root)
    assert (v1.number, v2.number, PT.current(spark, root)) == (1, 2, v2)
    assert {k for k in before if before[k] != after[k]} == {(2024, "A")}
    want = [r for r in first if r[:2] != (2024, "A")] + [(2024, "A", 1, 9.0), (2024, "B", 7, 7.0)]
    assert _rows(PT.read(spark, root)) == sorted(want, key=str)
    assert _rows(PT.read(spark, root, at=PT.version(spark, root, 1))) == sorted(first, key=str)  # older versions stay
    null_keys = spark.createDataFrame([(None, None), (2024, "B"), (2030, "Z")], "year int, event string")
    assert _rows(PT.read(spark, root, keys=null_keys)) == sorted([(None, None, 1, 4.0), (2024, "B", 7, 7.0)], key=str)


def test_scan_is_pruned_by_the_manifest(spark):
    root = scratch_path(spark, "parts")
    base = PT.commit(_table(spark, [(y, e, 1, 0.0) for y in range(10) for e in "ABCDE"]), root, ["year", "event"], None)
    PT.commit(_table(spark, [(1, "A", 1, 1.0)]), root, ["year", "event"], base)
    one = PT.read(spark, root, keys=spark.createDataFrame([(1, "A")], "year int, event string"))
    assert _rows(one) == [(1, "A", 1, 1.0)]
    plan = one._jdf.queryExecution().executedPlan()
    assert "dynamicpruning" in plan.toString()
    (scan,) = _data_scans(plan)
    assert scan.metrics().apply("numFiles").value() == 1  # of 51


def _data_scans(plan):
    """The scans of the data folder in an executed adaptive plan."""
    todo, out = [plan], []
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(p.plan())
            continue
        if name == "FileSourceScanExec" and "_commit#" in p.toString() and p.metrics().contains("numPartitions"):
            out.append(p)
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return out


def test_second_writer_on_a_base_fails(spark):
    root = scratch_path(spark, "parts")
    base = PT.commit(_table(spark, [(1, "A", 1, 0.0), (1, "B", 1, 0.0)]), root, ["year", "event"], None)
    PT.commit(_table(spark, [(1, "A", 1, 1.0)]), root, ["year", "event"], base)
    with pytest.raises(PT.BaseMoved):
        PT.commit(_table(spark, [(1, "B", 1, 2.0)]), root, ["year", "event"], base)
    assert _rows(PT.read(spark, root)) == [(1, "A", 1, 1.0), (1, "B", 1, 0.0)]  # nothing of the later one is seen
    PT.commit(_table(spark, [(1, "B", 1, 2.0)]), root, ["year", "event"], PT.current(spark, root))
    assert _rows(PT.read(spark, root)) == [(1, "A", 1, 1.0), (1, "B", 1, 2.0)]
    with pytest.raises(PT.BaseMoved):
        PT.commit(_table(spark, [(1, "C", 1, 2.0)]), root, ["year", "event"], None)  # a second first version


def test_emptied_partitions_new_columns_and_types(spark):
    root = scratch_path(spark, "parts")
    base = PT.commit(_table(spark, [(1, "A", 1, 0.0), (1, "B", 1, 0.0)]), root, ["year", "event"], None)
    gone = spark.createDataFrame([(1, "A")], "year int, event string")
    base = PT.commit(_table(spark, []), root, ["year", "event"], base, touched=gone)
    assert _rows(PT.read(spark, root)) == [(1, "B", 1, 0.0)]
    base = PT.commit(_table(spark, [(1, "C", 1, 0.0)]).withColumn("note", F.lit("x")), root, ["year", "event"], base)
    assert _rows(PT.read(spark, root)) == [(1, "B", 1, 0.0, None), (1, "C", 1, 0.0, "x")]
    with pytest.raises(ValueError, match="score"):
        PT.commit(_table(spark, []).withColumn("score", F.lit("x")), root, ["year", "event"], base)
    with pytest.raises(ValueError, match="partitioned"):
        PT.commit(_table(spark, []), root, ["year"], base)
    with pytest.raises(ValueError, match="reserved"):
        PT.commit(_table(spark, []).withColumn("_part", F.lit("x")), root, ["year", "event"], base)
    empty = scratch_path(spark, "parts")
    PT.commit(_table(spark, []), empty, ["year", "event"], None)
    assert PT.read(spark, empty).count() == 0


def test_stored_upsert_equals_the_whole_merge(spark):
    subs = (spark.range(400).select(F.col("id").alias("event_id"), (F.col("id") * 7 % 5).alias("user_id"),
                                    F.expr("DATE'2024-01-01' + CAST(id % 6 AS INT)").alias("day"), "id")
            .withColumn("ts", F.expr("CAST(day AS TIMESTAMP) + make_interval(0, 0, 0, 0, 0, CAST(id * 3 % 1400 AS INT))"))
            .withColumn("event_type", F.when(F.col("id") % 97 == 5, "purchase").otherwise("click"))
            .withColumn("value", F.col("id").cast("double")).drop("id"))
    root = scratch_path(spark, "ledger")
    LG.upsert_stored(subs.filter(F.hour("ts") < 9), root)
    late = subs.filter(F.hour("ts") >= 9)
    LG.upsert_stored(late.filter(F.dayofmonth("day") <= 3), root)
    LG.upsert_stored(late.filter(F.dayofmonth("day") > 3), root)
    last = PT.current(spark, root)
    want = LG.upsert_ledger(subs)
    got = PT.read(spark, root)
    assert got.count() == want.count() > 0
    assert got.select(*want.columns).exceptAll(want).isEmpty()
    versions = {r.day.day: r._version for r in PT.manifest(spark, root, last).collect()}
    assert versions == {1: 2, 2: 2, 3: 2, 4: 3, 5: 3, 6: 3}
