"""Stored ledger, deadlines as data, tied ranks, feature projections, version numbers."""

from pyspark.sql import functions as F

from ranklab.operators import ledger as LG
from ranklab.operators import ml as ML
from ranklab.operators import ranking as RK
from ranklab.operators.gold import championship_position
from ranklab.operators.silver import normalize_names
from ranklab.sources.sinks import latest_version, scratch_path, write_version

SUBS = "event_id long, user_id long, day date, ts timestamp, event_type string, value double, k int"


def _subs(spark, rows):
    df = spark.createDataFrame([(e, u, d, f"{d} {t}", kind, float(e), 0) for e, u, d, t, kind in rows],
                               "event_id long, user_id long, day string, ts string, event_type string, value double, k int")
    return df.select(*[F.col(f.split()[0]).cast(f.split()[1]).alias(f.split()[0]) for f in SUBS.split(", ")])


def _rows(ledger):
    return {r.user_id: (r.event_id, None if r.locked_at is None else r.locked_at.hour) for r in ledger.collect()}


def test_stored_lock_rejects_later_draft(spark):
    first = _subs(spark, [(1, 1, "2024-01-01", "08:00:00", "click"), (2, 1, "2024-01-01", "09:00:00", "purchase"),
                          (3, 2, "2024-01-01", "08:00:00", "click"), (4, 3, "2024-01-01", "08:00:00", "purchase")])
    later = _subs(spark, [(5, 1, "2024-01-01", "10:00:00", "click"), (6, 2, "2024-01-01", "10:00:00", "click"),
                          (7, 3, "2024-01-01", "10:00:00", "click"), (8, 4, "2024-01-01", "10:00:00", "click")])
    stored = LG.upsert_ledger(first)
    assert _rows(stored) == {1: (1, 9), 2: (3, None), 3: (None, 9 - 1)}
    merged = LG.upsert_ledger(later, stored)
    assert _rows(merged) == {1: (1, 9), 2: (6, None), 3: (None, 8), 4: (8, None)}
    assert _rows(LG.upsert_ledger(later.limit(0), merged)) == _rows(merged)  # an empty batch changes nothing
    assert _rows(LG.upsert_ledger(first.unionByName(later))) == _rows(merged)


def test_unknown_deadline_stays_open(spark):
    subs = _subs(spark, [(i, 1, d, t, "click") for i, (d, t) in enumerate(
        [("2024-01-01", "09:00:00"), ("2024-01-01", "11:00:00"), ("2024-01-02", "23:00:00"), ("2024-01-03", "23:00:00")])])
    deadlines = spark.sql("SELECT DATE'2024-01-01' AS day, TIMESTAMP'2024-01-01 10:00:00' AS lock_deadline "
                          "UNION ALL SELECT DATE'2024-01-02', CAST(NULL AS TIMESTAMP)")
    got = {str(r.day): r.event_id for r in LG.effective_predictions(subs, deadlines).collect()}
    assert got == {"2024-01-01": 0, "2024-01-02": 2, "2024-01-03": 3}
    assert {str(r.day) for r in LG.effective_predictions(subs).collect()} == {"2024-01-01"}  # noon


def test_write_back_keeps_unscored_rows(spark):
    ledger = spark.createDataFrame([(1, 2024, "A", True, None), (2, 2024, "A", True, None)],
                                   "user_id int, year int, race_name string, is_locked boolean, scored_at timestamp")
    scored = (ledger.withColumn("podium_hits", F.col("user_id"))
              .withColumn("scored_at", F.when(F.col("user_id") == 1, F.to_timestamp(F.lit("2024-05-05")))))
    got = {r.user_id: (r.podium_hits, r.scored_at is not None) for r in LG.write_back(ledger, scored).collect()}
    assert got == {1: (1, True), 2: (None, False)}


def test_tied_points_are_ranked_by_distinct_value(spark):
    df = spark.range(20_000).select(F.lit(1).alias("RaceIndex"), "id",
                                    F.when(F.col("id") % 100 == 0, F.col("id") % 700).otherwise(0.0).cast("double").alias("CumPoints"))
    counted = championship_position(df, skew_safe=True)
    window = championship_position(df, skew_safe=False)
    assert counted.schema["ChampPos"].dataType == window.schema["ChampPos"].dataType
    assert counted.select(*window.columns).exceptAll(window).isEmpty() and counted.count() == 20_000
    # no plan stage holds rows by value: the slices are of the distinct values
    assert "Window" not in counted._jdf.queryExecution().executedPlan().toString()


def test_broadcast_is_checked_by_bytes(spark):
    wide = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("t"))
    plan = lambda d: d._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(RK.broadcast_if_small(wide))
    assert "broadcast" not in plan(RK.broadcast_if_small(wide, max_bytes=5000))
    assert "broadcast" not in plan(RK.broadcast_if_small(wide, max_rows=9))
    assert "broadcast" in plan(RK.broadcast_if_small(wide.limit(0)))


def test_alias_dict_is_a_join(spark):
    df = spark.createDataFrame([(" B ",), ("a",), (None,)], "FullName string")
    assert sorted(r.FullName for r in normalize_names(df, aliases={"a": "A", "B": "b"}).collect()) == ["A", "Unknown", "b"]
    assert sorted(r.FullName for r in normalize_names(df, aliases={}).collect()) == ["B", "Unknown", "a"]


def test_feature_projections(spark):
    profile = spark.createDataFrame([(3.0, None, "x")], "avg_quali_pos double, team_form double, other string")
    row = ML.legacy_design(profile, ["GridPosition", "TeamForm", "ChampPos", "DNFRateLast10", "CircuitWins", "Odd", "other"]).first()
    assert row.asDict() == {"GridPosition": 3.0, "TeamForm": 0.0, "ChampPos": 10.0, "DNFRateLast10": 0.05,
                            "CircuitWins": 0.0, "Odd": 10.0, "other": 0.0}
    aligned = ML.align_features(profile, ["other", "avg_quali_pos", "none"], keep=["team_form"])
    assert aligned.columns == ["team_form", "other", "avg_quali_pos", "none"] and aligned.first()[1:] == (0.0, 3.0, 0.0)
    assert ML.available_features(spark.createDataFrame([(1.0, 2.0)], "TeamForm double, GridPosition double")) == ["GridPosition", "TeamForm"]


def test_all_targets_degenerate(spark):
    gold = spark.range(5).select(F.lit(2.0).alias("GridPosition"), F.lit(1.0).alias("AvgFinishLast5"), F.lit(0.0).alias("TeamForm"),
                                 F.col("id").cast("int").alias("RaceIndex"), *[F.lit(0).alias(t) for t in ("IsWinner", "IsTop3")])
    models, metrics, _ = ML.train_all(gold, parallel=False)
    assert models == {} and metrics.count() == 0 and "roc_auc" in metrics.columns


def test_uncommitted_version_is_skipped(spark):
    root = scratch_path(spark, "versions")
    assert latest_version(spark, root) is None
    paths = [write_version(spark.range(n), root) for n in range(1, 12)]  # 10 and 11 come after 9
    assert latest_version(spark, root).endswith(paths[-1].split("/")[-1])
    spark.conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    try:
        write_version(spark.range(99), root)
    finally:
        spark.conf.unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")
    assert latest_version(spark, root).endswith(paths[-1].split("/")[-1])
