"""The skew-safe operators agree with plain windows, ties included."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from ranklab.operators.ranking import group_total, rank_within, rolling_rows, running_within, top_k_within


def _data(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    # one hot group holding most rows, a few small ones, heavy ties, a null group
    rows = [("hot" if rnd.random() < 0.7 else rnd.choice(["a", "b", None]), rnd.randint(0, 40), i)
            for i in range(n)]
    return spark.createDataFrame(rows, "g string, s int, id int")


def test_rank_methods_match_window(spark):
    df = _data(spark)
    for method, fn in (("rank", F.rank), ("row_number", F.row_number), ("dense_rank", F.dense_rank)):
        order = [("s", True)] + ([("id", False)] if method == "row_number" else [])
        safe = rank_within(df, ["g"], order, out="r", method=method, skew_safe=True, slices=5)
        w = Window.partitionBy("g").orderBy(*([F.col("s").desc()] + ([F.col("id")] if method == "row_number" else [])))
        plain = df.withColumn("r", fn().over(w))
        a = sorted(safe.select("id", "r").collect())
        b = sorted(plain.select("id", "r").collect())
        assert a == b, method


def test_global_rank(spark):
    df = _data(spark, 500)
    safe = rank_within(df, [], [("s", False), ("id", False)], out="r", method="row_number", slices=3)
    assert sorted(r.r for r in safe.collect()) == list(range(1, 501))


def test_rolling_rows_matches_window(spark):
    df = _data(spark).withColumn("v", F.col("s").cast("double"))
    got = rolling_rows(df, ["g"], [("id", False)], "v", 5, "roll", skew_safe=True)
    w = Window.partitionBy("g").orderBy("id").rowsBetween(-5, -1)
    exp = df.withColumn("roll", F.sum("v").over(w))
    assert sorted(got.select("id", "roll").collect()) == sorted(exp.select("id", "roll").collect())


def test_group_total_and_top_k(spark):
    df = _data(spark, 800)
    tot = group_total(df, ["g"], "s", "t")
    w = Window.partitionBy("g")
    exp = df.withColumn("t", F.sum("s").over(w))
    assert sorted(tot.select("id", "t").collect()) == sorted(exp.select("id", "t").collect())
    top = top_k_within(df, ["g"], [("s", True), ("id", False)], 3, out="k")
    assert top.groupBy("g").count().agg(F.max("count")).first()[0] == 3


def test_running_within_matches_window(spark):
    df = _data(spark).withColumn("v", F.when(F.col("s") % 7 == 0, None).otherwise(F.col("s")))
    got = running_within(df, ["g"], [("id", False)], {"tot": "v"}, seq="seq", slices=6)
    w = Window.partitionBy("g").orderBy("id")
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    exp = df.select("id", F.coalesce(F.sum("v").over(prior), F.lit(0)).alias("tot"),
                    F.count("v").over(prior).alias("tot_n"), F.row_number().over(w).alias("seq"))
    a = sorted(got.select("id", F.col("tot").cast("long"), "tot_n", "seq").collect())
    b = sorted(exp.select("id", F.col("tot").cast("long"), "tot_n", "seq").collect())
    assert a == b


def test_entrant_features_sliced_equals_window(spark):
    from ranklab.operators.gold import entrant_features, entrant_features_sliced
    from ranklab.plans.layers import silver_from_tables
    from conftest import SF0001
    silver = silver_from_tables(spark, SF0001).withColumn(
        "GridPosition", F.coalesce(F.col("GridPosition").cast("double"), F.lit(10.0)))
    cols = ["FullName", "RaceIndex", "AvgFinishLast3", "AvgFinishLast5", "AvgFinishLast10",
            "AvgGridLast5", "DNFRateLast10", "CumPoints"]
    a = sorted(entrant_features_sliced(silver).select(*cols).collect())
    b = sorted(entrant_features(silver).select(*cols).collect())
    assert a == b


def test_broadcast_if_small_checks_size(spark):
    from ranklab.operators.ranking import broadcast_if_small
    small = spark.range(10)
    big = spark.range(50)
    joined_small = spark.range(1000).join(broadcast_if_small(small, max_rows=20), "id")
    joined_big = spark.range(1000).join(broadcast_if_small(big, max_rows=20), "id")
    assert "ResolvedHint (strategy=broadcast)" in joined_small._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint (strategy=broadcast)" not in joined_big._jdf.queryExecution().analyzed().toString()
    assert joined_small.count() == 10 and joined_big.count() == 50


def test_versioned_writes_read_latest(spark):
    from ranklab.sources.sinks import latest_version, scratch_path, write_version
    root = scratch_path(spark, "versions")
    write_version(spark.range(3), root)
    p2 = write_version(spark.range(5), root)
    assert latest_version(spark, root) in (p2, "file:" + p2) or latest_version(spark, root).endswith(p2.split("/")[-1])
    assert spark.read.parquet(latest_version(spark, root)).count() == 5
