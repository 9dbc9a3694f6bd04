"""The measured, salted join: rows as a plain join's, work spread over tasks."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from ranklab.operators import skew
from ranklab.operators.ranking import group_total
from ranklab.sources import sinks as SK
from ranklab.sources.bronze import scan_bronze
from ranklab.operators.silver import keep_last


def hot_rows(spark, n=20_000):
    """90 % of the rows on one key, some on none."""
    key = F.when(F.col("id") % 10 != 0, "hot").when(F.col("id") % 50 == 0, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 997).cast("string")))
    return spark.range(n).select(key.alias("key"), F.col("id").alias("v"))


@pytest.fixture()
def no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(skew, "broadcast_if_small", lambda df: df)
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.adaptive.skewJoin.enabled": "false"}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k in held:
        spark.conf.unset(k)


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_rows_of_a_plain_join(spark, no_broadcast, how, null_safe):
    left = hot_rows(spark, 3000)
    right = spark.createDataFrame([("hot", 1), ("hot", 2), (None, 3), ("k10", 4), ("absent", 5)], "rk string, w int")
    cond = left["key"].eqNullSafe(right["rk"]) if null_safe else left["key"] == right["rk"]
    want = Counter(map(tuple, left.join(right, cond, how).drop("rk").collect()))
    assert Counter(map(tuple, skew.salted_join(left, right, [("key", "rk")], how, null_safe, least_rows=0).collect())) == want
    assert Counter(map(tuple, skew.salted_join(left, right, [("key", "rk")], how, null_safe).collect())) == want  # too few rows to salt
    assert Counter(map(tuple, skew.measured_join(left, right, [("key", "rk")], how, null_safe).collect())) == want


def test_no_task_has_twice_the_mean(spark, no_broadcast):
    left = hot_rows(spark)
    right = left.select(F.col("key").alias("rk")).distinct().withColumn("w", F.length("rk"))
    out = skew.salted_join(left, right, [("key", "rk")], least_rows=0)
    rows = lambda df: [r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum("w")).collect()]
    sizes = rows(out)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(sizes) == 20_000 and max(sizes) <= 2 * 20_000 / parts
    plain = left.join(right, left["key"] == right["rk"], "left")
    assert max(rows(plain)) > 0.8 * 20_000  # what it is for


def test_hot_keys_are_few_whatever_the_data(spark):
    hot, piece = skew.hot_keys(hot_rows(spark), ["key"], 8)
    rows = {r._h0: r._salts for r in hot.collect()}
    assert len(rows) <= 8 * skew.CHUNKS and rows["hot"] == -(-18_000 // piece) and None in rows
    even = spark.range(1000).select((F.col("id") % 500).alias("key"))
    assert skew.hot_keys(even, ["key"], 8)[0] is None
    assert skew.hot_keys(even.limit(0), ["key"], 8)[0] is None


def test_group_total_of_a_hot_group(spark, no_broadcast, monkeypatch):
    monkeypatch.setattr(skew.salted_join, "__defaults__", ("left", False, 0))
    out = {r.key: (r.n, r.t) for r in group_total(hot_rows(spark, 2000), ["key"], "v", "t").groupBy("key").agg(
        F.count("*").alias("n"), F.max("t").alias("t")).collect()}
    want = {r.key: (r.n, r.t) for r in hot_rows(spark, 2000).groupBy("key").agg(F.count("*").alias("n"), F.sum("v").alias("t")).collect()}
    assert out == want and out["hot"][0] == 1800 and None in out


@pytest.mark.parametrize("max_rows", [10_000, 40])
def test_an_event_in_many_files_keeps_the_same_last_row(spark, tmpdir_path, max_rows):
    names = F.concat(F.lit("e"), (F.col("id") % 70).cast("string"))
    source = F.when(F.col("id") % 10 < 9, "2024_Hot_Event_results.csv").otherwise("2023_Cold_results.csv")
    rows = spark.range(1000).select(names.alias("FullName"), F.col("id").cast("string").alias("Position"), F.col("id").alias("at"), source.alias("Source"))
    SK.write_bronze(rows.repartition(6), tmpdir_path, order_by=["at"], max_rows=max_rows)
    raw = scan_bronze(spark, tmpdir_path)
    assert "RowOrdinal" not in raw.columns and raw.count() == 1000
    files = raw.filter("Circuit = 'Hot Event'").select("_row.path").distinct().count()
    assert files >= 900 // max_rows
    per_file = raw.groupBy("_row.path").count().agg(F.max("count")).first()[0]
    assert per_file <= max_rows
    last = {(r.Circuit, r.FullName): int(r.Position) for r in keep_last(raw, ["Year", "Circuit", "FullName"], ["Source", "_row"]).collect()}
    want = {}
    for i in range(1000):
        want[("Hot Event" if i % 10 < 9 else "Cold", f"e{i % 70}")] = i
    assert last == want


def test_a_later_batch_is_last(spark, tmpdir_path):
    one = spark.createDataFrame([("a", "1"), ("b", "2")] * 20, "FullName string, Position string").withColumn("Source", F.lit("2024_X_results.csv"))
    SK.write_bronze(one, tmpdir_path)
    SK.write_bronze(one.filter("FullName = 'a'").limit(1).withColumn("Position", F.lit("9")), tmpdir_path, mode="append", batch=1)
    last = keep_last(scan_bronze(spark, tmpdir_path, min_bytes=0), ["FullName"], ["Source", "_row"])
    assert {r.FullName: r.Position for r in last.collect()} == {"a": "9", "b": "2"}
