"""As-of join and moving deadlines against a pass over all changes."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ranklab.operators import ledger as LG
from ranklab.operators import schedule as SC
from ranklab.operators.asof import asof_join

START = datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else START + timedelta(minutes=minutes)


def in_force(changes, key, time):
    """The value of the last change of ``key`` not after ``time``."""
    if key is None:
        return None
    low = datetime(1, 1, 1)
    hit = [(t or low, tie, v) for k, t, tie, v in changes if k == key and (t is None or (time is not None and t <= time))]
    return max(hit, key=lambda x: x[:2])[2] if hit else None


@pytest.mark.parametrize("skew_safe", [False, True])
def test_asof_join(spark, skew_safe):
    rng = random.Random(2)
    keys = ["hot"] * 8 + ["a", "b", "none", None]  # two thirds of the rows share a key
    changes = [(rng.choice(["hot", "hot", "a", "b", None]), at(rng.randrange(0, 300, 5)), i, rng.choice([None, rng.randrange(100)])) for i in range(120)]
    changes += [("a", None, 500, -1), ("b", at(100), 501, 7), ("b", at(100), 502, 8)]
    rows = [(i, rng.choice(keys), at(rng.choice([None, *range(0, 300)]))) for i in range(400)] + [(900, "b", at(100)), (901, "none", at(5))]
    left = spark.createDataFrame(rows, "id int, key string, ts timestamp").withColumns({"_val": F.lit("x"), "_side": F.lit(3)})
    right = spark.createDataFrame(changes, "key string, since timestamp, seq int, v int")
    out = asof_join(left, right, ["key"], "ts", "since", {"value": "v"}, ["seq"], skew_safe)
    assert out.columns == [*left.columns, "value"]
    got = {r.id: r.value for r in out.collect()}
    assert got == {i: in_force(changes, k, t) for i, k, t in rows} and out.count() == len(rows)
    assert asof_join(left, right.limit(0), ["key"], "ts", "since", {"value": "v"}, ["seq"], skew_safe).filter("value is not null").count() == 0
    assert asof_join(left.limit(0), right, ["key"], "ts", "since", {"value": "v"}, ["seq"], skew_safe).count() == 0


def test_sliced_plan_windows_no_key_whole(spark):
    rows = spark.range(5000).select(F.lit("hot").alias("key"), F.timestamp_seconds("id").alias("ts"))
    changes = rows.where("unix_timestamp(ts) % 50 = 0").withColumnRenamed("ts", "since").withColumn("v", F.unix_timestamp("since"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is tiny
    try:
        out = asof_join(rows, changes, ["key"], "ts", "since", {"v": "v"}, skew_safe=True)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out.filter("v <> unix_timestamp(ts) - unix_timestamp(ts) % 50").count() == 0 and out.count() == 5000
    plan = out._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.splitlines() if " Window " in x]
    assert any("_slice" in x for x in windows)
    assert len(sizes) > 3 and max(sizes) < 3000  # the hot key is spread


def test_a_clashing_name_raises(spark):
    left = spark.createDataFrame([(1, START)], "k int, ts timestamp")
    with pytest.raises(ValueError):
        asof_join(left, left, ["k"], "ts", "ts", {"ts": "ts"})


def test_moved_missing_and_withdrawn_deadlines(spark):
    subs = spark.createDataFrame([(i, 1, at(m), day) for i, (m, day) in enumerate(
        [(0, "d1"), (60, "d1"), (200, "d1"), (10, "d2"), (500, "d2"), (5, "d3"), (100, "d4")])], "event_id long, user_id long, ts timestamp, day string")
    changes = spark.createDataFrame([
        ("d1", at(0), at(90), 1), ("d1", at(50), at(55), 2),          # moved to before the second submission, which is late
        ("d2", at(0), at(20), 3), ("d2", at(400), None, 4),           # withdrawn: open again
        ("d4", at(100), at(100), 5)],                                  # in force from that moment on, and already over
        "day string, valid_from timestamp, lock_deadline timestamp, event_id long")
    got = {r.day: (r.event_id, r.lock_deadline) for r in LG.effective_predictions_asof(subs, changes).collect()}
    assert got == {"d1": (0, at(90)), "d2": (4, None), "d3": (5, None)}


def test_deadlines_of_published_sessions(spark):
    sched = spark.createDataFrame([(2024, 1, "One", datetime(2024, 3, 3)), (2024, 2, "Two", datetime(2024, 3, 10))],
                                  "Year int, round_number int, race_name string, event_date timestamp")
    published = spark.createDataFrame([(2024, 1, datetime(2024, 2, 1), datetime(2024, 3, 1, 10)), (2024, 1, datetime(2024, 2, 20), None)],
                                      "Year int, round_number int, published_at timestamp, fp1_start_utc timestamp")
    history = SC.deadline_history(sched, published, buffer_minutes=30)
    asks = spark.createDataFrame([("One", datetime(2024, 1, 1)), ("One", datetime(2024, 2, 1)), ("One", datetime(2024, 2, 25)), ("Two", datetime(2024, 2, 1))],
                                 "race_name string, ts timestamp")
    out = asof_join(asks, history, ["race_name"], "ts", "valid_from", {"lock_deadline": "lock_deadline"})
    got = {(r.race_name, r.ts): r.lock_deadline for r in out.collect()}
    assert got == {("One", datetime(2024, 1, 1)): datetime(2024, 2, 29, 23, 30), ("One", datetime(2024, 2, 1)): datetime(2024, 3, 1, 9, 30),
                   ("One", datetime(2024, 2, 25)): datetime(2024, 2, 29, 23, 30), ("Two", datetime(2024, 2, 1)): datetime(2024, 3, 7, 23, 30)}
