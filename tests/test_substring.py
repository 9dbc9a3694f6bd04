"""Substring index, mergeable sketches, an error for an unknown event name."""

import pytest
from pyspark.sql import functions as F

from ranklab.operators import forecast as FC
from ranklab.operators import schedule as SC
from ranklab.operators import standings as ST
from ranklab.operators.substring import containing

TEXTS = ["Monaco", "monte carlo", "Spa", "São Paulo", "a", "", "Aaaa", "100% Ring_x", "İstanbul", "Brand#12", "Brand#1", None]
WORDS = ["mon", "mo", "o", "", "spa", "sp", "são", "aaa", "aaaaa", "%", "_", "100% r", "brand#1", "ring", "zz", "Spa", "日本", None]


def test_index_equals_all_pairs(spark):
    texts = spark.createDataFrame([(t,) for t in TEXTS], "t string").distinct()
    words = spark.createDataFrame([(w,) for w in WORDS + WORDS], "w string")
    got = sorted((r.t, r.w) for r in containing(texts, "t", words, "w").collect())
    pairs = texts.join(words.distinct(), F.lower("t").contains(F.col("w")))
    assert got == sorted((r.t, r.w) for r in pairs.collect()) and len(got) > len(TEXTS)
    assert containing(texts.limit(0), "t", words, "w").isEmpty()
    assert containing(texts, "t", words.limit(0), "w").isEmpty()


def test_circuits_of_a_million_targets_without_nested_loops(spark):
    hist = spark.range(3000).select(F.concat(F.lit("Ring "), F.hex("id")).alias("Circuit"))
    name = F.when(F.col("id") % 4 == 0, F.lit("nowhere")).otherwise(F.concat(F.lit("B"), F.hex(F.col("id") % 300), F.lit(" GP")))
    targets = spark.range(1_000_000).select(F.lit(2024).alias(FC.TARGET[0]), F.lit(1).alias("n"), name.alias("Circuit"), "id")
    extra = [c for c in FC.TARGET if c not in targets.columns]
    targets = targets.select("*", *[F.col("id").cast("int").alias(c) for c in extra])
    got = FC.circuit_matches(hist, targets)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    counts = {r.w: r["count"] for r in got.groupBy(F.lower(F.split("Circuit", " ")[0]).alias("w")).count().collect()}
    circuits = [f"ring {i:x}" for i in range(3000)]
    want = {}
    for i in range(300):
        w = f"b{i:x}"
        asked = sum(1 for k in range(i, 1_000_000, 300) if k % 4)
        held = sum(w in c for c in circuits)
        if asked and held:
            want[w] = want.get(w, 0) + asked * held
    assert counts == want and "nowhere" not in counts


def test_sketches_merge(spark):
    rows = (spark.range(60_000).select((F.col("id") % 3 + 2000).cast("int").alias("Year"), F.concat(F.lit("c"), F.col("id") % 5).alias("Circuit"),
                                       F.concat(F.lit("e"), F.col("id") % 20_000).alias("FullName")))
    dup = rows.unionByName(rows).unionByName(spark.sql("SELECT 2000 AS Year, 'c9' AS Circuit, CAST(NULL AS STRING) AS FullName"))
    est = {(r.Level, r.Year, r.Circuit): r.Estimate for r in ST.rollup_distinct(ST.event_sketches(dup)).collect()}
    assert est[(0, 2000, "c9")] == 0 and abs(est[(2, None, None)] - 20_000) <= 400
    for year in (2000, 2001, 2002):
        exact = rows.filter(F.col("Year") == year).select("FullName").distinct().count()
        assert abs(est[(1, year, None)] - exact) <= 0.02 * exact
    assert [tuple(r) for r in ST.rollup_distinct(ST.event_sketches(rows.limit(0))).collect()] == [(2, None, None, 0)]


def test_unknown_event_name_raises(spark):
    sched = spark.createDataFrame([(2024, 1, "Monaco"), (2024, 2, "Monza"), (2023, 5, "Old Mon")], "Year int, round_number int, race_name string")
    assert sorted((r.Year, r.race_name) for r in SC.find_event(sched, "MON", required=True).collect()) == [(2023, "Old Mon"), (2024, "Monaco")]
    with pytest.raises(LookupError, match="m.n"):
        SC.find_event(sched, "m.n", required=True)
    assert SC.find_event(sched, "m.n").isEmpty()
