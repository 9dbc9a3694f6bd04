"""Scoring, lock and leaderboard edge cases (FIXTURES C7-C11)."""

import pytest
from pyspark.sql import functions as F

from ranklab.operators import ledger as LG
from ranklab.operators import schedule as SC
from ranklab.operators.scoring import score_orders, summary_text


def _lists(spark, pred: dict, actual: dict):
    p = [(k, "E", i + 1, n) for k, names in pred.items() for i, n in enumerate(names)]
    a = [("E", i + 1, n) for n in [] for i in []] + [(e, i + 1, n) for e, names in actual.items()
                                                    for i, n in enumerate(names)]
    pdf = spark.createDataFrame(p, "pid string, ev string, pp int, driver string") if p else \
        spark.createDataFrame([], "pid string, ev string, pp int, driver string")
    adf = spark.createDataFrame(a, "ev string, ap int, driver string") if a else \
        spark.createDataFrame([], "ev string, ap int, driver string")
    heads = spark.createDataFrame([(k, "E") for k in pred], "pid string, ev string")
    out = score_orders(pdf, adf, ["pid"], ["ev"], headers=heads)
    return {r.pid: r for r in out.collect()}


def test_score_cases(spark):
    act = list("ABCDEFGHIJKL")
    res = _lists(spark, {
        "same": act, "rev": act[::-1], "one": ["A", "X"], "none": ["X", "Y", "Z"],
        "long": list("ABCDEFGHIJKLMNOPQRSTUVWXY"), "empty": []}, {"E": act})
    s = res["same"]
    assert (s.winner_correct, s.podium_hits, s.top10_hits, s.position_mae, s.spearman_rho) == (True, 3, 10, 0.0, 1.0)
    assert res["rev"].spearman_rho == -1.0 and res["rev"].winner_correct is False
    assert res["one"].spearman_rho is None and res["one"].position_mae == 0.0
    n = res["none"]  # no common name: the row survives with zeros and a null rho
    assert (n.winner_correct, n.podium_hits, n.top10_hits, n.position_mae, n.spearman_rho) == (False, 0, 0, 0.0, None)
    assert res["long"].top10_hits == 10  # cut to 20, extra names ignored
    e = res["empty"]
    assert (e.winner_correct, e.podium_hits, e.position_mae, e.spearman_rho) == (None, None, None, None)


def test_spearman_raw_ranks_clamped(spark):
    r = _lists(spark, {"p": ["A", "B", "C"]}, {"E": ["C", "X", "Y", "Z", "A"]})["p"]
    # common A(1 vs 5), C(3 vs 1): d2 = 16 + 4 = 20, n = 2 -> 1 - 120/6 = -19 -> clamp -1
    assert r.spearman_rho == -1.0 and r.position_mae == 3.0


def test_summary_text(spark):
    df = spark.createDataFrame([(True, 2, 7, 1.25, None), (None, None, None, None, None)],
                               "winner_correct boolean, podium_hits int, top10_hits int, "
                               "position_mae double, spearman_rho double")
    t = [r.summary for r in summary_text(df).collect()]
    assert t[0] == "Winner ✅ | Podium: 2/3 | Top-10: 7/10 | Pos MAE: 1.2 | Spearman ρ: n/a"
    assert t[1] == "Not yet scored."


def test_lock_deadlines(spark):
    sched = spark.createDataFrame(
        [(2024, 1, "A", "2024-03-10 15:00:00", False), (2024, 2, "B", "2024-03-24 15:00:00", True),
         (2024, 3, "C", None, False)],
        "Year int, round_number int, race_name string, event_date string, is_sprint boolean"
    ).withColumn("event_date", F.to_timestamp("event_date"))
    d = {r.race_name: r for r in SC.lock_state(SC.lock_deadlines(sched, buffer_minutes=30),
                                               "2024-03-08 14:30:00").collect()}
    assert str(d["A"].lock_deadline) == "2024-03-08 14:30:00"
    assert d["A"].is_locked is True          # exactly at the deadline: locked
    assert d["C"].is_locked is False         # unknown deadline stays open
    assert str(d["B"].lock_deadline) == "2024-03-23 02:00:00"  # first session 02:30 minus 30 min


def test_effective_prediction_strictly_before_deadline(spark):
    ev = spark.createDataFrame(
        [(1, "2024-01-05 11:59:59", 7, "click", 1.0, '{"k": 1}'),
         (2, "2024-01-05 12:00:00", 7, "click", 2.0, '{"k": 2}'),
         (3, "2024-01-05 10:00:00", 7, "purchase", 3.0, '{"k": 3}')],
        "event_id long, ts string, user_id long, event_type string, value double, props string"
    ).withColumn("ts", F.to_timestamp("ts"))
    subs = LG.submissions(ev)
    eff = LG.effective_predictions(subs).collect()
    assert len(eff) == 1 and eff[0].event_id == 1 and eff[0].k == 1
    merged = {r.event_id: r for r in LG.merge_submissions(subs).collect()}
    assert merged[1].status == "rejected" and merged[2].status == "rejected"


def test_leaderboard_nulls_and_ties(spark):
    scored = spark.createDataFrame(
        [(1, True, None, 5, 1.0, None, "2024-01-01"), (1, False, 3, 6, 2.0, 0.5, "2024-01-01"),
         (2, True, 1, 5, 1.0, 0.1, "2024-01-01"), (2, None, 2, 5, None, None, "2024-01-01")],
        "user_id int, winner_correct boolean, podium_hits int, top10_hits int, position_mae double, "
        "spearman_rho double, scored_at string")
    users = spark.createDataFrame([(1, "zed"), (2, "amy")], "id int, username string")
    lb = {r.username: r for r in LG.leaderboard(scored, users).collect()}
    assert lb["zed"].avg_podium_hits == 1.5 and lb["amy"].avg_podium_hits == 1.5
    assert lb["amy"].rank == 1 and lb["zed"].rank == 2          # tie broken by name
    assert lb["zed"].avg_spearman == 0.5                         # null skipped
    assert lb["amy"].winners_correct == 1 and lb["amy"].medal == "🥇"


def test_shares_zero_sum_and_single(spark):
    from ranklab.operators.forecast import two_stage_forecast, column_scorer
    feats = spark.createDataFrame(
        [(2024, "A", "X", "T", 5.0, 5.0, 0.0, 1.0, 0.0, 5.0)],
        "Year int, Circuit string, FullName string, TeamName string, AvgFinishLast5 double, "
        "AvgGridLast5 double, DNFRateLast10 double, ChampPos double, TeamForm double, CircuitAvgFinish double")
    out = two_stage_forecast(feats, winner=column_scorer(F.lit(0.0))).collect()[0]
    assert out.WinProbability is None and out.PodiumProbability == 100.0
    assert out.PredictedFinish == 1 and out.PredictedGrid == 1


def test_actual_order_is_list_place(spark):
    silver = spark.createDataFrame(
        [(2024, "A", "W", 7), (2024, "A", "X", 1), (2024, "A", "Y", 4), (2024, "A", "Z", 2),
         (2024, "A", "N", None)], "Year int, Circuit string, FullName string, Position int")
    got = {r.driver: r.ap for r in LG.actual_orders(silver).collect()}
    assert got == {"X": 1, "Z": 2, "Y": 3, "W": 4}
