"""ROC-AUC of all groups at once against a count of all pairs; payloads with equal names."""

import random

import pytest
from pyspark.sql import functions as F

from ranklab.operators import ledger as LG
from ranklab.operators import ml as ML


def auc(pairs):
    pos, neg = [p for y, p in pairs if y == 1], [p for y, p in pairs if y == 0]
    if not pos or not neg:
        return None
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_mann_whitney(spark):
    rng = random.Random(3)
    rows = [("hot", rng.randint(0, 1), rng.randrange(20) / 20) for _ in range(300)] + [("a", rng.randint(0, 1), rng.random()) for _ in range(40)]
    rows += [("one", 1, 0.5)] * 5 + [("none", 0, 0.1)] * 3 + [("ties", i % 2, 0.25) for i in range(10)]
    holes = [("a", None, 0.3), ("a", 1, None), (None, 1, 0.9), (None, 0, 0.2)]
    df = spark.createDataFrame(rows + holes, "model string, y int, p double")
    got = {r.model: r.roc_auc for r in ML.mann_whitney(df, "y", "p", ["model"]).collect()}
    want = {m: auc([(y, p) for k, y, p in rows if k == m]) for m in {r[0] for r in rows}} | {None: 1.0}
    assert got.keys() == want.keys() and got["one"] is None and got["none"] is None and got["ties"] == 0.5
    for m in want:
        assert got[m] == pytest.approx(want[m]) if want[m] is not None else got[m] is None
    alone = ML.mann_whitney(df.filter("model = 'hot'"), "y", "p").collect()
    assert [r.roc_auc for r in alone] == [pytest.approx(want["hot"])]


def test_evaluate_needs_no_evaluator(spark):
    df = spark.createDataFrame([("m", 1, 0.9), ("m", 0, 0.2), ("m", 0, 0.6), ("n", 1, 0.4)], "model string, y int, _p double")
    got = {r.model: (r.n_test, r.accuracy, r.precision, r.roc_auc) for r in ML.evaluate(df, "y", keys=["model"]).collect()}
    assert got == {"m": (3, 0.6667, 0.5, 1.0), "n": (1, 0.0, 0.0, None)}


def test_payload_of_equal_names(spark):
    rows = [(1, 2024, "X", 1, "Unknown", "t1", 0.5), (1, 2024, "X", 2, "A", "t2", 0.3), (1, 2024, "X", 3, "Unknown", "t3", 0.1), (1, 2024, "X", 4, None, "t4", 0.05)]
    preds = spark.createDataFrame(rows, "user_id int, Year int, Circuit string, pos int, driver string, team string, prob double")
    r = LG.payloads(preds).first()
    assert r.win_probs == {"Unknown": 0.1, "A": 0.3} and [x.driver for x in r.top10] == ["Unknown", "A", "Unknown", None]


def test_field_of_equal_names(spark):
    gold = spark.createDataFrame([(2024, "X", "Unknown", "t1", 1, None, 1), (2024, "X", "Unknown", "t2", 4, None, 2), (2024, "X", "A", "t3", 2, 3.0, 3)],
                                 "Year int, Circuit string, FullName string, TeamName string, GridPosition int, AvgFinishLast5 double, ChampPos int")
    out = LG.field_probabilities(gold).filter("user_id = 1").collect()
    assert {(r.driver, r.team) for r in out} == {("Unknown", "t2"), ("A", "t3")} and len(out) == 2
