"""Prediction ledger as batch DataFrame operations (OPS1-OPS6, AGG20-22,
TXT4-5, JON5).

The reference keeps one row per (user, event) in an OLTP table and mutates it
per click. Here a ledger is a DataFrame: submissions are merged in batch with
windows per key, locks come from deadlines, payloads are typed arrays/maps
(JSON only at the edge), and scoring runs for every locked prediction at once.
Payload lists are bounded (top 10), so ``collect_list`` per key stays small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklab.functions.columns import half_even
from ranklab.operators.ranking import materialize, rank_within, top_k_within
from ranklab.operators.scoring import score_orders, summary_text
from ranklab.operators.skew import measured_join
from ranklab.sources import partitions as PT

# --- fixed values -----------------------------------------------------------
STRATEGY_USERS = ((1, "by_grid"), (2, "by_form"), (3, "by_champ"))
STATUS_LOCKED = "🔒 Locked — awaiting race result"
STATUS_DRAFT = "📝 Draft"
MEDALS = ("🥇", "🥈", "🥉")
# ---------------------------------------------------------------------------

TOP_N = 10
EVENT = ["Year", "Circuit"]


def key_band(key: str) -> F.Column:
    """A coarse place of a strategy key: never falls as the key grows (up to 1:
    0, then by powers of two; NaN and null last, as they sort)."""
    k = F.col(key)
    return (F.when(k.isNull(), 5000).when(F.isnan(k), 4000).when(k <= 1, 0)
            .otherwise(F.floor(F.least(F.log2(k), F.lit(2000.0))).cast("int")))


def strategy_predictions(gold: DataFrame, top_n: int | None = TOP_N) -> DataFrame:
    """Three simple forecasters ("users") ranking each event's field by the
    grid, by recent form and by championship position. ``prob`` is the
    entrant's share of the strategy score in the event (WIN14). Columns:
    user_id, Year, Circuit, pos, driver, team, prob. ``top_n=None``: the whole
    field's probabilities as rows, without places (OPS6)."""
    specs = {
        1: F.col("GridPosition"),
        2: F.coalesce(F.col("AvgFinishLast5"), F.lit(99.0)),
        3: F.col("ChampPos"),
    }
    users = F.array(*[F.struct(F.lit(uid).alias("user_id"), key.cast("double").alias("_key")) for uid, key in specs.items()])
    rows = gold.select(*EVENT, F.col("FullName").alias("driver"), F.col("TeamName").alias("team"), F.explode(users).alias("_u"))
    rows = rows.select("_u.user_id", *EVENT, "driver", "team", "_u._key")
    rows = rows.withColumn("_score", 1.0 / F.greatest(F.col("_key"), F.lit(1.0))).withColumn("_band", key_band("_key"))
    keys = ["user_id", *EVENT]
    # a few dozen bands an event: their sums give the event's total, their counts the band that holds the top_n-th row
    bands = materialize(rows.groupBy(*keys, "_band").agg(F.sum("_score").alias("_s"), F.count(F.lit(1)).alias("_n")))
    before = Window.partitionBy(*keys).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.when(F.coalesce(F.col("_before"), F.lit(0)) < (top_n or 0), F.col("_band"))
    totals = (bands.withColumn("_before", F.sum("_n").over(before)).groupBy(*[F.col(k).alias(f"_g_{k}") for k in keys])
              .agg(F.sum("_s").alias("_total"), F.max(reach).alias("_reach")))
    rows = measured_join(rows, totals, [(k, f"_g_{k}") for k in keys], null_safe=True)
    if top_n is not None:  # only these rows can be among the first top_n: the others are not sorted
        rows = rows.filter(F.col("_band") <= F.col("_reach"))
    rows = rows.withColumn("prob", half_even(F.col("_score") / F.col("_total"), 4))
    if top_n is None:
        return rows.select("user_id", *EVENT, "driver", "team", "prob")
    top = top_k_within(rows, ["user_id", *EVENT], [("_key", False), ("driver", False)], top_n, out="pos")
    return top.select("user_id", *EVENT, "pos", "driver", "team", "prob")


def payloads(preds: DataFrame, keys: Sequence[str] = ("user_id", "Year", "Circuit")) -> DataFrame:
    """OPS6: ordered top-10 array<struct<pos,driver,team,prob>> and the
    name -> prob map of that list per prediction (both bounded by the list
    length); of equal names the last place's probability stands. The whole
    field's probabilities are rows: ``field_probabilities``."""
    lists = preds.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("pos", "driver", "team", "prob"))).alias("top10"))
    last = F.filter("top10", lambda x: ~F.exists("top10", lambda y: y["driver"].eqNullSafe(x["driver"]) & (y["pos"] > x["pos"])))
    named = F.filter(last, lambda x: x["driver"].isNotNull())
    return lists.withColumn("win_probs", F.map_from_entries(F.array_sort(
        F.transform(named, lambda x: F.struct(x["driver"].alias("driver"), x["prob"].alias("prob"))))))


def field_probabilities(gold: DataFrame) -> DataFrame:
    """OPS6: the whole field's name -> prob entries of every prediction, as
    rows, for an event's field is not bounded. An entry a name: of equal names
    the last place's probability stands (a combined aggregate)."""
    rows = strategy_predictions(gold, top_n=None)
    return (rows.groupBy("user_id", *EVENT, "driver")
            .agg(F.max_by(F.struct("team", "prob"), F.struct(-F.col("prob"), "team")).alias("_last"))
            .select("user_id", *EVENT, "driver", "_last.team", "_last.prob"))


def strategy_ledger(gold: DataFrame, deadlines: DataFrame) -> DataFrame:
    """Locked, unscored ledger rows for every (strategy user, event): saved
    one hour before the deadline, locked at it."""
    pay = payloads(strategy_predictions(gold))
    d = deadlines.select(F.col("Year").alias("_y"), F.col("race_name").alias("_c"), "round_number",
                         "lock_deadline", "fp1_start_utc")
    j = pay.join(d, (pay["Year"] == d["_y"]) & (pay["Circuit"] == d["_c"]))
    return j.select(
        "user_id", F.col("Circuit").alias("race_name"), F.col("Year").alias("year"), "round_number",
        (F.col("lock_deadline") - F.expr("INTERVAL 1 HOUR")).alias("predicted_at"),
        F.lit(True).alias("is_locked"), F.col("lock_deadline").alias("locked_at"), "fp1_start_utc",
        "top10", "win_probs", F.lit(None).cast("timestamp").alias("scored_at"))


def actual_orders(silver: DataFrame, cap: int = 20) -> DataFrame:
    """OPS3 actual order: rows with a finish sorted ascending, the first
    ``cap`` rows; the rank is the place in that list (finishes may have gaps
    where rows were dropped). A per-event top-k: partial WindowGroupLimit.
    (Year, Circuit, ap, driver)."""
    done = silver.filter(F.col("Position").isNotNull())
    top = top_k_within(done, EVENT, [("Position", False), ("FullName", False)], cap, out="ap")
    return top.select(*EVENT, "ap", F.col("FullName").alias("driver"))


def score_ledger(ledger: DataFrame, silver: DataFrame, as_of: str) -> DataFrame:
    """OPS3/EVL4/JON8: score all locked, unscored predictions of every event
    and write the metrics, the actual top list and ``scored_at`` back."""
    todo = ledger.filter(F.col("is_locked") & F.col("scored_at").isNull())
    keys = ["user_id", "year", "race_name"]
    pred = todo.select(*keys, F.posexplode("top10").alias("_i", "_e")).select(
        *keys, (F.col("_i") + 1).alias("pp"), F.col("_e.driver").alias("driver"))
    act = actual_orders(silver).withColumnsRenamed({"Year": "year", "Circuit": "race_name"})
    scores = score_orders(pred, act, ["user_id"], ["year", "race_name"],
                          headers=todo.select(*keys))
    # a stored ledger has empty score columns for these rows
    todo = todo.drop(*[c for c in scores.columns if c not in keys], "actual_top10")
    act_list = (act.groupBy("year", "race_name")
                .agg(F.transform(F.array_sort(F.collect_list(F.struct("ap", "driver"))),
                                 lambda x: x["driver"]).alias("actual_top10")))
    done = (todo.drop("scored_at").join(scores, keys, "left").join(act_list, ["year", "race_name"], "left")
            .withColumn("scored_at", F.when(F.col("winner_correct").isNotNull(),
                                            F.to_timestamp(F.lit(as_of)))))
    return done


def write_back(ledger: DataFrame, scored: DataFrame) -> DataFrame:
    """OPS3: the ledger with the rows that ``score_ledger`` has scored in place
    of their former state; rows without a result stay unscored."""
    keys = ["user_id", "year", "race_name"]
    done = scored.filter(F.col("scored_at").isNotNull())
    return ledger.join(done.select(*keys), keys, "left_anti").unionByName(done, allowMissingColumns=True)


def status_label(scored: DataFrame) -> DataFrame:
    """TXT4: score summary when scored, else locked/draft label."""
    if "winner_correct" not in scored.columns:
        return scored.withColumn("status", F.when(F.col("is_locked"), F.lit(STATUS_LOCKED))
                                 .otherwise(F.lit(STATUS_DRAFT)))
    s = summary_text(scored)
    return s.withColumn("status", F.when(F.col("scored_at").isNotNull(), F.col("summary"))
                        .when(F.col("is_locked"), F.lit(STATUS_LOCKED))
                        .otherwise(F.lit(STATUS_DRAFT))).drop("summary")


def users_from_customers(customers: DataFrame) -> DataFrame:
    """The user table (id, username, role, is_active) over the customer table."""
    return customers.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"),
                            F.lower("c_mktsegment").alias("role"),
                            (F.col("c_acctbal") >= 0).alias("is_active"))


def strategy_users(spark) -> DataFrame:
    """The strategy users as an inline table (JVM-side, no Python rows)."""
    values = ", ".join(f"({i}, '{n}')" for i, n in STRATEGY_USERS)
    return spark.sql(f"SELECT CAST(id AS INT) AS id, username FROM VALUES {values} AS t(id, username)")


def leaderboard(scored: DataFrame, users: DataFrame, skew_safe: bool | None = None) -> DataFrame:
    """AGG20/JON5/TXT5: per user over scored predictions; null hits count as
    0, null MAE/rho are skipped; ranked by mean podium hits (ties by name)."""
    s = scored.filter(F.col("scored_at").isNotNull())
    j = s.join(users, s["user_id"] == users["id"])
    agg = (j.groupBy("username")
           .agg(F.count(F.lit(1)).alias("races_scored"),
                F.sum(F.coalesce(F.col("winner_correct").cast("int"), F.lit(0))).cast("long")
                .alias("winners_correct"),
                F.avg(F.coalesce("podium_hits", F.lit(0))).alias("avg_podium_hits"),
                F.avg(F.coalesce("top10_hits", F.lit(0))).alias("avg_top10_hits"),
                F.avg("position_mae").alias("avg_position_mae"),
                F.avg("spearman_rho").alias("avg_spearman")))
    agg = materialize(agg)  # the ranking's size check must not run the scoring again
    ranked = rank_within(agg, [], [("avg_podium_hits", True), ("username", False)], out="rank",
                         method="row_number", skew_safe=skew_safe)
    medal = F.element_at(F.array(*[F.lit(m) for m in MEDALS]), F.col("rank"))
    return ranked.withColumn("medal", F.when(F.col("rank") <= 3, medal)
                             .otherwise(F.col("rank").cast("string")))


def personal_summary(scored: DataFrame) -> DataFrame:
    """AGG21: per user: winners correct / scored count, mean podium hits,
    mean rho."""
    s = scored.filter(F.col("scored_at").isNotNull())
    return (s.groupBy("user_id")
            .agg(F.sum(F.col("winner_correct").cast("int")).cast("long").alias("winners_correct"),
                 F.count(F.lit(1)).alias("scored"),
                 F.avg("podium_hits").alias("avg_podium_hits"),
                 F.avg("spearman_rho").alias("avg_spearman")))


def user_history(ledger: DataFrame) -> DataFrame:
    """OPS4: every user's predictions by year and round, payload as JSON text
    (the reference's row shape)."""
    return (status_label(ledger)
            .select("user_id", "race_name", "year", "round_number", "predicted_at", "is_locked",
                    F.to_json("top10").alias("top10_json"), "status")
            .orderBy("user_id", "year", "round_number"))


# --- submissions from the events table ----------------------------------------

def submissions(events: DataFrame) -> DataFrame:
    """Prediction submissions keyed (user_id, day): clicks are drafts, a
    purchase locks. The prediction value sits in ``value``, extra fields in
    the JSON ``props``."""
    # one timestamp type for all ledger times (the table may store ts without
    # a zone; the session is UTC, so the values do not change)
    return (events.filter(F.col("event_type").isin("click", "purchase"))
            .withColumn("ts", F.col("ts").cast("timestamp"))
            .select("event_id", "user_id", F.to_date("ts").alias("day"), "ts", "event_type", "value",
                    F.from_json("props", "k int")["k"].alias("k")))


def deadline_of(day_col: str = "day") -> F.Column:
    """Deadline of a day's prediction: noon UTC of that day."""
    return F.to_timestamp(F.col(day_col)) + F.expr("INTERVAL 12 HOURS")


def effective_predictions(subs: DataFrame, deadlines: DataFrame | None = None) -> DataFrame:
    """OPS2: per key the latest submission strictly before the deadline
    (ties by larger event_id). A keep-last aggregation (map-side combine),
    so one user-day with a flood of submissions stays cheap. ``deadlines``
    (day, lock_deadline; one row a day, noon without it) may lack a day or hold
    null: such a day stays open (Q16)."""
    from ranklab.operators.ranking import broadcast_if_small
    from ranklab.operators.silver import keep_last
    if deadlines is None:
        timed = subs.withColumn("lock_deadline", deadline_of())
    else:
        timed = subs.join(broadcast_if_small(deadlines.select("day", "lock_deadline")), "day", "left").select(*subs.columns, "lock_deadline")
    ok = timed.filter(F.col("lock_deadline").isNull() | (F.col("ts") < F.col("lock_deadline")))
    return keep_last(ok, ["user_id", "day"], ["ts", "event_id"])


def effective_predictions_asof(subs: DataFrame, changes: DataFrame, skew_safe: bool | None = None) -> DataFrame:
    """OPS2 with deadlines that move: a submission is accepted when it came
    strictly before the deadline that was in force at its time, and the latest
    accepted one of a key is effective. ``changes`` (day, valid_from,
    lock_deadline, event_id): from ``valid_from`` on the day's deadline is
    ``lock_deadline``; null withdraws it. A day without a deadline in force is
    open (Q16). A day's submissions of all users share its changes, so days are
    the hot keys of this join."""
    from ranklab.operators.asof import asof_join
    from ranklab.operators.silver import keep_last
    timed = asof_join(subs, changes, ["day"], "ts", "valid_from", {"lock_deadline": "lock_deadline"}, ["event_id"], skew_safe)
    ok = timed.filter(F.col("lock_deadline").isNull() | (F.col("ts") < F.col("lock_deadline")))
    return keep_last(ok, ["user_id", "day"], ["ts", "event_id"])


def announced_deadlines(events: DataFrame) -> DataFrame:
    """Deadline changes out of the events table: every day begins with noon
    UTC, but for days of the month that seven divides, which begin without a
    deadline; each signup announces a new one, up to six hours earlier or
    later, or (k divisible by ten) withdraws it."""
    ev = events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("day", F.to_date("ts"))
    first = (ev.filter(F.dayofmonth("day") % 7 != 0).select("day").distinct()
             .select("day", F.col("day").cast("timestamp").alias("valid_from"), deadline_of().alias("lock_deadline"),
                     F.lit(-1).cast("long").alias("event_id")))
    k = F.from_json("props", "k int")["k"]
    moved = deadline_of() + F.make_interval(hours=k % 13 - 6)
    news = ev.filter(F.col("event_type") == "signup").select(
        "day", F.col("ts").alias("valid_from"), F.when(k % 10 != 0, moved).alias("lock_deadline"), "event_id")
    return first.unionByName(news)


def locks_of(subs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """(user_id, day, locked_at): the first purchase of a key, or the lock that
    the stored ledger already has."""
    locks = subs.filter(F.col("event_type") == "purchase").select("user_id", "day", F.col("ts").alias("locked_at"))
    if ledger is not None:
        locks = locks.unionByName(ledger.filter(F.col("locked_at").isNotNull()).select("user_id", "day", "locked_at"))
    return locks.groupBy("user_id", "day").agg(F.min("locked_at").alias("locked_at"))


def upsert_ledger(subs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """OPS1 against a stored ledger (user_id, day, event_id, ts, value,
    locked_at): the ledger after a batch of submissions. A lock that is stored
    rejects later drafts; a stored draft has been accepted and stays until a
    newer one is accepted. Batches come in the order of time."""
    row = ["event_id", "ts", "value"]
    new = (merge_submissions(subs, ledger).filter(F.col("status") == "accepted")
           .groupBy("user_id", "day").agg(F.max_by(F.struct(*row), F.struct("ts", "event_id")).alias("_draft")))
    if ledger is not None:
        held = ledger.filter(F.col("event_id").isNotNull()).select("user_id", "day", F.struct(*row).alias("_draft"))
        new = (new.unionByName(held).groupBy("user_id", "day")
               .agg(F.max_by("_draft", F.struct("_draft.ts", "_draft.event_id")).alias("_draft")))
    return (new.join(locks_of(subs, ledger), ["user_id", "day"], "full")
            .select("user_id", "day", *[F.col(f"_draft.{c}").alias(c) for c in row], "locked_at"))


def upsert_stored(subs: DataFrame, root: str) -> PT.Version:
    """OPS1 on a ledger stored by day (``sources.partitions``): of the stored
    ledger only the days of this batch are read, and only they are written.
    Raises ``BaseMoved`` when another batch was merged meanwhile; calling it
    again then merges with that one's rows."""
    spark = subs.sparkSession
    base = PT.current(spark, root)
    held = None if base is None else PT.read(spark, root, keys=subs.select("day"), at=base)
    return PT.commit(upsert_ledger(subs, held), root, ["day"], base)


def write_back_stored(spark, root: str, silver: DataFrame, as_of: str) -> PT.Version | None:
    """OPS3 on a prediction ledger stored by (year, race_name): reads the
    events that ``silver`` has results of, scores their locked, unscored rows
    and rewrites the events of which a row was scored. None: nothing to score."""
    base = PT.current(spark, root)
    if base is None:
        return None
    events = silver.select(F.col("Year").alias("year"), F.col("Circuit").alias("race_name")).distinct()
    held = PT.read(spark, root, keys=events, at=base)
    scored = materialize(score_ledger(held, silver, as_of).filter(F.col("scored_at").isNotNull()))
    if scored.isEmpty():
        return None
    whole = PT.read(spark, root, keys=scored.select("year", "race_name"), at=base)
    return PT.commit(write_back(whole, scored), root, ["year", "race_name"], base)


def merge_submissions(subs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """OPS1: batch upsert. A key is locked from its first purchase on, or from
    the lock in the stored ``ledger``; a draft (click) at or after that moment
    is rejected, earlier drafts are accepted and the last accepted one is the
    stored draft."""
    locks = locks_of(subs, ledger)
    drafts = subs.filter(F.col("event_type") == "click").join(locks, ["user_id", "day"], "left")
    rejected = F.col("locked_at").isNotNull() & (F.col("ts") >= F.col("locked_at"))
    decided = (drafts.withColumn("status", F.when(rejected, "rejected").otherwise("accepted"))
               .withColumn("reason", F.when(rejected, "locked")))
    # the stored draft per key: the last accepted one (aggregate, then join)
    stored = (decided.filter(F.col("status") == "accepted").groupBy("user_id", "day")
              .agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("_stored")))
    return (decided.join(stored, ["user_id", "day"], "left")
            .withColumn("is_stored", F.coalesce(F.col("event_id") == F.col("_stored"), F.lit(False)))
            .select("user_id", "day", "event_id", "ts", "value", "status", "reason", "is_stored",
                    "locked_at"))


def admin_listing(effective: DataFrame, users: DataFrame) -> DataFrame:
    """OPS5/JON5: every effective prediction with its user name (inner join)."""
    return (effective.join(users, effective["user_id"] == users["id"], "inner")
            .select("user_id", "username", "day", "event_id", "ts", "value", "k", "lock_deadline")
            .orderBy("day", "user_id"))


def locked_count(subs: DataFrame) -> DataFrame:
    """AGG22: number of locked predictions (keys with a purchase)."""
    return (subs.filter(F.col("event_type") == "purchase")
            .agg(F.count_distinct("user_id", "day").alias("locked_predictions")))
