"""Named queries: each is ``(spark, sf_dir) -> DataFrame`` over the whole
driver tables, paired with independent DuckDB oracle SQL (``None`` where the
result is not expressible in SQL, e.g. a fitted model)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklab.operators.ranking import materialize  # noqa: E402
from ranklab.operators import standings as ST
from ranklab.plans import oracle as O
from ranklab.plans.layers import SILVER_COLUMNS, gold_table, silver_from_tables


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    covers: tuple[str, ...]


REGISTRY: dict[str, Query] = {}


def register(name: str, oracle: str | None, *covers: str):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, oracle, covers)
        return fn
    return deco


S = O.SILVER


# --- layers ------------------------------------------------------------------

@register("silver_results", O.with_(S, 'SELECT "Year", "Circuit", "FullName", "TeamName", '
          '"Position", "GridPosition", "Points", "RaceIndex" FROM silver'),
          "CLN5", "CLN6", "JON1", "SET4")
def q_silver(spark, sf):
    return silver_from_tables(spark, sf).select(*SILVER_COLUMNS)


@register("gold_features", O.with_(O.GOLD, O.GOLD_SELECT),
          "WIN1", "WIN2", "WIN3", "WIN4", "WIN5", "WIN6", "WIN7", "WIN8", "CLN7", "CLN13",
          "JON2", "JON3", "Q9")
def q_gold(spark, sf):
    return gold_table(spark, sf)


# --- standings and analytics -------------------------------------------------

@register("entrant_form", O.with_(S, """SELECT "FullName", "TeamName",
  count("Position") AS starts, count(*) FILTER (WHERE "Position" = 1) AS wins,
  count(*) FILTER (WHERE "Position" <= 3) AS podiums, CAST(coalesce(sum("Points"), 0) AS BIGINT) AS points
FROM silver GROUP BY 1, 2"""), "AGG1")
def q_entrant_form(spark, sf):
    return ST.entrant_form(silver_from_tables(spark, sf))


STANDINGS_SQL = """standings AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY "Year" ORDER BY "Points" DESC, "FullName") AS INTEGER) AS "Standing",
         CAST(max("Points") OVER (PARTITION BY "Year") - "Points" AS BIGINT) AS "Gap"
  FROM (SELECT "Year", "FullName", CAST(coalesce(sum("Points"), 0) AS BIGINT) AS "Points",
          arg_max("TeamName", "RaceIndex") FILTER (WHERE "TeamName" IS NOT NULL) AS "TeamName",
          count(*) FILTER (WHERE "Position" = 1) AS "Wins", count(*) FILTER (WHERE "Position" <= 3) AS "Podiums",
          count("Position") AS "Races"
        FROM silver GROUP BY 1, 2) a)"""


@register("season_standings", O.with_(S + ",\n" + STANDINGS_SQL, "SELECT * FROM standings"),
          "AGG2", "AGG4", "WIN12", "WIN13")
def q_season_standings(spark, sf):
    return ST.season_standings(silver_from_tables(spark, sf))


@register("team_standings", O.with_(S, """SELECT *,
  CAST(row_number() OVER (PARTITION BY "Year" ORDER BY "Points" DESC, "TeamName") AS INTEGER) AS "Standing",
  CAST(max("Points") OVER (PARTITION BY "Year") - "Points" AS BIGINT) AS "Gap"
FROM (SELECT "Year", "TeamName", CAST(coalesce(sum("Points"), 0) AS BIGINT) AS "Points"
      FROM silver WHERE "TeamName" IS NOT NULL GROUP BY 1, 2) t"""), "AGG3")
def q_team_standings(spark, sf):
    return ST.team_standings(silver_from_tables(spark, sf))


@register("dnf_tally", O.with_(S, """SELECT *, round_even(CAST("DNFs" * 100 AS DOUBLE) / "Races", 1) AS "DNFRate"
FROM (SELECT "Year", "FullName", count("Position") AS "Races", count(*) FILTER (WHERE "Position" > 20) AS "DNFs"
      FROM silver GROUP BY 1, 2) t"""), "AGG5")
def q_dnf_tally(spark, sf):
    return ST.dnf_tally(silver_from_tables(spark, sf))


@register("career_summary", O.with_(S, """SELECT "FullName", count(*) AS "Races",
  count(*) FILTER (WHERE "Position" = 1) AS "Wins", count(*) FILTER (WHERE "Position" <= 3) AS "Podiums",
  count(*) FILTER (WHERE "Position" > 20) AS "DNFs", avg("Position") AS "AvgFinish", avg("GridPosition") AS "AvgGrid"
FROM silver GROUP BY 1"""), "AGG6")
def q_career(spark, sf):
    return ST.career_summary(silver_from_tables(spark, sf))


@register("entrant_circuit_average", O.with_(S, """SELECT "FullName", "Circuit", avg("Position") AS "AvgFinish"
FROM silver GROUP BY 1, 2"""), "AGG7")
def q_circuit_avg(spark, sf):
    return ST.circuit_average(silver_from_tables(spark, sf))


@register("team_circuit_average", O.with_(S, """SELECT "Year", "TeamName", "Circuit", avg("Position") AS "AvgFinish"
FROM silver GROUP BY 1, 2, 3"""), "AGG7")
def q_team_circuit_avg(spark, sf):
    return ST.circuit_average(silver_from_tables(spark, sf), ("Year", "TeamName"))


@register("grid_delta", O.with_(S, """SELECT "FullName", "Circuit", avg("GridPosition" - "Position") AS "Delta"
FROM silver WHERE "GridPosition" IS NOT NULL AND "Position" IS NOT NULL GROUP BY 1, 2"""), "AGG8")
def q_grid_delta(spark, sf):
    return ST.grid_delta(silver_from_tables(spark, sf))


@register("team_entrants", O.with_(S, """SELECT "Year", "TeamName", "FullName",
  CAST(coalesce(sum("Points"), 0) AS BIGINT) AS "Points", count(*) FILTER (WHERE "Position" = 1) AS "Wins",
  count(*) FILTER (WHERE "Position" <= 3) AS "Podiums", count("Position") AS "Races"
FROM silver GROUP BY 1, 2, 3"""), "AGG9")
def q_team_entrants(spark, sf):
    return ST.team_entrants(silver_from_tables(spark, sf))


@register("points_split", O.with_(S, """SELECT "Year", "TeamName", "Circuit", "FullName",
  CAST(coalesce(sum("Points"), 0) AS BIGINT) AS "Points" FROM silver GROUP BY 1, 2, 3, 4"""), "AGG10")
def q_points_split(spark, sf):
    return ST.points_split(silver_from_tables(spark, sf))


HIST_SQL = """hist AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY "Scope" ORDER BY "Points" DESC, "FullName") AS INTEGER) AS "Rank"
  FROM (SELECT "FullName", count("Position") AS "Races", count(*) FILTER (WHERE "Position" = 1) AS "Wins",
          count(*) FILTER (WHERE "Position" <= 3) AS "Podiums", CAST(coalesce(sum("Points"), 0) AS BIGINT) AS "Points",
          round_even(avg("Position"), 2) AS "AvgFinish", count(*) FILTER (WHERE "Position" > 20) AS "DNFs",
          CASE WHEN grouping("Year") = 1 THEN 'All Time' ELSE CAST("Year" AS VARCHAR) END AS "Scope"
        FROM silver GROUP BY GROUPING SETS (("Year", "FullName"), ("FullName"))) g)"""


@register("historical_stats", O.with_(S + ",\n" + HIST_SQL, "SELECT * FROM hist"), "AGG11")
def q_hist(spark, sf):
    return ST.historical_stats(silver_from_tables(spark, sf))


@register("circuit_most_wins", O.with_(S, """SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY "Circuit" ORDER BY "Wins" DESC, "FullName") AS INTEGER) AS "Rank"
  FROM (SELECT "Circuit", "FullName", count(*) AS "Wins" FROM silver WHERE "Position" = 1 GROUP BY 1, 2) w)
WHERE "Rank" <= 10"""), "AGG12", "SRT2", "CLN14")
def q_circuit_wins(spark, sf):
    return ST.circuit_winners(silver_from_tables(spark, sf))


@register("circuit_best_average", O.with_(S, """SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY "Circuit" ORDER BY "AvgFinish", "FullName") AS INTEGER) AS "Rank"
  FROM (SELECT "Circuit", "FullName", round_even(avg("Position"), 2) AS "AvgFinish" FROM silver GROUP BY 1, 2) w)
WHERE "Rank" <= 10"""), "AGG13", "SRT2")
def q_circuit_best(spark, sf):
    return ST.circuit_best_average(silver_from_tables(spark, sf))


@register("circuit_winner_list", O.with_(S, """SELECT "Circuit", "Year", "FullName", "TeamName"
FROM silver WHERE "Position" = 1"""), "AGG14", "SRT1", "SRT3")
def q_winner_list(spark, sf):
    return ST.circuit_winner_list(silver_from_tables(spark, sf))


@register("distinct_counts", O.with_(S, """SELECT count(*) AS "Rows",
  count(DISTINCT "FullName") AS "Entrants", count(DISTINCT "Circuit") AS "Circuits",
  (SELECT count(*) FROM (SELECT DISTINCT "Year", "Circuit" FROM silver) e) AS "Events"
FROM silver"""), "AGG18")
def q_distinct_counts(spark, sf):
    return ST.distinct_counts(silver_from_tables(spark, sf))


@register("distinct_rollup", O.with_(S, """SELECT CAST(2 - CAST("Year" IS NOT NULL AS INTEGER) - CAST("Circuit" IS NOT NULL AS INTEGER) AS INTEGER) AS "Level",
  "Year", "Circuit", count(DISTINCT "FullName") AS "Entrants", true AS "WithinTwoPercent"
FROM silver GROUP BY GROUPING SETS (("Year", "Circuit"), ("Year"), ())"""), "AGG18")
def q_distinct_rollup(spark, sf):
    """Entrants per event, season and of all time: exact, and whether the count
    out of merged event sketches is within 2 % of that."""
    silver = materialize(silver_from_tables(spark, sf).select("Year", "Circuit", "FullName"))
    exact = (silver.groupingSets([("Year", "Circuit"), ("Year",), ()], "Year", "Circuit")
             .agg(F.grouping_id().alias("_gid"), F.count_distinct("FullName").alias("Entrants"))
             .select(F.when(F.col("_gid") == 3, 2).otherwise(F.col("_gid")).cast("int").alias("Level"), "Year", "Circuit", "Entrants"))
    est = materialize(ST.rollup_distinct(ST.event_sketches(silver)))
    keys = ["Level", "Year", "Circuit"]
    on = [exact[k].eqNullSafe(est[k]) for k in keys]
    near = F.abs(F.col("Estimate") - F.col("Entrants")) <= 0.02 * F.col("Entrants")
    return exact.join(est, on).select(*[exact[k] for k in keys], "Entrants", near.alias("WithinTwoPercent"))


@register("heuristic_pick", O.with_(S + ",\n" + STANDINGS_SQL, """SELECT e."Year", e."FullName" AS "PoleSetter",
  e."FullName" AS "RaceWinner", t."TeamName" AS "WinningConstructor"
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "Year" ORDER BY "Points" DESC, "FullName") AS rn
                     FROM standings) x WHERE rn = 1) e
JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "Year" ORDER BY "TeamPoints" DESC, "TeamName") AS rn
                     FROM (SELECT "Year", "TeamName", CAST(coalesce(sum("Points"), 0) AS BIGINT) AS "TeamPoints"
                           FROM standings GROUP BY 1, 2) s) y WHERE rn = 1) t ON e."Year" = t."Year\""""),
          "AGG19", "FCT5")
def q_heuristic(spark, sf):
    return ST.heuristic_pick(ST.season_standings(silver_from_tables(spark, sf)))


@register("distinct_values", O.with_(S, """SELECT DISTINCT * FROM (
  SELECT 'year' AS "Kind", CAST("Year" AS VARCHAR) AS "Value" FROM silver
  UNION ALL SELECT 'circuit', "Circuit" FROM silver
  UNION ALL SELECT 'entrant', "FullName" FROM silver
  UNION ALL SELECT 'team', "TeamName" FROM silver) v WHERE "Value" IS NOT NULL"""), "AGG25", "SET1", "SET2")
def q_distinct_values(spark, sf):
    return ST.distinct_values(silver_from_tables(spark, sf))


@register("points_progression", O.with_(S + ",\n" + STANDINGS_SQL, """SELECT s."Year", s."FullName", s."Circuit", s."Points",
  CAST(sum(s."Points") OVER (PARTITION BY s."Year", s."FullName" ORDER BY s."Circuit"
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS "CumPoints"
FROM silver s WHERE ("Year", "FullName") IN (SELECT "Year", "FullName" FROM standings WHERE "Standing" <= 10)"""),
          "WIN11", "JON6")
def q_progression(spark, sf):
    silver = silver_from_tables(spark, sf)
    return ST.points_progression(silver, ST.season_standings(silver))


@register("head_to_head", O.with_(S + ",\n" + HIST_SQL + """,
pairs AS (SELECT a."FullName" AS "DriverA", b."FullName" AS "DriverB"
          FROM hist a JOIN hist b ON a."Scope" = 'All Time' AND b."Scope" = 'All Time' AND b."Rank" = a."Rank" + 1)""",
  """SELECT p."DriverA", p."DriverB", count(*) AS "RacesTogether",
  count(*) FILTER (WHERE a."Position" = 1) AS "WinsA", count(*) FILTER (WHERE b."Position" = 1) AS "WinsB",
  count(*) FILTER (WHERE a."Position" <= 3) AS "PodiumsA", count(*) FILTER (WHERE b."Position" <= 3) AS "PodiumsB",
  round_even(avg(a."Position"), 2) AS "AvgFinishA", round_even(avg(b."Position"), 2) AS "AvgFinishB",
  round_even(avg(a."GridPosition"), 2) AS "AvgGridA", round_even(avg(b."GridPosition"), 2) AS "AvgGridB",
  count(*) FILTER (WHERE a."Position" > 20) AS "DNFsA", count(*) FILTER (WHERE b."Position" > 20) AS "DNFsB"
FROM pairs p JOIN silver a ON a."FullName" = p."DriverA"
     JOIN silver b ON b."FullName" = p."DriverB" AND a."Year" = b."Year" AND a."Circuit" = b."Circuit"
GROUP BY 1, 2"""), "JON7", "SET3")
def q_h2h(spark, sf):
    silver = silver_from_tables(spark, sf)
    return ST.head_to_head(silver, ST.rival_pairs(ST.historical_stats(silver)))


# --- schedule ------------------------------------------------------------------

from ranklab.operators import ledger as LG  # noqa: E402
from ranklab.operators import schedule as SC  # noqa: E402
from ranklab.plans.layers import gold_from_tables  # noqa: E402
from ranklab.sources.tables import read_table  # noqa: E402

AS_OF = SC.DEFAULT_AS_OF
SCH = O.SCHEDULE


def _schedule(spark, sf):
    return materialize(SC.standardize_schedule(SC.raw_schedule(spark, sf)))  # one row per event, read many times


@register("schedule_status", O.with_(SCH, f"""SELECT *, CASE WHEN event_date < {O.AS_OF}
  THEN 'completed' ELSE 'upcoming' END AS status FROM sched"""), "SCH1", "SCH2", "CLN9")
def q_schedule_status(spark, sf):
    return SC.with_status(_schedule(spark, sf), AS_OF)


@register("upcoming_events", O.with_(SCH, f"SELECT * FROM sched WHERE event_date >= {O.AS_OF}"), "SCH3")
def q_upcoming(spark, sf):
    return SC.upcoming(_schedule(spark, sf), AS_OF)


@register("next_event", O.with_(SCH, f"""SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY "Year" ORDER BY round_number) AS rn
  FROM sched WHERE event_date >= {O.AS_OF}) t WHERE rn = 1"""), "SCH4")
def q_next(spark, sf):
    return SC.next_event(_schedule(spark, sf), AS_OF)


@register("last_completed_event", O.with_(SCH, f"""SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY "Year" ORDER BY round_number DESC) AS rn
  FROM sched WHERE event_date < {O.AS_OF}) t WHERE rn = 1"""), "SCH5")
def q_last(spark, sf):
    return SC.last_completed(_schedule(spark, sf), AS_OF)


@register("lock_deadlines", O.with_(SCH, f"""SELECT *, coalesce({O.AS_OF} >= lock_deadline, false) AS is_locked
FROM deadlines"""), "SCH6", "SCH7")
def q_deadlines(spark, sf):
    return SC.lock_state(SC.lock_deadlines(_schedule(spark, sf)), AS_OF)


@register("find_event", O.with_(SCH, """SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY "Year" ORDER BY round_number) AS rn
  FROM sched WHERE contains(lower(race_name), 'brand#1')) t WHERE rn = 1"""), "CLN16")
def q_find_event(spark, sf):
    return SC.find_event(_schedule(spark, sf), "Brand#1", required=True)


@register("season_progress", O.with_(SCH, f"""SELECT "Year", count(*) FILTER (WHERE event_date < {O.AS_OF}) AS completed,
  count(*) FILTER (WHERE event_date >= {O.AS_OF}) AS remaining FROM sched GROUP BY 1"""), "AGG23")
def q_progress(spark, sf):
    return SC.season_progress(_schedule(spark, sf), AS_OF)


# --- predictions, scoring, ledger -------------------------------------------------

GS = O.GOLD + "," + O.SCHEDULE + "," + O.STRATEGY


def _scored(spark, sf):
    gold = gold_from_tables(spark, sf)
    silver = gold.select("Year", "Circuit", "FullName", F.col("Position").cast("int").alias("Position"))
    ledger = LG.strategy_ledger(gold, SC.lock_deadlines(_schedule(spark, sf)))
    return LG.score_ledger(ledger, silver, AS_OF)




@register("strategy_predictions", O.with_(GS, "SELECT * FROM preds"), "WIN14", "SRT2", "FCT3")
def q_strategy(spark, sf):
    return LG.strategy_predictions(gold_from_tables(spark, sf))


@register("prediction_field", O.with_(GS, """SELECT user_id, "Year", "Circuit", driver, team, prob FROM strat_p"""), "OPS6")
def q_field(spark, sf):
    """The win probabilities of the whole field, one row per entrant: an event
    has no bound on its entrants, so they are no map in one row."""
    return LG.field_probabilities(gold_from_tables(spark, sf))


@register("prediction_payloads", O.with_(GS, """SELECT user_id, "Year", "Circuit",
  list(struct_pack(pos := pos, driver := driver, team := team, prob := prob) ORDER BY pos) AS top10,
  map_from_entries(list(struct_pack(k := driver, v := prob) ORDER BY driver)) AS win_probs
FROM preds GROUP BY 1, 2, 3"""), "OPS6")
def q_payloads(spark, sf):
    return LG.payloads(LG.strategy_predictions(gold_from_tables(spark, sf)))


@register("scored_predictions", O.with_(GS, """SELECT s.user_id, s.year, s.race_name, d.round_number,
  s.winner_correct, s.podium_hits, s.top10_hits, s.position_mae, s.spearman_rho, s.status
FROM scored_text s JOIN deadlines d ON d."Year" = s.year AND d.race_name = s.race_name"""),
          "OPS3", "EVL4", "JON8", "TXT3", "TXT4", "SET3")
def q_scored(spark, sf):
    return LG.status_label(_scored(spark, sf)).select(
        "user_id", "year", "race_name", "round_number", "winner_correct", "podium_hits",
        "top10_hits", "position_mae", "spearman_rho", "status")


STRAT_USERS_SQL = "(SELECT * FROM (VALUES (1, 'by_grid'), (2, 'by_form'), (3, 'by_champ')) u(id, username))"


@register("leaderboard", O.with_(GS, f"""SELECT *, CASE WHEN rank = 1 THEN '🥇' WHEN rank = 2 THEN '🥈'
  WHEN rank = 3 THEN '🥉' ELSE CAST(rank AS VARCHAR) END AS medal FROM (
  SELECT *, CAST(row_number() OVER (ORDER BY avg_podium_hits DESC, username) AS INTEGER) AS rank FROM (
    SELECT u.username, count(*) AS races_scored,
      CAST(sum(coalesce(CAST(winner_correct AS INTEGER), 0)) AS BIGINT) AS winners_correct,
      avg(coalesce(podium_hits, 0)) AS avg_podium_hits, avg(coalesce(top10_hits, 0)) AS avg_top10_hits,
      avg(position_mae) AS avg_position_mae, avg(spearman_rho) AS avg_spearman
    FROM scored s JOIN {STRAT_USERS_SQL} u ON s.user_id = u.id
    WHERE s.winner_correct IS NOT NULL GROUP BY 1) a) r"""), "AGG20", "TXT5", "JON5")
def q_leaderboard(spark, sf):
    return LG.leaderboard(_scored(spark, sf), LG.strategy_users(spark))


@register("personal_summary", O.with_(GS, """SELECT user_id,
  CAST(sum(CAST(winner_correct AS INTEGER)) AS BIGINT) AS winners_correct, count(*) AS scored,
  avg(podium_hits) AS avg_podium_hits, avg(spearman_rho) AS avg_spearman
FROM scored WHERE winner_correct IS NOT NULL GROUP BY 1"""), "AGG21")
def q_personal(spark, sf):
    return LG.personal_summary(_scored(spark, sf))


SUB = O.SUBMISSIONS


def _subs(spark, sf):
    return LG.submissions(read_table(spark, sf, "events", "event_id", "ts", "user_id", "event_type",
                                     "value", "props"))


@register("effective_predictions", O.with_(SUB, "SELECT * FROM effective"), "OPS2")
def q_effective(spark, sf):
    return LG.effective_predictions(_subs(spark, sf))


@register("effective_predictions_asof", O.with_(SUB + """,
ev AS (SELECT *, CAST(ts AS DATE) AS day, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events),
changes AS (
  SELECT DISTINCT day, CAST(day AS TIMESTAMP) AS valid_from, CAST(day AS TIMESTAMP) + INTERVAL 12 HOUR AS lock_deadline,
    CAST(-1 AS BIGINT) AS change_id
  FROM ev WHERE day(day) % 7 <> 0
  UNION ALL
  SELECT day, ts, CASE WHEN k % 10 <> 0 THEN CAST(day AS TIMESTAMP) + (6 + k % 13) * INTERVAL 1 HOUR END, event_id
  FROM ev WHERE event_type = 'signup'),
timed AS (
  SELECT * FROM (
    SELECT s.*, c.lock_deadline, row_number() OVER (PARTITION BY s.event_id ORDER BY c.valid_from DESC NULLS LAST, c.change_id DESC) AS pick
    FROM subs s LEFT JOIN changes c ON c.day = s.day AND c.valid_from <= s.ts) t WHERE pick = 1)""",
          """SELECT * EXCLUDE (pick, rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY ts DESC, event_id DESC) AS rn
  FROM timed WHERE lock_deadline IS NULL OR ts < lock_deadline) e WHERE rn = 1"""), "OPS2", "SCH6", "SCH7")
def q_effective_asof(spark, sf):
    """Deadlines move, are withdrawn, or are not yet known when a submission comes."""
    events = read_table(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    return LG.effective_predictions_asof(LG.submissions(events), LG.announced_deadlines(events))


MERGE_CTES = SUB + """,
locks AS (SELECT user_id, day, min(ts) AS locked_at FROM subs WHERE event_type = 'purchase' GROUP BY 1, 2),
dr AS (SELECT s.*, l.locked_at, (l.locked_at IS NOT NULL AND s.ts >= l.locked_at) AS rej
       FROM subs s LEFT JOIN locks l ON s.user_id = l.user_id AND s.day = l.day
       WHERE s.event_type = 'click')"""


@register("submission_merge", O.with_(MERGE_CTES, """SELECT user_id, day, event_id, ts, value,
  CASE WHEN rej THEN 'rejected' ELSE 'accepted' END AS status, CASE WHEN rej THEN 'locked' END AS reason,
  (row_number() OVER (PARTITION BY user_id, day ORDER BY CASE WHEN rej THEN 1 ELSE 0 END, ts DESC, event_id DESC) = 1)
    AND NOT rej AS is_stored, locked_at
FROM dr"""), "OPS1")
def q_merge(spark, sf):
    return LG.merge_submissions(_subs(spark, sf))


@register("admin_listing", O.with_(SUB, """SELECT e.user_id, c.c_name AS username, e.day, e.event_id, e.ts,
  e.value, e.k, e.lock_deadline FROM effective e JOIN customer c ON e.user_id = c.c_custkey"""),
          "OPS5", "JON5")
def q_admin(spark, sf):
    users = LG.users_from_customers(read_table(spark, sf, "customer", "c_custkey", "c_name",
                                               "c_mktsegment", "c_acctbal"))
    return LG.admin_listing(LG.effective_predictions(_subs(spark, sf)), users)


@register("locked_count", O.with_(SUB, """SELECT count(*) AS locked_predictions FROM (
  SELECT DISTINCT user_id, day FROM subs WHERE event_type = 'purchase') t"""), "AGG22")
def q_locked(spark, sf):
    return LG.locked_count(_subs(spark, sf))


@register("ledger_upsert", O.with_(MERGE_CTES, """SELECT coalesce(l.user_id, d.user_id) AS user_id,
  coalesce(l.day, d.day) AS day, d.event_id, d.ts, d.value, l.locked_at
FROM locks l FULL JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day
    ORDER BY ts DESC, event_id DESC) AS rn FROM dr WHERE NOT rej) t WHERE rn = 1) d
  ON l.user_id = d.user_id AND l.day = d.day"""), "OPS1")
def q_upsert(spark, sf):
    """Morning submissions are stored, those of the afternoon merged into the stored ledger."""
    from ranklab.sources import sinks as SK
    subs = _subs(spark, sf)
    morning = F.hour("ts") < 12
    root = SK.scratch_path(spark, "ledger")
    SK.write_version(LG.upsert_ledger(subs.filter(morning)), root)
    stored = spark.read.parquet(SK.latest_version(spark, root))
    SK.write_version(LG.upsert_ledger(subs.filter(~morning), stored), root)
    return spark.read.parquet(SK.latest_version(spark, root))


LATE = "hour(ts) >= 12 AND CASE WHEN month(ts) % 2 = 0 THEN 1 ELSE 0 END = {}"


@register("ledger_partitions", O.with_(MERGE_CTES, f"""SELECT coalesce(l.user_id, d.user_id) AS user_id,
  coalesce(l.day, d.day) AS day, d.event_id, d.ts, d.value, l.locked_at, v.written_by
FROM locks l FULL JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day
    ORDER BY ts DESC, event_id DESC) AS rn FROM dr WHERE NOT rej) t WHERE rn = 1) d
  ON l.user_id = d.user_id AND l.day = d.day
JOIN (SELECT day, CAST(max(CASE WHEN {LATE.format(1)} THEN 3 WHEN {LATE.format(0)} THEN 2 ELSE 1 END) AS BIGINT) AS written_by
      FROM subs GROUP BY day) v ON v.day = coalesce(l.day, d.day)"""), "OPS1", "SNK3")
def q_upsert_partitions(spark, sf):
    """Three batches (mornings, then the afternoons of odd and of even months)
    merged into a ledger stored by day; ``written_by`` is the version that wrote
    the row's day: a batch leaves the other days as they are."""
    from ranklab.sources import partitions as PT
    from ranklab.sources import sinks as SK
    subs = _subs(spark, sf)
    root = SK.scratch_path(spark, "ledger")
    for batch in (F.hour("ts") < 12, F.expr(LATE.format(0)), F.expr(LATE.format(1))):
        LG.upsert_stored(subs.filter(batch), root)
    last = PT.current(spark, root)
    days = PT.manifest(spark, root, last).select("day", F.col("_version").alias("written_by"))
    return PT.read(spark, root, at=last).join(days, "day").select(
        "user_id", "day", "event_id", "ts", "value", "locked_at", "written_by")


@register("ledger_scored_events", O.with_(GS, """SELECT s.user_id, s.year, s.race_name, s.winner_correct, s.podium_hits, s.status,
  CAST(CASE WHEN s.winner_correct IS NULL THEN 1
            WHEN s.year < (SELECT max("Year") FROM silver) THEN 2 ELSE 3 END AS BIGINT) AS written_by
FROM scored_text s JOIN deadlines d ON d."Year" = s.year AND d.race_name = s.race_name"""), "OPS3", "SNK3")
def q_writeback_partitions(spark, sf):
    """The strategies' ledger stored by event; results come in two batches, the
    seasons before the last and then the last: each rewrites its own events."""
    from ranklab.sources import partitions as PT
    from ranklab.sources import sinks as SK
    gold = gold_from_tables(spark, sf)
    silver = gold.select("Year", "Circuit", "FullName", F.col("Position").cast("int").alias("Position"))
    newest = silver.agg(F.max("Year")).first()[0] or 0
    root = SK.scratch_path(spark, "scores")
    PT.commit(LG.strategy_ledger(gold, SC.lock_deadlines(_schedule(spark, sf))), root, ["year", "race_name"], None)
    for results in (silver.filter(F.col("Year") < newest), silver.filter(F.col("Year") == newest)):
        LG.write_back_stored(spark, root, results, AS_OF)
    last = PT.current(spark, root)
    events = PT.manifest(spark, root, last).select("year", "race_name", F.col("_version").alias("written_by"))
    return LG.status_label(PT.read(spark, root, at=last)).join(events, ["year", "race_name"]).select(
        "user_id", "year", "race_name", "winner_correct", "podium_hits", "status", "written_by")


@register("ledger_writeback", O.with_(GS, """SELECT s.user_id, s.year, s.race_name, s.winner_correct, s.podium_hits,
  s.status, CAST(0 AS BIGINT) AS rescored
FROM scored_text s JOIN deadlines d ON d."Year" = s.year AND d.race_name = s.race_name"""), "OPS3", "SNK3")
def q_writeback(spark, sf):
    """Scores are written back to the stored ledger; a second run on it scores ``rescored`` rows."""
    from ranklab.operators.ranking import with_scalars
    from ranklab.sources import sinks as SK
    gold = gold_from_tables(spark, sf)
    silver = gold.select("Year", "Circuit", "FullName", F.col("Position").cast("int").alias("Position"))
    root = SK.scratch_path(spark, "scores")
    SK.write_version(LG.strategy_ledger(gold, SC.lock_deadlines(_schedule(spark, sf))), root)
    stored = spark.read.parquet(SK.latest_version(spark, root))
    SK.write_version(LG.write_back(stored, LG.score_ledger(stored, silver, AS_OF)), root)
    after = spark.read.parquet(SK.latest_version(spark, root))
    again = LG.score_ledger(after, silver, AS_OF).agg(F.count("scored_at").alias("rescored"))
    return with_scalars(LG.status_label(after), again).select(
        "user_id", "year", "race_name", "winner_correct", "podium_hits", "status", "rescored")


@register("user_history", O.with_(GS, """SELECT s.user_id, s.race_name, s.year, d.round_number,
  d.lock_deadline - INTERVAL 1 HOUR AS predicted_at, true AS is_locked, s.top10,
  '🔒 Locked — awaiting race result' AS status
FROM (SELECT user_id, "Year" AS year, "Circuit" AS race_name,
    list(struct_pack(pos := pos, driver := driver, team := team, prob := prob) ORDER BY pos) AS top10
  FROM preds GROUP BY 1, 2, 3) s
JOIN deadlines d ON d."Year" = s.year AND d.race_name = s.race_name"""), "OPS4", "TXT4")
def q_history(spark, sf):
    """The payload's JSON text is read back, so that its values are compared."""
    gold = gold_from_tables(spark, sf)
    history = LG.user_history(LG.strategy_ledger(gold, SC.lock_deadlines(_schedule(spark, sf))))
    payload = F.from_json("top10_json", "array<struct<pos:int,driver:string,team:string,prob:double>>")
    return history.withColumn("top10", payload).drop("top10_json")


# --- forecasting -------------------------------------------------------------------

from ranklab.operators import forecast as FC  # noqa: E402


def _forecast_inputs(spark, sf, gold=None):
    gold = gold_from_tables(spark, sf) if gold is None else gold
    sched = _schedule(spark, sf)
    hist = FC.history_before(gold, sched, AS_OF)
    targets = FC.target_events(SC.next_event(sched, AS_OF))
    return hist, targets


FEATURE_COLS = ('"Year", "Circuit", "FullName", "TeamName", "AvgFinishLast3", "AvgFinishLast5", '
                '"AvgFinishLast10", "AvgGridLast5", "DNFRateLast10", "TeamPointsLast5", "TeamForm", '
                '"ChampPos", "CircuitAvgFinish", "CircuitWins", "GridPosition"')


@register("forecast_features", O.with_(O.forecast_ctes() + O.FEATURES, f"SELECT {FEATURE_COLS} FROM features"),
          "FCT1", "AGG16", "AGG17", "WIN16", "WIN17", "CLN15", "JON6")
def q_features(spark, sf):
    hist, targets = _forecast_inputs(spark, sf)
    return FC.feature_rows(hist, targets)


@register("two_stage_forecast", O.with_(O.forecast_ctes() + O.FEATURES + O.TWO_STAGE, "SELECT * FROM forecast"),
          "FCT2", "FCT3", "WIN12", "WIN14", "TXT1")
def q_forecast(spark, sf):
    hist, targets = _forecast_inputs(spark, sf)
    return FC.two_stage_forecast(FC.feature_rows(hist, targets))


@register("forecast_podium", O.with_(O.forecast_ctes() + O.FEATURES + O.TWO_STAGE,
          'SELECT * FROM forecast WHERE "PredictedFinish" <= 3'), "SRT2")
def q_podium(spark, sf):
    hist, targets = _forecast_inputs(spark, sf)
    return FC.podium(FC.two_stage_forecast(FC.feature_rows(hist, targets)))


@register("entrant_profile", O.with_(O.forecast_ctes(target_year=False) + O.LEGACY,
          """SELECT "Year", "Circuit", "FullName", "TeamName", avg_finish_overall, avg_quali_pos,
  avg_finish_circuit, team_form, team_form_p75, track_delta, track_specialist FROM profile2"""),
          "AGG15", "AGG24", "JON4", "WIN18")
def q_profile(spark, sf):
    hist, targets = _forecast_inputs(spark, sf)
    return FC.entrant_profile(hist, targets)


@register("legacy_forecast", O.with_(O.forecast_ctes(target_year=False) + O.LEGACY + O.LEGACY_FORECAST,
          "SELECT * FROM legacy"), "FCT4", "WIN15", "TXT2")
def q_legacy(spark, sf):
    hist, targets = _forecast_inputs(spark, sf)
    return FC.legacy_forecast(FC.entrant_profile(hist, targets))


# --- training and evaluation -----------------------------------------------------------

from ranklab.operators import ml as ML  # noqa: E402


@register("training_split", O.with_(O.GOLD + O.ML_TASKS, """SELECT c.model, c.target, c.n_rows, c.positive_rate,
  c.cutoff, count(*) FILTER (WHERE t."RaceIndex" <= c.cutoff) AS n_train,
  count(*) FILTER (WHERE t."RaceIndex" > c.cutoff) AS n_test,
  greatest(CAST(1 AS DOUBLE), count(*) FILTER (WHERE t."RaceIndex" <= c.cutoff AND t.y = 0)
    / CAST(greatest(count(*) FILTER (WHERE t."RaceIndex" <= c.cutoff AND t.y = 1), 1) AS DOUBLE)) AS scale_pos_weight
FROM cuts c JOIN task_rows t ON t.model = c.model GROUP BY 1, 2, 3, 4, 5"""),
          "MLT1", "MLT2", "CLN12", "CLN13", "CLN17", "Q5")
def q_split(spark, sf):
    return ML.split_summary(gold_from_tables(spark, sf))


@register("score_metrics", O.with_(O.GOLD + O.ML_TASKS, """SELECT model, count(*) AS n_test,
  round_even(avg(CASE WHEN (p > 0.5) = (y = 1) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 4) AS accuracy,
  round_even(coalesce(count(*) FILTER (WHERE p > 0.5 AND y = 1)
    / CAST(nullif(count(*) FILTER (WHERE p > 0.5), 0) AS DOUBLE), CAST(0 AS DOUBLE)), 4) AS precision,
  round_even((sum(CAST(r AS DOUBLE) + (CAST(c AS DOUBLE) - 1) / 2) FILTER (WHERE y = 1)
    - CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) * (count(*) FILTER (WHERE y = 1) + 1) / 2)
    / (CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) * count(*) FILTER (WHERE y = 0)), 4) AS roc_auc,
  round_even(avg((p - y) * (p - y)), 4) AS brier
FROM ranked GROUP BY 1"""), "EVL1", "EVL2", "EVL3")
def q_score_metrics(spark, sf):
    return ML.score_metrics(gold_from_tables(spark, sf),
                            1.0 / F.greatest(F.col("AvgGridLast5"), F.lit(1.0)))


MODEL_ROWS = O.GOLD + O.ML_TASKS


def _model_root(spark):
    """Trainings of this application, by their data and parameters."""
    from ranklab.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark)}/ranklab-models"


@register("gbt_training", None, "MLT3", "MLT4", "MLT5", "EVL1", "EVL2", "EVL3")
def q_gbt(spark, sf):
    """Three boosted-tree tasks with the reference hyper-parameters: the
    metrics of the saved training (rows-only check: model-dependent values)."""
    _, metrics, _, _ = ML.stored_training(gold_from_tables(spark, sf), _model_root(spark))
    return metrics


@register("gbt_sizes", O.with_(MODEL_ROWS, """SELECT c.model, count(*) FILTER (WHERE t."RaceIndex" <= c.cutoff) AS n_train,
  count(*) FILTER (WHERE t."RaceIndex" > c.cutoff) AS n_test, true AS auc_in_bounds
FROM cuts c JOIN task_rows t ON t.model = c.model GROUP BY 1"""), "MLT3", "CLN17", "EVL2")
def q_gbt_sizes(spark, sf):
    """The fitted tasks' row counts, and whether their AUC is within bounds: over 0.9 for
    winner and podium; the pole task has lost the feature that tells it (Q5)."""
    _, metrics, _, _ = ML.stored_training(gold_from_tables(spark, sf), _model_root(spark))
    least = F.when(F.col("model") == "pole_position_model", 0.0).otherwise(0.9)
    return metrics.select("model", "n_train", "n_test", F.col("roc_auc").between(least, 1.0).alias("auc_in_bounds"))


@register("model_roundtrip", O.with_(MODEL_ROWS, """SELECT model, n_rows, n_rows AS n_same_reloaded, n_rows AS n_same_nodes
FROM cuts"""), "MLT3", "MLT4", "MLT5", "CLN10", "CLN17")
def q_roundtrip(spark, sf):
    """Every row's score by the fitted model, by the saved and reloaded one, and by joins down its node table."""
    from ranklab.sources import sinks as SK
    return ML.roundtrip(gold_from_tables(spark, sf), SK.scratch_path(spark, "models"), ML.GBTParams(max_iter=4))


@register("run_log", O.with_(MODEL_ROWS + "," + SCH, f"""SELECT CAST(run_at AS TIMESTAMPTZ) AS run_at, triggered_by, race_name, "Year" AS year, gold_row_count, features_used,
  winner_auc, pole_auc, top3_auc, winner_brier
FROM (SELECT max(CASE WHEN model = 'race_winner_model' THEN roc_auc END) AS winner_auc,
        max(CASE WHEN model = 'pole_position_model' THEN roc_auc END) AS pole_auc,
        max(CASE WHEN model = 'top3_model' THEN roc_auc END) AS top3_auc,
        max(CASE WHEN model = 'race_winner_model' THEN brier END) AS winner_brier
      FROM (SELECT model, round_even((sum(CAST(r AS DOUBLE) + (CAST(c AS DOUBLE) - 1) / 2) FILTER (WHERE y = 1)
              - CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) * (count(*) FILTER (WHERE y = 1) + 1) / 2)
              / (CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) * count(*) FILTER (WHERE y = 0)), 4) AS roc_auc,
              round_even(avg((p - y) * (p - y)), 4) AS brier FROM ranked GROUP BY 1) m) m,
  (SELECT count(*) AS gold_row_count FROM gold) g,
  (SELECT * FROM (VALUES ({O.AS_OF}, 'batch'), ({O.AS_OF} + INTERVAL 1 DAY, 'manual')) v(run_at, triggered_by)) v,
  (SELECT '{",".join(ML.FEATURES)}' AS features_used) f,
  (SELECT "Year", race_name FROM sched WHERE event_date < {O.AS_OF} ORDER BY event_date DESC, "Year" DESC, round_number DESC LIMIT 1) e"""),
          "EVL5", "EVL6", "SNK5")
def q_run_log(spark, sf):
    """Two runs are appended to the run log, which is read back newest first. The event
    is the last one completed; the score is the given one, so that the log can be compared."""
    from ranklab.sources import sinks as SK
    gold = gold_from_tables(spark, sf)
    metrics = ML.score_metrics(gold, 1.0 / F.greatest(F.col("AvgGridLast5"), F.lit(1.0)))
    last = (_schedule(spark, sf).filter(F.col("event_date") < F.to_timestamp(F.lit(AS_OF)))
            .orderBy(F.desc("event_date"), F.desc("Year"), F.desc("round_number")).first())
    path, rows = SK.scratch_path(spark, "run-log"), gold.count()
    for days, trigger in ((0, "batch"), (1, "manual")):
        at = spark.range(1).select(F.to_timestamp(F.lit(AS_OF)) + F.make_dt_interval(days=F.lit(days))).first()[0]
        row = ML.run_log_row(spark, f"{at:%Y-%m-%d %H:%M:%S}", trigger, last.race_name, last.Year, rows, ML.available_features(gold), metrics, 0.0)
        ML.append_run_log(row, path)
    return ML.run_history(spark, path).drop("training_sec")


# --- bronze files, sinks and streaming -------------------------------------------------

from ranklab.operators.gold import build_gold, compat_features  # noqa: E402
from ranklab.operators.silver import clean_silver  # noqa: E402
from ranklab.operators.standings import heuristic_pick, season_standings  # noqa: E402
from ranklab.sources import sinks as SK  # noqa: E402
from ranklab.sources.bronze import scan_bronze  # noqa: E402
from ranklab.sources.fixture import bronze_results, event_results, qualifying  # noqa: E402
from ranklab.streaming.ingest import ingest, read_silver  # noqa: E402

SILVER_SQL = O.with_(S, 'SELECT "Year", "Circuit", "FullName", "TeamName", "Position", "GridPosition", '
                        '"Points", "RaceIndex" FROM silver')


def _typed_silver(df):
    return df.select("Year", "Circuit", "FullName", "TeamName", F.col("Position").cast("int").alias("Position"),
                     F.col("GridPosition").cast("int").alias("GridPosition"),
                     F.col("Points").cast("int").alias("Points"), "RaceIndex")


def _bronze_root(spark, sf, with_quali=False):
    root = SK.scratch_path(spark, "bronze")
    res = event_results(spark, sf, with_quali_grid=with_quali)
    SK.write_bronze(bronze_results(res), root)
    if with_quali:
        q = (qualifying(res).select("FullName", F.col("GridPosition").cast("string").alias("GridPosition"),
                                    "Session",
                                    F.concat_ws("_", F.col("Year").cast("string"), F.translate("Circuit", " ", "_"),
                                                F.lit("qualifying.csv")).alias("Source")))
        # numbered in session order: "last wins" is well defined in any number of files
        SK.write_bronze(q, root, "append", order_by=["Session"])
    return root


@register("bronze_roundtrip", SILVER_SQL, "SNK1", "SRC1", "SRC4", "SRC6", "SRC7", "SET1", "CLN1", "CLN2",
          "CLN4", "CLN5", "CLN8")
def q_bronze(spark, sf):
    root = _bronze_root(spark, sf)
    return _typed_silver(clean_silver(scan_bronze(spark, root)))


@register("gold_from_bronze", O.with_(O.GOLD, O.GOLD_SELECT), "SRC2", "JON2", "CLN7", "Q9")
def q_gold_bronze(spark, sf):
    from ranklab.plans.layers import GOLD_COLUMNS
    root = _bronze_root(spark, sf, with_quali=True)
    silver = clean_silver(scan_bronze(spark, root))
    quali = scan_bronze(spark, root, "qualifying", required=False)
    # no Session: later file, later row wins among duplicate qualifying keys
    gold = build_gold(silver, quali.drop("Session"))
    return gold.select(*GOLD_COLUMNS)


@register("stream_ingest", SILVER_SQL, "STR1", "SNK2", "SRC8")
def q_stream(spark, sf):
    root = SK.scratch_path(spark, "bronze")
    silver_path, ck = SK.scratch_path(spark, "silver"), SK.scratch_path(spark, "stream-ck")
    b = bronze_results(event_results(spark, sf)).withColumn(
        "_y", F.regexp_extract("Source", r"^(\d+)_", 1).cast("int"))
    first_year = b.agg(F.min("_y")).first()[0]
    early = (F.col("_y") <= first_year + 2) & (F.crc32("FullName") % 2 == 0)
    SK.write_bronze(b.filter(early).drop("_y"), root)
    ingest(spark, root, silver_path, ck)                       # files present now: half of each early event
    SK.write_bronze(b.filter(~early).drop("_y"), root, mode="append", batch=1)
    ingest(spark, root, silver_path, ck, max_files=100)        # second files of known events, and new events
    ingest(spark, root, silver_path, ck)                       # nothing new: no-op
    return _typed_silver(read_silver(spark, silver_path))


@register("compat_features", O.with_(S, """SELECT "Year", "Circuit", "FullName", "TeamName",
  "Position" AS "ClassifiedPosition", CAST(coalesce("GridPosition", 22) AS INTEGER) AS "GridPosition",
  CAST("Points" AS DOUBLE) AS "Points",
  avg("Position") OVER (PARTITION BY "FullName" ORDER BY "Year", "Circuit" ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)
    AS "AvgFinishLast5",
  sum(CAST("Points" AS DOUBLE)) OVER (PARTITION BY "TeamName" ORDER BY "Year", "Circuit", "FullName"
    ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS "TeamForm"
FROM silver"""), "WIN9", "WIN10", "CLN3", "Q7")
def q_compat(spark, sf):
    raw = bronze_results(event_results(spark, sf)).withColumns({
        "Year": F.regexp_extract("Source", r"^(\d+)_", 1).cast("int"),
        "Circuit": F.translate(F.regexp_extract("Source", r"^\d+_(.*)_results\.csv$", 1), "_", " ")})
    return compat_features(raw).select("Year", "Circuit", "FullName", "TeamName", "ClassifiedPosition",
                                       "GridPosition", "Points", "AvgFinishLast5", "TeamForm")


@register("gold_versioned_count", O.with_(O.GOLD, 'SELECT count(*) AS "Rows" FROM gold'), "SNK3", "SRC8", "SRC10")
def q_versioned(spark, sf):
    root = SK.scratch_path(spark, "gold")
    SK.write_version(gold_table(spark, sf), root)
    latest = SK.latest_version(spark, root)
    # SRC10: a row count over the committed version (answered from parquet footers)
    return spark.read.parquet(latest).agg(F.count(F.lit(1)).alias("Rows"))


@register("schedule_json_roundtrip", O.with_(SCH, "SELECT * FROM sched"), "SNK4", "SRC11")
def q_json(spark, sf):
    path = SK.scratch_path(spark, "meetings")
    sched = _schedule(spark, sf)
    SK.write_json_records(SC.meeting_records(sched), path)
    back = SC.schedule_from_json_records(spark, path)
    # provider records carry no format: the sprint flag comes from the raw schedule
    flags = sched.select("Year", "round_number", "is_sprint")
    return (back.drop("is_sprint").join(flags, ["Year", "round_number"])
            .select(*[c for c in SC.SCHEDULE_COLUMNS]))


@register("prediction_text", O.with_(S + ",\n" + STANDINGS_SQL + "," + SCH, f"""SELECT e."Year", n.race_name,
  printf('# %d %s GP Prediction\n\n- Pole Setter: %s\n- Race Winner: %s\n- Winning Constructor: %s\n',
         e."Year", upper(left(n.race_name, 1)) || lower(substr(n.race_name, 2)), e."FullName", e."FullName",
         t."TeamName") AS text
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "Year" ORDER BY "Points" DESC, "FullName") AS rn
                     FROM standings) x WHERE rn = 1) e
JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "Year" ORDER BY "TeamPoints" DESC, "TeamName") AS rn
                     FROM (SELECT "Year", "TeamName", CAST(coalesce(sum("Points"), 0) AS BIGINT) AS "TeamPoints"
                           FROM standings GROUP BY 1, 2) s) y WHERE rn = 1) t ON e."Year" = t."Year"
JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "Year" ORDER BY round_number) AS rn
                     FROM sched WHERE event_date >= {O.AS_OF}) z WHERE rn = 1) n ON n."Year" = e."Year\""""),
          "SNK6")
def q_text(spark, sf):
    picks = heuristic_pick(season_standings(silver_from_tables(spark, sf)))
    text = SK.prediction_text(picks, SC.next_event(_schedule(spark, sf), AS_OF))
    path = SK.scratch_path(spark, "predictions-md")
    SK.write_text(text, path)
    # SNK6: the rows come back from the written file (a record holds line breaks, so whole files are read)
    read = spark.read.option("lineSep", "\u0000").text(path)
    lines = read.select(F.explode(F.split("value", r"\n(?=# \d+ )")).alias("text"))
    back = lines.select(F.concat(F.rtrim(F.col("text"), F.lit("\n")), F.lit("\n")).alias("text")).filter(F.length("text") > 1)
    return text.join(back, "text").select(*text.columns)


@register("ml_forecast", None, "MLT4", "CLN10", "CLN11", "FCT2", "FCT4")
def q_ml_forecast(spark, sf):
    """Both forecasts with the fitted boosted trees as scorers: stage 1 the
    pole model, stage 2 the winner and podium models; the legacy forecast maps
    the models' feature names onto its profile columns. Rows-only check."""
    from concurrent.futures import ThreadPoolExecutor

    gold = gold_from_tables(spark, sf)
    with ThreadPoolExecutor(max_workers=1) as pool:  # features and profiles need no model
        training = pool.submit(ML.stored_training, gold, _model_root(spark))
        hist, targets = _forecast_inputs(spark, sf, gold)
        features, profile = FC.feature_rows(hist, targets), FC.entrant_profile(hist, targets)
        models, _, _, _ = training.result()
    fc = FC.two_stage_forecast(features,
                               pole=ML.ml_scorer(models["pole_position_model"]),
                               winner=ML.ml_scorer(models["race_winner_model"]),
                               top3=ML.ml_scorer(models["top3_model"]))
    legacy = FC.legacy_forecast(profile,
                                qual=ML.legacy_ml_scorer(models["pole_position_model"]),
                                race=ML.legacy_ml_scorer(models["race_winner_model"]))
    return (fc.select("Year", "Circuit", "FullName", "PredictedGrid", "PredictedFinish", "WinProbability")
            .join(legacy.select("Year", "Circuit", "FullName",
                                F.col("PredictedFinish").alias("LegacyFinish"),
                                F.col("WinProbability").alias("LegacyWinShare")),
                  ["Year", "Circuit", "FullName"], "left"))


CURRENT_SEASON = int(AS_OF[:4])


@register("bronze_season_scan", O.with_(S, f"""SELECT "Year", "Circuit", "FullName", "TeamName",
  "Position", "GridPosition", "Points" FROM silver WHERE "Year" = {CURRENT_SEASON}"""), "SRC3")
def q_season_scan(spark, sf):
    """The current season's files only (season of ``as_of``): file paths are
    filtered by season before any file is opened."""
    root = _bronze_root(spark, sf)
    raw = scan_bronze(spark, root, years=[CURRENT_SEASON])
    s = clean_silver(raw)
    return s.select("Year", "Circuit", "FullName", "TeamName", F.col("Position").cast("int").alias("Position"),
                    F.col("GridPosition").cast("int").alias("GridPosition"),
                    F.col("Points").cast("int").alias("Points"))


@register("bronze_dedup_scan", O.with_(S, """SELECT "Year", "Circuit", "FullName", "TeamName", "Position"
FROM silver"""), "SRC5", "SET4", "CLN1")
def q_dedup_scan(spark, sf):
    """Alias-normalised names, then one row per (Year, Circuit, FullName):
    the last in (file, row) order (a map-side keep-last aggregation)."""
    from ranklab.operators.silver import keep_last, normalize_names
    root = _bronze_root(spark, sf)
    raw = normalize_names(scan_bronze(spark, root, min_bytes=0), "FullName")
    last = keep_last(raw, ["Year", "Circuit", "FullName"], ["Source", "_row"])
    return last.select("Year", "Circuit", "FullName", "TeamName",
                       F.col("Position").cast("int").alias("Position"))


@register("bronze_quarantine", O.with_(S, """SELECT "Year", "Circuit", count(*) + count(*) FILTER (WHERE "Position" = 3) AS rows_read,
  count(*) FILTER (WHERE "Position" = 1) AS odd_records, count(*) FILTER (WHERE "Position" = 2) AS bad_bytes,
  CAST(0 AS BIGINT) AS unreadable_files, count(*) FILTER (WHERE "Position" = 3) AS broken_lines
FROM silver GROUP BY 1, 2
UNION ALL SELECT CAST(1900 AS INTEGER), 'Cut Off', 0, 0, 0, 1, 0"""), "SRC1", "SRC7")
def q_quarantine(spark, sf):
    """All results as bronze, and beside them, for each event, its winner's record with a
    cell too many, the second's with a byte that is no UTF-8 and the third's with a line
    break in its name; and an archive that breaks off. Per event: rows read, and what was
    set aside."""
    from ranklab.sources.quarantine import scan_with_quarantine
    root = SK.scratch_path(spark, "bronze")
    b = bronze_results(event_results(spark, sf))
    SK.write_bronze(b, root)
    cells = lambda name, *more: F.concat_ws(",", name, "TeamName", "Position", *more)
    line = (F.when(F.col("Position") == "1", cells("FullName", F.lit("one"), F.lit("many")))
            .when(F.col("Position") == "2", cells(F.concat(F.unhex(F.lit("ff")).cast("string"), "FullName"), F.lit("0")))
            .otherwise(cells(F.concat(F.lit('"'), F.col("FullName"), F.lit('\n"')), F.lit("0"))))
    podium = b.filter(F.col("Position").isin("1", "2", "3"))  # three records an event
    damaged = podium.groupBy("Source").agg(F.concat(F.lit("FullName,TeamName,Position,Points\n"), F.array_join(F.collect_list(line), "\n")).alias("value"))
    damaged.write.mode("append").partitionBy("Source").text(root)
    SK.write_broken_archive(spark, f"{root}/Source=1900_Cut_Off_results.csv/part-0.csv.gz", "FullName,Position\n" + "Nobody,1\n" * 500)
    good, bad = scan_with_quarantine(spark, root)
    tally = bad.groupBy("Source").agg(F.count_if(F.col("reason") == "column count").alias("odd_records"),
                                      F.count_if(F.col("reason") == "bad bytes").alias("bad_bytes"),
                                      F.count_if(F.col("reason") == "unreadable file").alias("unreadable_files"))
    read = good.groupBy("Source").agg(F.count(F.lit(1)).alias("rows_read"), F.count_if(F.col("FullName").contains("\n")).alias("broken_lines"))
    counts = ["rows_read", "odd_records", "bad_bytes", "unreadable_files", "broken_lines"]
    return read.join(tally, "Source", "full").select(
        F.regexp_extract("Source", r"^(\d+)_", 1).cast("int").alias("Year"),
        F.translate(F.regexp_extract("Source", r"^\d+_(.*)_results\.csv$", 1), "_", " ").alias("Circuit"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts])


@register("forecast_headshots", O.with_(O.forecast_ctes() + O.FEATURES + """,
urls AS (SELECT "FullName", "RaceIndex", CASE WHEN "RaceIndex" % 3 <> 0 THEN lower("FullName") || '-' || "Year" END AS url FROM hist),
latest AS (SELECT "FullName", arg_max(coalesce(url, ''), "RaceIndex") AS latest, arg_max(url, "RaceIndex") FILTER (WHERE url IS NOT NULL) AS known
  FROM urls GROUP BY 1)""", """SELECT f."Year", f."Circuit", f."FullName", nullif(l.latest, '') AS "HeadshotUrl", l.known AS "ProfileUrl"
FROM features f JOIN latest l ON l."FullName" = f."FullName\""""), "CLN8", "FCT1", "AGG15")
def q_headshots(spark, sf):
    """A URL column through the layers: the forecast has the latest event's, the profile the last that there is."""
    hist, targets = _forecast_inputs(spark, sf)
    url = F.when(F.col("RaceIndex") % 3 != 0, F.concat_ws("-", F.lower("FullName"), F.col("Year").cast("string")))
    hist = hist.withColumn("HeadshotUrl", url)
    fc = FC.two_stage_forecast(FC.feature_rows(hist, targets)).select("Year", "Circuit", "FullName", "HeadshotUrl")
    profile = FC.entrant_profile(hist, targets).select("Year", "Circuit", "FullName", F.col("HeadshotUrl").alias("ProfileUrl"))
    return fc.join(profile, ["Year", "Circuit", "FullName"], "left")


@register("event_name_union", O.with_(S + "," + SCH, f"""SELECT DISTINCT race_name FROM (
  SELECT "Circuit" AS race_name FROM silver
  UNION SELECT race_name FROM sched WHERE event_date >= {O.AS_OF}) u"""), "SET2")
def q_event_names(spark, sf):
    return SC.event_names(silver_from_tables(spark, sf), _schedule(spark, sf), AS_OF)


# --- fixed values -----------------------------------------------------------------
# Team-name aliases given as literal rows: some nations written in title case.
TEAM_ALIAS_ROWS = [("NATION_0", "Nation 0"), ("NATION_1", "Nation 1"), ("NATION_2", "Nation 2"),
                   ("NATION_3", "Nation 3"), ("NATION_4", "Nation 4")]
# -----------------------------------------------------------------------------------


@register("team_standings_aliased", O.with_(S, """SELECT *,
  CAST(row_number() OVER (PARTITION BY "Year" ORDER BY "Points" DESC, "TeamName") AS INTEGER) AS "Standing",
  CAST(max("Points") OVER (PARTITION BY "Year") - "Points" AS BIGINT) AS "Gap"
FROM (SELECT "Year", coalesce(a.canonical, trim("TeamName")) AS "TeamName",
             CAST(coalesce(sum("Points"), 0) AS BIGINT) AS "Points"
      FROM silver LEFT JOIN (VALUES ('NATION_0', 'Nation 0'), ('NATION_1', 'Nation 1'),
           ('NATION_2', 'Nation 2'), ('NATION_3', 'Nation 3'), ('NATION_4', 'Nation 4')) a(alias, canonical)
        ON trim("TeamName") = a.alias
      GROUP BY 1, 2) t"""), "SRC9", "CLN1")
def q_team_aliased(spark, sf):
    """SRC9/CLN1: an alias table built from literal rows (``createDataFrame``
    with a declared schema), joined onto the results' team names before the
    team standings."""
    from ranklab.operators.silver import normalize_names
    aliases = spark.createDataFrame(TEAM_ALIAS_ROWS, "alias string, canonical string")
    silver = normalize_names(silver_from_tables(spark, sf), "TeamName", aliases)
    return ST.team_standings(silver)
