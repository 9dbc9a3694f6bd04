"""DuckDB oracle SQL: an independent, plain-SQL statement of every query.

The tables ``lineitem part supplier nation events ...`` are views. Fragments
below are WITH-clause building blocks shared by the per-query statements.
"""

from __future__ import annotations

POINTS_CASE = """CASE position WHEN 1 THEN 25 WHEN 2 THEN 18 WHEN 3 THEN 15 WHEN 4 THEN 12
    WHEN 5 THEN 10 WHEN 6 THEN 8 WHEN 7 THEN 6 WHEN 8 THEN 4 WHEN 9 THEN 2 WHEN 10 THEN 1
    ELSE 0 END"""

# results fixture + silver
SILVER = f"""
sales AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS yr, p_brand AS circuit, s_suppkey AS sk,
         s_name AS driver, n_name AS team,
         sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS rev,
         sum(CAST(l_quantity AS BIGINT)) AS qty
  FROM lineitem JOIN part ON l_partkey = p_partkey
       JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey
  GROUP BY 1, 2, 3, 4, 5),
res AS (
  SELECT yr, circuit, driver, team, sk,
         CAST(row_number() OVER (PARTITION BY yr, circuit ORDER BY rev DESC, sk) AS INTEGER) AS position,
         CAST(row_number() OVER (PARTITION BY yr, circuit ORDER BY qty DESC, sk) AS INTEGER) AS qgrid
  FROM sales),
silver AS (
  SELECT yr AS "Year", circuit AS "Circuit", driver AS "FullName", team AS "TeamName",
         position AS "Position",
         CASE WHEN sk % 17 = 3 THEN NULL ELSE qgrid END AS "GridPosition",
         CAST({POINTS_CASE} AS INTEGER) AS "Points",
         CAST(dense_rank() OVER (ORDER BY yr, circuit) - 1 AS INTEGER) AS "RaceIndex",
         sk
  FROM res)"""

# gold features over silver, grid from the qualifying sessions
GOLD = SILVER + """,
quali AS (
  SELECT yr, circuit, driver, qgrid AS g, 1 AS session FROM res
  UNION ALL
  SELECT yr, circuit, driver, position AS g, 2 AS session FROM res WHERE position <= 3),
quali_last AS (
  SELECT yr, circuit, driver, g FROM (
    SELECT *, row_number() OVER (PARTITION BY yr, circuit, driver ORDER BY session DESC) AS rn
    FROM quali WHERE g IS NOT NULL) t WHERE rn = 1),
g0 AS (
  SELECT s.*, CAST(coalesce(q.g, s."GridPosition", 10) AS DOUBLE) AS grid,
         CAST(coalesce(q.g, s."GridPosition") AS DOUBLE) AS raw_grid
  FROM silver s LEFT JOIN quali_last q
    ON s."Year" = q.yr AND s."Circuit" = q.circuit AND s."FullName" = q.driver),
g1 AS (
  SELECT *,
    avg("Position") OVER (PARTITION BY "FullName" ORDER BY "RaceIndex" ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS f3,
    avg("Position") OVER (PARTITION BY "FullName" ORDER BY "RaceIndex" ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS f5,
    avg("Position") OVER (PARTITION BY "FullName" ORDER BY "RaceIndex" ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS f10,
    avg(grid) OVER (PARTITION BY "FullName" ORDER BY "RaceIndex" ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS g5,
    CASE WHEN lag("Position") OVER (PARTITION BY "FullName" ORDER BY "RaceIndex") > 20
         THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS dnf_prev,
    CAST(coalesce(sum("Points") OVER (PARTITION BY "FullName" ORDER BY "RaceIndex"
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS cum,
    avg("Position") OVER (PARTITION BY "FullName", "Circuit" ORDER BY "RaceIndex"
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS circ_avg,
    sum(CASE WHEN "Position" = 1 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)
        OVER (PARTITION BY "FullName", "Circuit" ORDER BY "RaceIndex"
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS circ_wins
  FROM g0),
team_event AS (
  SELECT "TeamName" AS tn, "RaceIndex" AS tri, CAST(coalesce(sum("Points"), 0) AS DOUBLE) AS tp
  FROM silver WHERE "TeamName" IS NOT NULL GROUP BY 1, 2),
team_roll AS (
  SELECT tn, tri, sum(tp) OVER (PARTITION BY tn ORDER BY tri ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS tp5
  FROM team_event),
gold AS (
  SELECT g1."Year", g1."Circuit", g1."FullName", g1."TeamName",
    CAST(g1."RaceIndex" AS DOUBLE) AS "RaceIndex",
    CAST(g1."Position" AS DOUBLE) AS "Position",
    CAST(g1."Position" AS DOUBLE) AS "ClassifiedPosition",
    grid AS "GridPosition", raw_grid AS "RawGrid",
    CAST(g1."Points" AS DOUBLE) AS "Points",
    f3 AS "AvgFinishLast3", f5 AS "AvgFinishLast5", f10 AS "AvgFinishLast10",
    g5 AS "AvgGridLast5",
    avg(dnf_prev) OVER (PARTITION BY "FullName" ORDER BY "RaceIndex" ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS "DNFRateLast10",
    tr.tp5 AS "TeamPointsLast5",
    coalesce(tr.tp5, CAST(0 AS DOUBLE)) AS "TeamForm",
    coalesce(circ_avg, f5) AS "CircuitAvgFinish",
    coalesce(circ_wins, CAST(0 AS DOUBLE)) AS "CircuitWins",
    cum AS "CumPoints",
    CAST(rank() OVER (PARTITION BY g1."RaceIndex" ORDER BY cum DESC) AS DOUBLE) AS "ChampPos",
    CAST(CASE WHEN g1."Position" = 1 THEN 1 ELSE 0 END AS DOUBLE) AS "IsWinner",
    CAST(CASE WHEN g1."Position" <= 3 THEN 1 ELSE 0 END AS DOUBLE) AS "IsTop3",
    CAST(CASE WHEN g1."Position" <= 10 THEN 1 ELSE 0 END AS DOUBLE) AS "IsTop10"
  FROM g1 LEFT JOIN team_roll tr ON g1."TeamName" = tr.tn AND g1."RaceIndex" = tr.tri)"""

GOLD_SELECT = """SELECT "Year", "Circuit", "FullName", "TeamName", "RaceIndex", "Position",
  "ClassifiedPosition", "GridPosition", "Points", "AvgFinishLast3", "AvgFinishLast5",
  "AvgFinishLast10", "AvgGridLast5", "DNFRateLast10", "TeamPointsLast5", "TeamForm",
  "CircuitAvgFinish", "CircuitWins", "CumPoints", "ChampPos", "IsWinner", "IsTop3", "IsTop10"
FROM gold"""


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body}"

AS_OF = "TIMESTAMP '1998-06-01 00:00:00'"

SCHEDULE = """
raw_sched AS (
  SELECT yr AS "Year",
         CAST(row_number() OVER (PARTITION BY yr ORDER BY ed, circuit) AS INTEGER) AS rn,
         circuit, ed, country, lower(circuit) AS loc,
         CASE WHEN dayofweek(ed) IN (0, 6) THEN 'sprint_qualifying' ELSE 'conventional' END AS fmt
  FROM (SELECT CAST(year(l_shipdate) AS INTEGER) AS yr, p_brand AS circuit, max(l_shipdate) AS ed,
               min(split_part(p_type, ' ', 1)) AS country
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) e),
sched AS (
  SELECT "Year", rn AS round_number, circuit AS race_name, country, loc AS location,
         ed AS event_date, coalesce(contains(lower(fmt), 'sprint'), false) AS is_sprint
  FROM raw_sched WHERE coalesce(lower(fmt) <> 'testing', true)),
deadlines AS (
  SELECT *, coalesce(fp1_start_utc, event_date - INTERVAL 2 DAY) AS lock_deadline
  FROM (SELECT *, CASE WHEN is_sprint THEN event_date - INTERVAL 2 DAY + INTERVAL '11 hours 30 minutes' END
                  AS fp1_start_utc FROM sched) s)"""

STRATEGY = """
strat AS (
  SELECT 1 AS user_id, "Year", "Circuit", "FullName" AS driver, "TeamName" AS team, "GridPosition" AS k FROM gold
  UNION ALL
  SELECT 2, "Year", "Circuit", "FullName", "TeamName", coalesce("AvgFinishLast5", CAST(99 AS DOUBLE)) FROM gold
  UNION ALL
  SELECT 3, "Year", "Circuit", "FullName", "TeamName", "ChampPos" FROM gold),
strat_p AS (
  SELECT *, round_even(score / sum(score) OVER (PARTITION BY user_id, "Year", "Circuit"), 4) AS prob,
         CAST(row_number() OVER (PARTITION BY user_id, "Year", "Circuit" ORDER BY k, driver) AS INTEGER) AS pos
  FROM (SELECT *, CAST(1 AS DOUBLE) / greatest(k, CAST(1 AS DOUBLE)) AS score FROM strat) s),
preds AS (SELECT user_id, "Year", "Circuit", pos, driver, team, prob FROM strat_p WHERE pos <= 10),
act AS (SELECT * FROM (
          SELECT "Year" AS year, "Circuit" AS race_name, "FullName" AS driver,
                 row_number() OVER (PARTITION BY "Year", "Circuit" ORDER BY "Position", "FullName") AS ap
          FROM silver WHERE "Position" IS NOT NULL) a WHERE ap <= 20),
pj AS (
  SELECT p.user_id, p."Year" AS year, p."Circuit" AS race_name, p.pos AS pp, a.ap
  FROM preds p LEFT JOIN act a ON a.year = p."Year" AND a.race_name = p."Circuit" AND a.driver = p.driver),
scored AS (
  SELECT user_id, year, race_name,
    count(*) FILTER (WHERE pp = 1 AND ap = 1) > 0 AS winner_correct,
    CAST(count(*) FILTER (WHERE pp <= 3 AND ap <= 3) AS INTEGER) AS podium_hits,
    CAST(count(*) FILTER (WHERE pp <= 10 AND ap <= 10) AS INTEGER) AS top10_hits,
    round_even(coalesce(avg(abs(pp - ap)), CAST(0 AS DOUBLE)), 3) AS position_mae,
    CASE WHEN count(ap) >= 2 THEN round_even(greatest(CAST(-1 AS DOUBLE), least(CAST(1 AS DOUBLE),
      1 - CAST(6 * sum((pp - ap) * (pp - ap)) AS DOUBLE)
          / CAST(count(ap) * (count(ap) * count(ap) - 1) AS DOUBLE))), 4) END AS spearman_rho
  FROM pj GROUP BY 1, 2, 3),
scored_text AS (
  SELECT *, CASE WHEN winner_correct IS NULL THEN 'Not yet scored.' ELSE
    'Winner ' || CASE WHEN winner_correct THEN '✅' ELSE '❌' END ||
    ' | Podium: ' || podium_hits || '/3 | Top-10: ' || top10_hits ||
    '/10 | Pos MAE: ' || printf('%.1f', round_even(position_mae, 1)) ||
    ' | Spearman ρ: ' || CASE WHEN spearman_rho IS NULL THEN 'n/a'
                             ELSE printf('%.3f', round_even(spearman_rho, 3)) END END AS status
  FROM scored)"""

SUBMISSIONS = """
subs AS (
  SELECT event_id, user_id, CAST(ts AS DATE) AS day, ts, event_type, value,
         CAST(json_extract(props, '$.k') AS INTEGER) AS k
  FROM events WHERE event_type IN ('click', 'purchase')),
effective AS (
  SELECT * EXCLUDE (rn), CAST(day AS TIMESTAMP) + INTERVAL 12 HOUR AS lock_deadline FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY ts DESC, event_id DESC) AS rn
    FROM subs WHERE ts < CAST(day AS TIMESTAMP) + INTERVAL 12 HOUR) t WHERE rn = 1)"""

FORECAST = """
hist AS (
  SELECT g.* FROM gold g WHERE EXISTS (
    SELECT 1 FROM sched s WHERE s."Year" = g."Year" AND s.race_name = g."Circuit" AND s.event_date < {as_of})),
targets AS (
  SELECT "Year", race_name AS "Circuit" FROM (
    SELECT *, row_number() OVER (PARTITION BY "Year" ORDER BY round_number) AS rn
    FROM sched WHERE event_date >= {as_of}) t WHERE rn = 1),
seasons AS (
  SELECT "Year", nc, lag("Year") OVER (ORDER BY "Year") AS prev
  FROM (SELECT "Year", count(DISTINCT "Circuit") AS nc FROM hist GROUP BY 1) s),
tsel AS (
  SELECT t."Year", t."Circuit", coalesce({sel_expr}, (SELECT max("Year") FROM seasons)) AS sel
  FROM targets t LEFT JOIN seasons s ON s."Year" = t."Year"),
tseason AS (
  SELECT t."Year", t."Circuit", t.sel AS season FROM tsel t
  UNION
  SELECT t."Year", t."Circuit", x.prev FROM tsel t JOIN seasons x ON x."Year" = t.sel
  WHERE x.nc < 3 AND x.prev IS NOT NULL),
active AS (
  SELECT DISTINCT ts."Year", ts."Circuit", h."FullName"
  FROM tseason ts JOIN hist h ON h."Year" = ts.season WHERE h."FullName" IS NOT NULL),
circ AS (
  SELECT t."Year", t."Circuit", h."FullName",
         sum(h."Position") / count(h."Position") AS circ_avg,
         count(*) FILTER (WHERE h."Position" = 1) AS circ_wins
  FROM targets t JOIN hist h
    ON contains(lower(h."Circuit"), lower(split_part(trim(t."Circuit"), ' ', 1)))
  GROUP BY 1, 2, 3)"""

FEATURES = """,
lastv AS (
  SELECT "FullName", arg_max("TeamName", "RaceIndex") AS "TeamName", avg("Position") AS overall,
    arg_max("AvgFinishLast3", "RaceIndex") FILTER (WHERE "AvgFinishLast3" IS NOT NULL) AS l3,
    arg_max("AvgFinishLast5", "RaceIndex") FILTER (WHERE "AvgFinishLast5" IS NOT NULL) AS l5,
    arg_max("AvgFinishLast10", "RaceIndex") FILTER (WHERE "AvgFinishLast10" IS NOT NULL) AS l10,
    arg_max("AvgGridLast5", "RaceIndex") FILTER (WHERE "AvgGridLast5" IS NOT NULL) AS lg5,
    arg_max("DNFRateLast10", "RaceIndex") FILTER (WHERE "DNFRateLast10" IS NOT NULL) AS ldnf,
    arg_max("TeamPointsLast5", "RaceIndex") FILTER (WHERE "TeamPointsLast5" IS NOT NULL) AS ltp,
    arg_max("TeamForm", "RaceIndex") FILTER (WHERE "TeamForm" IS NOT NULL) AS ltf,
    arg_max("ChampPos", "RaceIndex") FILTER (WHERE "ChampPos" IS NOT NULL) AS lcp
  FROM hist GROUP BY 1),
features AS (
  SELECT a."Year", a."Circuit", a."FullName", l."TeamName",
    coalesce(l3, CAST(10 AS DOUBLE)) AS "AvgFinishLast3", coalesce(l5, CAST(10 AS DOUBLE)) AS "AvgFinishLast5",
    coalesce(l10, CAST(10 AS DOUBLE)) AS "AvgFinishLast10", coalesce(lg5, CAST(10 AS DOUBLE)) AS "AvgGridLast5",
    coalesce(ldnf, CAST(0.05 AS DOUBLE)) AS "DNFRateLast10", coalesce(ltp, CAST(0 AS DOUBLE)) AS "TeamPointsLast5",
    coalesce(ltf, CAST(0 AS DOUBLE)) AS "TeamForm", coalesce(lcp, CAST(10 AS DOUBLE)) AS "ChampPos",
    coalesce(c.circ_avg, l.overall) AS "CircuitAvgFinish",
    CAST(coalesce(c.circ_wins, 0) AS DOUBLE) AS "CircuitWins",
    coalesce(lg5, CAST(10 AS DOUBLE)) AS "GridPosition"
  FROM active a JOIN lastv l ON a."FullName" = l."FullName"
  LEFT JOIN circ c ON c."Year" = a."Year" AND c."Circuit" = a."Circuit" AND c."FullName" = a."FullName")"""

TWO_STAGE = """,
s1 AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY "Year", "Circuit"
           ORDER BY CAST(1 AS DOUBLE) / greatest("AvgGridLast5", CAST(1 AS DOUBLE)) DESC, "FullName") AS INTEGER)
         AS "PredictedGrid"
  FROM features),
s2 AS (
  SELECT *, CAST(1 AS DOUBLE) / (CAST("PredictedGrid" AS DOUBLE) + greatest("AvgFinishLast5", CAST(1 AS DOUBLE))) AS w,
         CAST(3 AS DOUBLE) / (CAST("PredictedGrid" AS DOUBLE) + greatest("CircuitAvgFinish", CAST(1 AS DOUBLE))
                              + CAST(1 AS DOUBLE)) AS t3
  FROM s1),
s3 AS (
  SELECT *, CAST(0.6 AS DOUBLE) * w + CAST(0.4 AS DOUBLE) * t3 AS comb FROM s2),
s4 AS (
  SELECT *, sum(comb) OVER (PARTITION BY "Year", "Circuit") AS tc,
         sum(w) OVER (PARTITION BY "Year", "Circuit") AS tw,
         sum(t3) OVER (PARTITION BY "Year", "Circuit") AS tt
  FROM s3),
fc AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY "Year", "Circuit"
           ORDER BY CASE WHEN tc > 0 THEN comb / tc ELSE comb END DESC, "FullName") AS INTEGER) AS "PredictedFinish"
  FROM s4),
forecast AS (
  SELECT "Year", "Circuit", "PredictedFinish" AS "PredictedRank", "FullName", "TeamName", "PredictedGrid",
    "PredictedFinish",
    round_even(CASE WHEN tw = 0 THEN NULL ELSE w / tw END * 100, 1) AS "WinProbability",
    round_even(CASE WHEN tt = 0 THEN NULL ELSE t3 / tt END * 100, 1) AS "PodiumProbability",
    "CircuitAvgFinish", "AvgFinishLast5", "AvgGridLast5", "DNFRateLast10", "ChampPos",
    coalesce(nullif(concat_ws(' · ',
      CASE WHEN "PredictedGrid" <= 3 THEN '🏁 Front-row starter'
           WHEN "PredictedGrid" <= 6 THEN '🔵 Strong qualifier' END,
      CASE WHEN "CircuitAvgFinish" < "AvgFinishLast5" - 2 THEN '🏟️ Track specialist' END,
      CASE WHEN "DNFRateLast10" < 0.05 THEN '🔧 Reliable finisher'
           WHEN "DNFRateLast10" > 0.25 THEN '⚠️ DNF risk' END,
      CASE WHEN "ChampPos" <= 3 THEN '🏆 Championship leader'
           WHEN "ChampPos" <= 6 THEN '📈 Title contender' END,
      CASE WHEN "TeamForm" > 50 THEN '⚡ Team momentum' END), ''), '📊 Historical data') AS "Reasons"
  FROM fc)"""

LEGACY = """,
h2 AS (SELECT * FROM hist WHERE "FullName" IN (SELECT "FullName" FROM active)),
overall AS (
  SELECT "FullName", avg("Position") AS avg_finish_overall,
         arg_max("TeamName", "RaceIndex") FILTER (WHERE "TeamName" IS NOT NULL) AS "TeamName",
         avg("RawGrid") AS avg_quali_pos
  FROM h2 GROUP BY 1),
circ2 AS (
  SELECT t."Year", t."Circuit", h."FullName", sum(h."Position") / count(h."Position") AS circ_avg
  FROM targets t JOIN h2 h ON contains(lower(h."Circuit"), lower(split_part(trim(t."Circuit"), ' ', 1)))
  GROUP BY 1, 2, 3),
tform AS (
  SELECT "TeamName", CAST(coalesce(sum("Points"), 0) AS DOUBLE) AS team_form FROM (
    SELECT *, row_number() OVER (PARTITION BY "TeamName" ORDER BY "Year" DESC, "Circuit" DESC, "FullName" DESC) AS rn
    FROM h2 WHERE "TeamName" IS NOT NULL) x WHERE rn <= 5 GROUP BY 1),
prof0 AS (
  SELECT a."Year", a."Circuit", a."FullName", o."TeamName", o.avg_finish_overall, o.avg_quali_pos,
         c.circ_avg, tf.team_form
  FROM active a LEFT JOIN overall o ON o."FullName" = a."FullName"
  LEFT JOIN circ2 c ON c."Year" = a."Year" AND c."Circuit" = a."Circuit" AND c."FullName" = a."FullName"
  LEFT JOIN tform tf ON tf."TeamName" = o."TeamName"),
mid AS (SELECT "Year", "Circuit", quantile_cont(team_form, 0.5) AS med FROM prof0 GROUP BY 1, 2),
pct AS (
  SELECT p."Year", p."Circuit", any_value(m.med) AS med, quantile_cont(coalesce(p.team_form, m.med), 0.75) AS p75
  FROM prof0 p LEFT JOIN mid m ON m."Year" = p."Year" AND m."Circuit" = p."Circuit" GROUP BY 1, 2),
profile AS (
  SELECT p."Year", p."Circuit", p."FullName", p."TeamName",
    coalesce(p.avg_finish_overall, CAST(12 AS DOUBLE)) AS avg_finish_overall,
    coalesce(p.avg_quali_pos, CAST(12 AS DOUBLE)) AS avg_quali_pos,
    coalesce(p.circ_avg, coalesce(p.avg_finish_overall, CAST(12 AS DOUBLE))) AS avg_finish_circuit,
    coalesce(p.team_form, q.med) AS team_form, q.p75 AS team_form_p75
  FROM prof0 p LEFT JOIN pct q ON q."Year" = p."Year" AND q."Circuit" = p."Circuit"),
profile2 AS (
  SELECT *, avg_finish_overall - avg_finish_circuit AS track_delta,
         avg_finish_overall - avg_finish_circuit > 2.0 AS track_specialist FROM profile)"""

LEGACY_FORECAST = """,
l1 AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY "Year", "Circuit"
      ORDER BY CAST(1 AS DOUBLE) / greatest(avg_quali_pos, CAST(1 AS DOUBLE)) DESC, "FullName") AS INTEGER) AS "PredictedGrid"
  FROM profile2),
l2 AS (
  SELECT *, CAST(1 AS DOUBLE) / (CAST("PredictedGrid" AS DOUBLE) + greatest(avg_finish_overall, CAST(1 AS DOUBLE))) AS base,
         max(avg_finish_circuit) OVER (PARTITION BY "Year", "Circuit") AS mx,
         min(avg_finish_circuit) OVER (PARTITION BY "Year", "Circuit") AS mn
  FROM l1),
l3 AS (
  SELECT *, base * (CAST(1 AS DOUBLE) + CAST(0.3 AS DOUBLE) * ((mx - avg_finish_circuit)
                / greatest(mx - mn, CAST(1 AS DOUBLE)) - CAST(0.5 AS DOUBLE))) AS wp FROM l2),
l4 AS (
  SELECT *, CASE WHEN sum(wp) OVER (PARTITION BY "Year", "Circuit") > 0
                 THEN wp / sum(wp) OVER (PARTITION BY "Year", "Circuit") ELSE wp END AS winp FROM l3),
legacy AS (
  SELECT "Year", "Circuit", "FullName", "TeamName", "PredictedGrid",
    CAST(row_number() OVER (PARTITION BY "Year", "Circuit" ORDER BY winp DESC, "FullName") AS INTEGER) AS "PredictedFinish",
    round_even(winp, 6) AS "WinProbability", avg_finish_circuit, avg_finish_overall, team_form,
    coalesce(nullif(concat_ws(' · ',
      CASE WHEN track_specialist THEN '📍 Track Specialist' END,
      CASE WHEN "PredictedGrid" <= 3 THEN '🎯 Pole Contender' END,
      CASE WHEN avg_finish_circuit <= 5 THEN '🔥 Circuit Ace' END,
      CASE WHEN team_form >= team_form_p75 THEN '🚀 Team Momentum' END,
      CASE WHEN avg_finish_overall <= 6 THEN '💪 Season Form' END), ''), '📈 Consistent Pace') AS "Reasons"
  FROM l4)"""


def forecast_ctes(as_of: str = AS_OF, target_year: bool = True) -> str:
    sel = 's."Year"' if target_year else "CAST(NULL AS INTEGER)"
    return GOLD + "," + SCHEDULE + "," + FORECAST.format(as_of=as_of, sel_expr=sel)

ML_TASKS = """,
task_rows AS (
  SELECT 'race_winner_model' AS model, 'IsWinner' AS target, "RaceIndex", "IsWinner" AS y,
         "AvgGridLast5" AS g5 FROM gold
  WHERE "GridPosition" IS NOT NULL AND "AvgFinishLast5" IS NOT NULL AND "AvgFinishLast3" IS NOT NULL
    AND "AvgGridLast5" IS NOT NULL AND "TeamForm" IS NOT NULL AND "DNFRateLast10" IS NOT NULL
    AND "CircuitAvgFinish" IS NOT NULL AND "CircuitWins" IS NOT NULL AND "ChampPos" IS NOT NULL
  UNION ALL
  SELECT 'pole_position_model', 'IsPole', "RaceIndex", CASE WHEN "GridPosition" = 1 THEN 1 ELSE 0 END, "AvgGridLast5"
  FROM gold
  WHERE "AvgFinishLast5" IS NOT NULL AND "AvgFinishLast3" IS NOT NULL
    AND "AvgGridLast5" IS NOT NULL AND "TeamForm" IS NOT NULL AND "DNFRateLast10" IS NOT NULL
    AND "CircuitAvgFinish" IS NOT NULL AND "CircuitWins" IS NOT NULL AND "ChampPos" IS NOT NULL
  UNION ALL
  SELECT 'top3_model', 'IsTop3', "RaceIndex", "IsTop3", "AvgGridLast5" FROM gold
  WHERE "GridPosition" IS NOT NULL AND "AvgFinishLast5" IS NOT NULL AND "AvgFinishLast3" IS NOT NULL
    AND "AvgGridLast5" IS NOT NULL AND "TeamForm" IS NOT NULL AND "DNFRateLast10" IS NOT NULL
    AND "CircuitAvgFinish" IS NOT NULL AND "CircuitWins" IS NOT NULL AND "ChampPos" IS NOT NULL),
cuts AS (
  SELECT model, target, count(*) AS n_rows, avg(CAST(y AS DOUBLE)) AS positive_rate,
         quantile_cont("RaceIndex", 0.85) AS cutoff
  FROM task_rows GROUP BY 1, 2),
test_rows AS (
  SELECT t.model, t.y, CAST(1 AS DOUBLE) / greatest(t.g5, CAST(1 AS DOUBLE)) AS p
  FROM task_rows t JOIN cuts c ON c.model = t.model WHERE t."RaceIndex" > c.cutoff),
ranked AS (
  SELECT model, y, p, rank() OVER (PARTITION BY model ORDER BY p) AS r,
         count(*) OVER (PARTITION BY model, p) AS c FROM test_rows)"""
