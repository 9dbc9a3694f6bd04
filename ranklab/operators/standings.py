"""Season, entrant, team and circuit analytics over silver, for all seasons,
entrants, teams and circuits at once (the reference computes one selection
per page view; here the caller filters the keyed result).

Aggregations use partial (map-side) aggregation. Ranks that are per season or
global - a season holds most entrants - use the skew-safe ``rank_within``;
per-circuit top-k lists use ``top_k_within`` (partial WindowGroupLimit).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklab.functions.columns import DNF_POSITION, half_even, is_dnf, safe_div
from ranklab.operators.ranking import group_total, materialize, rank_within, top_k_within



def _win() -> F.Column:
    return F.col("Position") == 1


def _podium() -> F.Column:
    return F.col("Position") <= 3


def _points() -> F.Column:
    return F.coalesce(F.sum("Points"), F.lit(0)).cast("long")


def entrant_form(results: DataFrame, keys: Sequence[str] = ("FullName", "TeamName")) -> DataFrame:
    """AGG1: starts, wins, podiums, points per entrant (and team)."""
    return (results.groupBy(*keys)
            .agg(F.count("Position").alias("starts"),
                 F.count_if(_win()).alias("wins"),
                 F.count_if(_podium()).alias("podiums"),
                 _points().alias("points")))


def season_standings(results: DataFrame, skew_safe: bool | None = None) -> DataFrame:
    """AGG2 (+AGG4, WIN12, WIN13): per (Year, entrant) points, last non-null
    team by event order, wins, podiums, races; championship position (ties
    broken by name) and gap to the season leader."""
    agg = (results.groupBy("Year", "FullName")
           .agg(_points().alias("Points"),
                F.max_by("TeamName", F.when(F.col("TeamName").isNotNull(), F.col("RaceIndex")))
                 .alias("TeamName"),
                F.count_if(_win()).alias("Wins"),
                F.count_if(_podium()).alias("Podiums"),
                F.count("Position").alias("Races")))
    # the standings table (entrants x seasons) is written once: the size
    # check, the ranking and the leader's total all read it
    agg = materialize(agg)
    ranked = rank_within(agg, ["Year"], [("Points", True), ("FullName", False)],
                         out="Standing", method="row_number", skew_safe=skew_safe)
    lead = group_total(ranked, ["Year"], "Points", "_lead", how="max")
    return lead.withColumn("Gap", (F.col("_lead") - F.col("Points")).cast("long")).drop("_lead")


def team_standings(results: DataFrame, skew_safe: bool | None = None) -> DataFrame:
    """AGG3: team points per season, position and gap."""
    agg = (results.filter(F.col("TeamName").isNotNull())
           .groupBy("Year", "TeamName").agg(_points().alias("Points")))
    agg = materialize(agg)
    ranked = rank_within(agg, ["Year"], [("Points", True), ("TeamName", False)],
                         out="Standing", method="row_number", skew_safe=skew_safe)
    lead = group_total(ranked, ["Year"], "Points", "_lead", how="max")
    return lead.withColumn("Gap", (F.col("_lead") - F.col("Points")).cast("long")).drop("_lead")


def dnf_tally(results: DataFrame, threshold: int = DNF_POSITION) -> DataFrame:
    """AGG5: races, DNFs and DNF rate in percent (1 dp, half-even)."""
    agg = (results.groupBy("Year", "FullName")
           .agg(F.count("Position").alias("Races"),
                F.count_if(is_dnf("Position", threshold)).alias("DNFs")))
    return agg.withColumn("DNFRate", half_even(safe_div(F.col("DNFs") * 100, F.col("Races")), 1))


def career_summary(results: DataFrame, threshold: int = DNF_POSITION) -> DataFrame:
    """AGG6: per entrant races (all rows), wins, podiums, DNFs, mean finish,
    mean grid (missing grids skipped)."""
    return (results.groupBy("FullName")
            .agg(F.count(F.lit(1)).alias("Races"),
                 F.count_if(_win()).alias("Wins"),
                 F.count_if(_podium()).alias("Podiums"),
                 F.count_if(is_dnf("Position", threshold)).alias("DNFs"),
                 F.avg("Position").alias("AvgFinish"),
                 F.avg("GridPosition").alias("AvgGrid")))


def circuit_average(results: DataFrame, keys: Sequence[str] = ("FullName",)) -> DataFrame:
    """AGG7: mean finish per key and circuit (entrant, or Year+team)."""
    return results.groupBy(*keys, "Circuit").agg(F.avg("Position").alias("AvgFinish"))


def grid_delta(results: DataFrame) -> DataFrame:
    """AGG8: mean (grid - finish) per entrant and circuit, rows with both."""
    both = results.filter(F.col("GridPosition").isNotNull() & F.col("Position").isNotNull())
    return (both.groupBy("FullName", "Circuit")
            .agg(F.avg(F.col("GridPosition") - F.col("Position")).alias("Delta")))


def team_entrants(results: DataFrame) -> DataFrame:
    """AGG9: each team's entrants per season: points, wins, podiums, races."""
    return (results.groupBy("Year", "TeamName", "FullName")
            .agg(_points().alias("Points"), F.count_if(_win()).alias("Wins"),
                 F.count_if(_podium()).alias("Podiums"), F.count("Position").alias("Races")))


def points_split(results: DataFrame) -> DataFrame:
    """AGG10: points per (Year, team, circuit, entrant)."""
    return (results.groupBy("Year", "TeamName", "Circuit", "FullName")
            .agg(_points().alias("Points")))


def historical_stats(results: DataFrame, threshold: int = DNF_POSITION,
                     skew_safe: bool | None = None) -> DataFrame:
    """AGG11: per season *and* all-time in one pass (GROUPING SETS).
    ``Scope`` is the season as text, or 'All Time'."""
    agg = (results.groupingSets([["Year", "FullName"], ["FullName"]], "Year", "FullName")
           .agg(F.count("Position").alias("Races"), F.count_if(_win()).alias("Wins"),
                F.count_if(_podium()).alias("Podiums"), _points().alias("Points"),
                half_even(F.avg("Position"), 2).alias("AvgFinish"),
                F.count_if(is_dnf("Position", threshold)).alias("DNFs"),
                F.grouping("Year").alias("_all")))
    agg = agg.withColumn("Scope", F.when(F.col("_all") == 1, F.lit("All Time"))
                         .otherwise(F.col("Year").cast("string"))).drop("_all", "Year")
    agg = materialize(agg)  # read by the size check and the ranking
    return rank_within(agg, ["Scope"], [("Points", True), ("FullName", False)],
                       out="Rank", method="row_number", skew_safe=skew_safe)


def circuit_winners(results: DataFrame, k: int = 10) -> DataFrame:
    """AGG12: most wins per circuit, top k (ties by name)."""
    wins = results.filter(_win()).groupBy("Circuit", "FullName").agg(F.count(F.lit(1)).alias("Wins"))
    return top_k_within(wins, ["Circuit"], [("Wins", True), ("FullName", False)], k, out="Rank")


def circuit_best_average(results: DataFrame, k: int = 10) -> DataFrame:
    """AGG13: best mean finish per circuit (2 dp), top k."""
    avg = (results.groupBy("Circuit", "FullName")
           .agg(half_even(F.avg("Position"), 2).alias("AvgFinish")))
    return top_k_within(avg, ["Circuit"], [("AvgFinish", False), ("FullName", False)], k, out="Rank")


def circuit_winner_list(results: DataFrame) -> DataFrame:
    """AGG14/SRT3: every circuit's winners, newest season first."""
    return (results.filter(_win()).select("Circuit", "Year", "FullName", "TeamName")
            .orderBy(F.col("Circuit"), F.col("Year").desc()))


def distinct_counts(results: DataFrame) -> DataFrame:
    """AGG18: rows, distinct entrants, circuits and events."""
    return results.agg(F.count(F.lit(1)).alias("Rows"),
                       F.count_distinct("FullName").alias("Entrants"),
                       F.count_distinct("Circuit").alias("Circuits"),
                       F.count_distinct("Year", "Circuit").alias("Events"))


#: log2 of a sketch's registers: a standard error of 0.4 %, at most 64 KiB a sketch.
SKETCH_K = 16


def event_sketches(results: DataFrame, entity: str = "FullName") -> DataFrame:
    """AGG18, mergeable: per event a sketch of its distinct ``entity`` values.
    Sketches roll up to any coarser key without the rows (``rollup_distinct``)."""
    return results.groupBy("Year", "Circuit").agg(F.hll_sketch_agg(entity, SKETCH_K).alias("Sketch"))


def rollup_distinct(sketches: DataFrame) -> DataFrame:
    """Estimated distinct counts by (Year, Circuit), by Year and of all time
    (nulls where a level spans all values), from the events' sketches alone.
    ``Level`` is the number of keys given up. A level merges its finer one, so
    the last step reads one sketch a season. Null values are not counted; without
    events the count of all time is 0."""
    union = F.hll_union_agg("Sketch").alias("Sketch")
    seasons = sketches.groupBy("Year").agg(union)
    ever = seasons.agg(union)
    rows = (sketches.withColumn("Level", F.lit(0))
            .unionByName(seasons.withColumn("Level", F.lit(1)), allowMissingColumns=True)
            .unionByName(ever.withColumn("Level", F.lit(2)), allowMissingColumns=True))
    return rows.select("Level", "Year", "Circuit", F.hll_sketch_estimate("Sketch").alias("Estimate"))


def heuristic_pick(standings: DataFrame, skew_safe: bool | None = None) -> DataFrame:
    """AGG19/FCT5: per season, the top entrant by points is both pole setter
    and winner; the top team by summed entrant points wins the constructors'
    pick. Ties go to the smaller name."""
    top_e = top_k_within(standings, ["Year"], [("Points", True), ("FullName", False)], 1)
    teams = standings.groupBy("Year", "TeamName").agg(_points().alias("TeamPoints"))
    top_t = top_k_within(teams, ["Year"], [("TeamPoints", True), ("TeamName", False)], 1)
    return (top_e.select("Year", F.col("FullName").alias("PoleSetter"),
                         F.col("FullName").alias("RaceWinner"))
            .join(top_t.select("Year", F.col("TeamName").alias("WinningConstructor")), "Year"))


def distinct_values(results: DataFrame) -> DataFrame:
    """AGG25: the sorted distinct value lists (years, circuits, entrants,
    teams) as (Kind, Value) rows."""
    parts = [results.select(F.lit(k).alias("Kind"), F.col(c).cast("string").alias("Value"))
             for k, c in (("year", "Year"), ("circuit", "Circuit"), ("entrant", "FullName"),
                          ("team", "TeamName"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.col("Value").isNotNull()).distinct().orderBy("Kind", "Value")


def points_progression(results: DataFrame, standings: DataFrame, top_n: int = 10) -> DataFrame:
    """WIN11/JON6: running points per entrant through a season in circuit
    order, for the season's top-N entrants (left-semi join)."""
    from pyspark.sql import Window
    top = standings.filter(F.col("Standing") <= top_n).select("Year", "FullName")
    w = (Window.partitionBy("Year", "FullName").orderBy("Circuit")
         .rowsBetween(Window.unboundedPreceding, 0))
    return (results.join(top, ["Year", "FullName"], "left_semi")
            .select("Year", "FullName", "Circuit", "Points",
                    F.sum("Points").over(w).cast("long").alias("CumPoints")))


def rival_pairs(hist: DataFrame) -> DataFrame:
    """Head-to-head pairs derived from the all-time table: every entrant with
    the entrant ranked right above it. One pair per entrant, so the pair
    table grows linearly (never all pairs of an event)."""
    at = hist.filter(F.col("Scope") == "All Time").select("FullName", "Rank")
    above = at.select(F.col("FullName").alias("DriverA"), F.col("Rank").alias("_r"))
    below = at.select(F.col("FullName").alias("DriverB"), (F.col("Rank") - 1).alias("_r"))
    return above.join(below, "_r").drop("_r")


def head_to_head(results: DataFrame, pairs: DataFrame, threshold: int = DNF_POSITION) -> DataFrame:
    """JON7/SET3: for each requested pair (DriverA, DriverB), the events both
    entered and six metrics per side. Each side is an equi-join of results to
    the pair table, then an equi-join on (pair, event): work is linear in the
    results times pairs-per-entrant."""
    p = pairs.select("DriverA", "DriverB").distinct()
    a = (results.join(p, results["FullName"] == p["DriverA"])
         .select("DriverA", "DriverB", "Year", "Circuit", F.col("Position").alias("pa"),
                 F.col("GridPosition").alias("ga")))
    b = (results.join(p, results["FullName"] == p["DriverB"])
         .select(F.col("DriverA").alias("_a"), F.col("DriverB").alias("_b"),
                 F.col("Year").alias("_y"), F.col("Circuit").alias("_c"),
                 F.col("Position").alias("pb"), F.col("GridPosition").alias("gb")))
    common = a.join(b, (a["DriverA"] == b["_a"]) & (a["DriverB"] == b["_b"])
                    & (a["Year"] == b["_y"]) & (a["Circuit"] == b["_c"]))
    return (common.groupBy("DriverA", "DriverB")
            .agg(F.count(F.lit(1)).alias("RacesTogether"),
                 F.count_if(F.col("pa") == 1).alias("WinsA"),
                 F.count_if(F.col("pb") == 1).alias("WinsB"),
                 F.count_if(F.col("pa") <= 3).alias("PodiumsA"),
                 F.count_if(F.col("pb") <= 3).alias("PodiumsB"),
                 half_even(F.avg("pa"), 2).alias("AvgFinishA"),
                 half_even(F.avg("pb"), 2).alias("AvgFinishB"),
                 half_even(F.avg("ga"), 2).alias("AvgGridA"),
                 half_even(F.avg("gb"), 2).alias("AvgGridB"),
                 F.count_if(F.col("pa") > threshold).alias("DNFsA"),
                 F.count_if(F.col("pb") > threshold).alias("DNFsB")))
