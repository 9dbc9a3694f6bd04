"""Schedule operators (SCH1-SCH7, SRC11, CLN16) with an explicit ``as_of``.

Nothing reads the wall clock: "now" is always a parameter, so results are
reproducible and testable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklab.operators.silver import rename
from ranklab.sources.tables import read_table

DEFAULT_AS_OF = "1998-06-01 00:00:00"
SCHEDULE_COLUMNS = ("Year", "round_number", "race_name", "country", "location", "event_date",
                    "is_sprint")


def raw_schedule(spark, sf_dir: str) -> DataFrame:
    """A provider-shaped schedule derived from the tables: one event per
    (ship year, brand); its date is the last ship date; round = order in the
    year by date then name; weekend dates use the sprint format."""
    li = read_table(spark, sf_dir, "lineitem", "l_partkey", "l_shipdate")
    part = read_table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type").withColumn("_type", F.split("p_type", " ").getItem(0))
    # first per type word: the least of texts makes an aggregate sort its rows, so it sees one row a word
    ev = (li.join(part, li.l_partkey == part.p_partkey)
            .groupBy(F.year("l_shipdate").cast("int").alias("Year"), F.col("p_brand").alias("Circuit"), "_type")
            .agg(F.max("l_shipdate").alias("EventDate"))
            .groupBy("Year", "Circuit").agg(F.max("EventDate").alias("EventDate"), F.min("_type").alias("Country")))
    w = Window.partitionBy("Year").orderBy("EventDate", "Circuit")
    fmt = F.when(F.dayofweek("EventDate").isin(1, 7), F.lit("sprint_qualifying")).otherwise(
        F.lit("conventional"))
    return ev.select("Year", F.row_number().over(w).alias("RoundNumber"),
                     F.col("Circuit").alias("OfficialEventName"), "EventDate", "Country",
                     F.lower("Circuit").alias("Location"), fmt.alias("EventFormat"))


def standardize_schedule(raw: DataFrame) -> DataFrame:
    """SCH1: provider columns -> standard names, sprint flag, UTC timestamps,
    testing sessions dropped."""
    df = raw.filter(F.coalesce(F.lower(F.col("EventFormat")) != "testing", F.lit(True)))
    df = rename(df, {"OfficialEventName": "race_name", "EventDate": "event_date",
                     "Country": "country", "Location": "location", "RoundNumber": "round_number"})
    sprint = (F.coalesce(F.lower(F.col("EventFormat")).contains("sprint"), F.lit(False))
              if "EventFormat" in raw.columns else F.lit(False))
    df = df.withColumn("is_sprint", sprint).withColumn("event_date", F.to_timestamp("event_date"))
    return df.select(*[c for c in SCHEDULE_COLUMNS if c in df.columns])


MEETING_SCHEMA = ("meeting_key long, meeting_official_name string, meeting_name string, "
                  "country_name string, location string, date_start string")


def schedule_from_json_records(spark, path: str, year: int | None = None) -> DataFrame:
    """SRC11: meeting records (JSON lines) -> standard schedule. Absent keys
    get defaults; a missing meeting key falls back to the record's ordinal
    within its season (file order). ``year`` None = the start date's year."""
    recs = (spark.read.schema(MEETING_SCHEMA).json(path)
            .withColumn("_ord", F.monotonically_increasing_id()))
    yr = F.lit(year) if year is not None else F.year(F.to_timestamp("date_start"))
    recs = recs.withColumn("Year", yr.cast("int"))
    w = Window.partitionBy("Year").orderBy("_ord")  # one season's meetings per group
    pick = F.col
    return recs.select(
        "Year",
        F.coalesce(pick("meeting_key"), F.row_number().over(w)).cast("int").alias("round_number"),
        F.coalesce(pick("meeting_official_name"), pick("meeting_name"), F.lit("")).alias("race_name"),
        F.coalesce(pick("country_name"), F.lit("")).alias("country"),
        F.coalesce(pick("location"), F.lit("")).alias("location"),
        F.to_timestamp(pick("date_start")).alias("event_date"),
        F.lit(False).alias("is_sprint"))


def meeting_records(sched: DataFrame) -> DataFrame:
    """The schedule as provider meeting records (SNK4 input)."""
    return sched.select(F.col("round_number").cast("long").alias("meeting_key"),
                        F.col("race_name").alias("meeting_official_name"),
                        F.col("country").alias("country_name"), "location",
                        F.date_format("event_date", "yyyy-MM-dd'T'HH:mm:ss").alias("date_start"))


def with_status(sched: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """SCH2: 'completed' when the event date is before ``as_of``."""
    return sched.withColumn("status", F.when(F.col("event_date") < F.to_timestamp(F.lit(as_of)),
                                             "completed").otherwise("upcoming"))


def upcoming(sched: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """SCH3: events on or after ``as_of`` in round order."""
    return (sched.filter(F.col("event_date") >= F.to_timestamp(F.lit(as_of)))
            .orderBy("Year", "round_number"))


def next_event(sched: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """SCH4: per season, the first upcoming round (none when the season is over)."""
    up = sched.filter(F.col("event_date") >= F.to_timestamp(F.lit(as_of)))
    return (up.groupBy("Year")
            .agg(F.min_by(F.struct(*[c for c in sched.columns if c != "Year"]), "round_number").alias("e"))
            .select("Year", "e.*"))


def last_completed(sched: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """SCH5: per season, the completed event with the highest round."""
    done = sched.filter(F.col("event_date") < F.to_timestamp(F.lit(as_of)))
    return (done.groupBy("Year")
            .agg(F.max_by(F.struct(*[c for c in sched.columns if c != "Year"]), "round_number").alias("e"))
            .select("Year", "e.*"))


def first_sessions(sched: DataFrame) -> DataFrame:
    """Known first-session starts: sprint weekends publish theirs (Friday
    11:30 UTC, two days and 12.5 hours before the race day); others are
    unknown and fall back to event_date - 2 days."""
    return (sched.filter("is_sprint")
            .select("Year", "round_number",
                    (F.col("event_date") - F.expr("INTERVAL 2 DAYS") + F.expr("INTERVAL 11 HOURS 30 MINUTES"))
                    .alias("fp1_start_utc")))


def lock_deadlines(sched: DataFrame, sessions: DataFrame | None = None,
                   buffer_minutes: int = 0) -> DataFrame:
    """SCH6: deadline = first-session start, else event_date - 2 days, minus
    ``buffer_minutes``."""
    sessions = first_sessions(sched) if sessions is None else sessions
    s = sessions.select(F.col("Year").alias("_y"), F.col("round_number").alias("_r"), "fp1_start_utc")
    j = sched.join(s, (sched["Year"] == s["_y"]) & (sched["round_number"] == s["_r"]), "left")
    start = F.coalesce(F.col("fp1_start_utc"), F.col("event_date") - F.expr("INTERVAL 2 DAYS"))
    return (j.withColumn("lock_deadline", start - F.make_interval(mins=F.lit(buffer_minutes)))
             .drop("_y", "_r"))


def deadline_history(sched: DataFrame, published: DataFrame, buffer_minutes: int = 0) -> DataFrame:
    """SCH6 over time: (Year, race_name, valid_from, lock_deadline). From the
    beginning (``valid_from`` null) an event locks two days before its date;
    each publication of a first-session start (Year, round_number,
    published_at, fp1_start_utc) replaces that from then on, and one without a
    start falls back to it."""
    pub = published.select(F.col("Year").alias("_y"), F.col("round_number").alias("_r"), "published_at", "fp1_start_utc")
    fallback = F.col("event_date") - F.expr("INTERVAL 2 DAYS")
    buffer = F.make_interval(mins=F.lit(buffer_minutes))
    base = sched.select("Year", "race_name", F.lit(None).cast("timestamp").alias("valid_from"), (fallback - buffer).alias("lock_deadline"))
    news = (sched.join(pub, (sched["Year"] == pub["_y"]) & (sched["round_number"] == pub["_r"]))
            .select("Year", "race_name", F.col("published_at").alias("valid_from"),
                    (F.coalesce("fp1_start_utc", fallback) - buffer).alias("lock_deadline")))
    return base.unionByName(news)


def lock_state(deadlines: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """SCH7: locked when as_of >= deadline; an unknown deadline stays open."""
    return deadlines.withColumn(
        "is_locked", F.coalesce(F.to_timestamp(F.lit(as_of)) >= F.col("lock_deadline"), F.lit(False)))


def find_event(sched: DataFrame, name_part: str, required: bool = False) -> DataFrame:
    """CLN16: per season, the first round whose name contains ``name_part``
    (case-insensitive, literal). With ``required`` it raises when no season has
    one (one job that stops at the first hit)."""
    hit = sched.filter(F.lower("race_name").contains(name_part.lower()))
    if required and hit.isEmpty():
        raise LookupError(f"no event's name contains {name_part!r}")
    return (hit.groupBy("Year")
            .agg(F.min_by(F.struct(*[c for c in sched.columns if c != "Year"]), "round_number").alias("e"))
            .select("Year", "e.*"))


def event_names(results: DataFrame, sched: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """SET2: names known from results united with the upcoming schedule's,
    distinct and sorted."""
    known = results.select(F.col("Circuit").alias("race_name"))
    coming = upcoming(sched, as_of).select("race_name")
    return known.union(coming).distinct().orderBy("race_name")


def season_progress(sched: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """AGG23: completed and remaining events per season."""
    t = F.to_timestamp(F.lit(as_of))
    return sched.groupBy("Year").agg(F.count_if(F.col("event_date") < t).alias("completed"),
                                     F.count_if(F.col("event_date") >= t).alias("remaining"))
