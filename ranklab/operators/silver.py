"""Silver layer: typed, cleaned results with a global event index.

Operators: CLN1 name normalisation, CLN2 numeric coercion, CLN3 guarded cast,
CLN4 classified-position fallback, CLN5 drop unusable rows, CLN6/JON1 event
index, CLN8 present-column projection, CLN9 renames, SET4/SRC5 keep-last dedupe.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklab.functions.columns import DEFAULT_NAME_ALIASES, clean_name, guarded_int, to_number

EVENT = ("Year", "Circuit")


def alias_frame(spark, aliases: Mapping[str, str] | DataFrame) -> DataFrame:
    """Alias table (alias, canonical) from a dict or an existing DataFrame."""
    if isinstance(aliases, DataFrame):
        return aliases.select(F.col(aliases.columns[0]).alias("_alias"),
                              F.col(aliases.columns[1]).alias("_canonical"))
    rows = sorted(aliases.items())
    return spark.createDataFrame(rows, "_alias string, _canonical string")


def normalize_names(df: DataFrame, col: str = "FullName",
                    aliases: Mapping[str, str] | DataFrame | None = None) -> DataFrame:
    """CLN1: null/NA -> 'Unknown', trim, then an exact alias lookup.

    The alias table (a dict becomes one) is a left join, broadcast after a
    size check.
    """
    aliases = DEFAULT_NAME_ALIASES if aliases is None else aliases
    cleaned = df.withColumn(col, clean_name(col))
    if not isinstance(aliases, DataFrame) and not aliases:
        return cleaned
    from ranklab.operators.ranking import broadcast_if_small
    amap = broadcast_if_small(alias_frame(df.sparkSession, aliases))
    return (cleaned.join(amap, cleaned[col] == amap["_alias"], "left")
                   .withColumn(col, F.coalesce(F.col("_canonical"), F.col(col)))
                   .drop("_alias", "_canonical"))


def present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """CLN8: project the listed columns that exist, in the listed order."""
    return df.select(*[c for c in cols if c in df.columns])


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """CLN9: presentation renames (absent columns are ignored)."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def coerce_numeric(df: DataFrame, cols: Sequence[str] = ("Position", "GridPosition", "Points")) -> DataFrame:
    """CLN2 on the listed columns that exist."""
    return df.withColumns({c: to_number(c) for c in cols if c in df.columns})


def guarded_positions(df: DataFrame, cols: Sequence[str] = ("ClassifiedPosition", "GridPosition"),
                      sentinel: str = "22") -> DataFrame:
    """CLN3: the compatibility path's regex-guarded integer cast."""
    return df.withColumns({c: guarded_int(c, sentinel) for c in cols if c in df.columns})


def keep_last(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """SRC5/SET4/Q9: one row per key, the last one in ``order_cols`` order.

    An aggregation, not a window: ``max_by(row, order)`` is combined map-side,
    so a key with a huge number of copies is reduced to one row per map task
    before the shuffle instead of landing whole in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*[F.col(c) for c in order_cols]) if order_cols else F.lit(0)
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return last.select(*keys, "_last.*").select(*df.columns)


def event_index(df: DataFrame, keys: Sequence[str] = EVENT, out: str = "RaceIndex") -> DataFrame:
    """CLN6: distinct events ordered by (Year, Circuit) -> 0..n-1.

    The ordering runs on the distinct-event table only (one row per event), so
    the un-partitioned window never sees fact rows.
    """
    w = Window.orderBy(*[F.col(k).asc_nulls_first() for k in keys])
    return (df.select(*keys).distinct()
              .withColumn(out, (F.row_number().over(w) - 1).cast("int")))


def with_event_index(df: DataFrame, keys: Sequence[str] = EVENT, out: str = "RaceIndex") -> DataFrame:
    """JON1: left join the event index back onto the rows. Event keys are the
    hottest keys of the model (an event holds every entrant), so the index -
    one row per event, written once - is broadcast after a size check
    instead of hash-joined; beyond the limit it stays a join side (AQE's skew
    handling splits hot partitions)."""
    from ranklab.operators.ranking import broadcast_if_small, materialize
    idx = broadcast_if_small(materialize(event_index(df, keys, out)))
    return df.join(idx, list(keys), "left")


def typed_bronze(raw: DataFrame, aliases: Mapping[str, str] | DataFrame | None = None,
                 normalize: bool = False) -> DataFrame:
    """Bronze rows with numbers coerced but *no* rows dropped - the input the
    season / entrant / team analytics use, so an entrant's points from a
    race without a classified finish still count. Adds the event index (the
    event order for "last team")."""
    df = normalize_names(raw, "FullName", aliases) if normalize else raw
    return with_event_index(coerce_numeric(df))


def clean_silver(raw: DataFrame, aliases: Mapping[str, str] | DataFrame | None = None) -> DataFrame:
    """CLN1-CLN6 in one pass: names, numbers, classified-position fallback,
    drop rows without a finish, integer finish, event index. The cleaned rows
    are written once: the index and every later read start from them, not from
    the bronze files."""
    from ranklab.operators.ranking import materialize
    df = normalize_names(raw, "FullName", aliases)
    df = coerce_numeric(df)
    if "ClassifiedPosition" in df.columns:
        df = df.withColumn("ClassifiedPosition", to_number("ClassifiedPosition"))
    else:
        df = df.withColumn("ClassifiedPosition", F.col("Position"))
    df = (df.filter(F.col("Position").isNotNull() & F.col("FullName").isNotNull())
            .withColumn("Position", F.col("Position").try_cast("int")))
    return with_event_index(materialize(df))
