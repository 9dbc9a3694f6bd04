"""Column-level helpers. Everything returns a ``Column`` built from
``pyspark.sql.functions`` so it stays JVM-side inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Strings pandas' CSV reader treats as missing by default; bronze cells holding
# one of these are null in silver, exactly as the pandas pipeline sees them.
PANDAS_NA_STRINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
# Points per finishing position (positions 1 to 10; every other position 0).
POINTS_BY_POSITION = {1: 25, 2: 18, 3: 15, 4: 12, 5: 10, 6: 8, 7: 6, 8: 4, 9: 2, 10: 1}
# Entrant-name aliases resolved to one canonical spelling.
DEFAULT_NAME_ALIASES = {
    "Andrea Kimi Antonelli": "Kimi Antonelli",
    "Andrea Kimi ANTONELLI": "Kimi Antonelli",
    "ANTONELLI": "Kimi Antonelli",
    "Isack HADJAR": "Isack Hadjar",
    "Oliver BEARMAN": "Oliver Bearman",
    "Franco COLAPINTO": "Franco Colapinto",
    "Jack DOOHAN": "Jack Doohan",
    "Gabriel BORTOLETO": "Gabriel Bortoleto",
    "Liam LAWSON": "Liam Lawson",
    "Nico HÜLKENBERG": "Nico Hulkenberg",
    "Nico Hülkenberg": "Nico Hulkenberg",
}
# Finishing positions above this count as "did not finish".
DNF_POSITION = 20
# ---------------------------------------------------------------------------


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def na_to_null(c: str | Column) -> Column:
    """Trimmed string, or null when the cell is one of the pandas NA markers."""
    s = F.trim(col_(c).cast("string"))
    return F.when(col_(c).isNull() | s.isin(*PANDAS_NA_STRINGS)
                  | col_(c).cast("string").isin(*PANDAS_NA_STRINGS), None).otherwise(s)


def to_number(c: str | Column) -> Column:
    """pandas ``to_numeric(errors='coerce')`` for a bronze cell (CLN2).

    ``try_cast`` instead of ``cast``: with ANSI mode a bad value would fail the
    job. NaN is mapped to null because pandas treats it as missing.
    """
    d = na_to_null(c).try_cast("double")
    return F.when(F.isnan(d), None).otherwise(d)


def guarded_int(c: str | Column, sentinel: str = "22") -> Column:
    """Regex-guarded cast of the compatibility path (CLN3): keep the value if
    it starts with a digit, else the sentinel; then float -> int."""
    s = col_(c).cast("string")
    kept = F.when(s.rlike("^[0-9]"), s).otherwise(F.lit(sentinel))
    return kept.try_cast("float").cast("int")


def clean_name(c: str | Column) -> Column:
    """Null/NA -> 'Unknown', else trimmed (the alias lookup is a join, see
    ``operators.silver.normalize_names``)."""
    return F.coalesce(na_to_null(c), F.lit("Unknown"))


def points_for(position: str | Column, table: Mapping[int, int] = POINTS_BY_POSITION) -> Column:
    """Points awarded for a finishing position."""
    expr = None
    pos = col_(position)
    for p, pts in sorted(table.items()):
        expr = (F.when(pos == p, F.lit(pts)) if expr is None
                else expr.when(pos == p, F.lit(pts)))
    return expr.otherwise(F.lit(0)).cast("int")


def is_dnf(position: str | Column, threshold: int = DNF_POSITION) -> Column:
    return col_(position) > F.lit(threshold)


def half_even(c: str | Column, digits: int) -> Column:
    """pandas/numpy rounding (half to even) == Spark ``bround``."""
    return F.bround(col_(c), digits)


def safe_div(num: Column, den: Column) -> Column:
    """num / den, null when den is null or 0 (never raises under ANSI)."""
    return F.when(den.isNull() | (den == 0), F.lit(None).cast("double")).otherwise(
        num.cast("double") / den.cast("double"))


def first_word_lower(c: str | Column) -> Column:
    """Lower-cased first word of a name: the circuit keyword (CLN15)."""
    return F.lower(F.split(F.trim(col_(c)), " ").getItem(0))


def join_labels(labels: list[Column], sep: str, default: str) -> Column:
    """Join the non-null labels with ``sep``; ``default`` when none apply."""
    arr = F.filter(F.array(*labels), lambda x: x.isNotNull())
    return F.when(F.size(arr) == 0, F.lit(default)).otherwise(F.array_join(arr, sep))
