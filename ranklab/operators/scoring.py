"""Scoring predicted finishing orders against actual ones (EVL4, JON8, TXT3).

Relational form: both orders are (key, rank, name) rows. A prediction's rows
are left-joined to its event's actual rows on (event, name) and aggregated per
prediction - no per-prediction Python, no arrays in the hot path. Starting
from the *prediction* rows keeps predictions that share no name with the
actual order (hits 0, MAE 0.0, rho null; Q26).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklab.functions.columns import half_even
from ranklab.operators.skew import measured_join

LIST_CAP = 20


def first_positions(rows: DataFrame, keys: Sequence[str], rank_col: str, name_col: str,
                    cap: int = LIST_CAP) -> DataFrame:
    """Cut a list to ``cap`` entries and keep each name's first position (Q12)."""
    return (rows.filter(F.col(rank_col) <= cap)
            .groupBy(*keys, name_col).agg(F.min(rank_col).alias(rank_col)))


def score_orders(pred: DataFrame, actual: DataFrame, pred_keys: Sequence[str],
                 event_keys: Sequence[str], pred_rank: str = "pp", actual_rank: str = "ap",
                 name: str = "driver", headers: DataFrame | None = None) -> DataFrame:
    """Score every prediction.

    ``pred``: pred_keys + event_keys + pred_rank + name (1-based ranks).
    ``actual``: event_keys + actual_rank + name.
    ``headers``: optional pred_keys + event_keys rows for predictions that may
    have an empty list; they score all-null like predictions of events
    without an actual order.
    """
    p = first_positions(pred, [*pred_keys, *event_keys], pred_rank, name)
    a = first_positions(actual, list(event_keys), actual_rank, name)
    a_r = a.select(*[F.col(k).alias(f"_a_{k}") for k in event_keys],
                   F.col(name).alias("_a_name"), F.col(actual_rank).alias("_ap"))
    # many predictions of an event name the same entrant
    j = measured_join(p, a_r, [*[(k, f"_a_{k}") for k in event_keys], (name, "_a_name")])
    pp, ap = F.col(pred_rank), F.col("_ap")
    n = F.count(ap)
    d2 = F.sum((pp - ap) * (pp - ap))
    rho = F.when(n >= 2, F.greatest(F.lit(-1.0), F.least(F.lit(1.0),
                 1 - (6 * d2).cast("double") / (n * (n * n - 1)).cast("double"))))
    stats = (j.groupBy(*pred_keys, *event_keys)
             .agg((F.count_if((pp == 1) & (ap == 1)) > 0).alias("winner_correct"),
                  F.count_if((pp <= 3) & (ap <= 3)).cast("int").alias("podium_hits"),
                  F.count_if((pp <= 10) & (ap <= 10)).cast("int").alias("top10_hits"),
                  half_even(F.coalesce(F.avg(F.abs(pp - ap)), F.lit(0.0)), 3).alias("position_mae"),
                  half_even(rho, 4).alias("spearman_rho")))
    has_actual = a.select(*event_keys).distinct().withColumn("_has_actual", F.lit(True))
    base = headers.select(*pred_keys, *event_keys).distinct() if headers is not None else \
        p.select(*pred_keys, *event_keys).distinct()
    out = (base.join(stats, [*pred_keys, *event_keys], "left")
           .join(has_actual, list(event_keys), "left"))
    ok = F.col("_has_actual").isNotNull() & F.col("winner_correct").isNotNull()
    metrics = ["winner_correct", "podium_hits", "top10_hits", "position_mae", "spearman_rho"]
    return out.select(*pred_keys, *event_keys,
                      *[F.when(ok, F.col(m)).alias(m) for m in metrics])


def summary_text(scored: DataFrame) -> DataFrame:
    """TXT3: one line per scored prediction; rho may be null ('n/a')."""
    rho = F.when(F.col("spearman_rho").isNull(), F.lit("n/a")).otherwise(
        F.format_string("%.3f", F.bround("spearman_rho", 3)))
    line = F.concat(
        F.lit("Winner "), F.when(F.col("winner_correct"), F.lit("✅")).otherwise(F.lit("❌")),
        F.lit(" | Podium: "), F.col("podium_hits").cast("string"), F.lit("/3 | Top-10: "),
        F.col("top10_hits").cast("string"), F.lit("/10 | Pos MAE: "),
        F.format_string("%.1f", F.bround("position_mae", 1)), F.lit(" | Spearman ρ: "), rho)
    return scored.withColumn("summary", F.when(F.col("winner_correct").isNull(),
                                               F.lit("Not yet scored.")).otherwise(line))
