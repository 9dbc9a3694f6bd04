"""Joins whose left side has hot keys.

``measured_join`` broadcasts the right side when a check of its size allows it.
Beyond that it counts the left rows per key. A key is *hot* when it holds more
than a ``CHUNKS``-th of an average shuffle partition, so there are at most
``CHUNKS`` x partitions hot keys whatever the data: their table is broadcast by
that bound. Rows of a hot key are dealt over as many salts as it has chunks, and
only the right rows of hot keys are copied, once a salt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklab.operators.ranking import broadcast_if_small, materialize

#: Pieces of a shuffle partition; a key of more rows than a piece is dealt over salts.
CHUNKS = 32
#: Left sides of up to this many rows are joined as they are.
LEAST_ROWS = 1_000_000


def _equal(a: Column, b: Column, null_safe: bool) -> Column:
    return a.eqNullSafe(b) if null_safe else a == b


def hot_keys(left: DataFrame, keys: Sequence[str], partitions: int, chunks: int = CHUNKS) -> tuple[DataFrame | None, float]:
    """(keys with more rows than a piece, as ``_h0``.. with ``_salts``; the
    rows of a piece), or (None, ...) without any."""
    counts = materialize(left.groupBy(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("_rows")))
    piece = (counts.agg(F.sum("_rows")).first()[0] or 0) / (partitions * chunks)
    hot = counts.filter(F.col("_rows") > max(piece, 1)).withColumn("_salts", F.ceil(F.col("_rows") / max(piece, 1)).cast("int")).drop("_rows")
    return (None if hot.isEmpty() else hot), piece


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], how: str = "left", null_safe: bool = False,
                least_rows: int = LEAST_ROWS) -> DataFrame:
    """``left`` joined (``left`` or ``inner``) to ``right`` on the pairs of
    ``on`` (left column, right column, of different names); the right key
    columns are dropped. Null keys match only with ``null_safe``, but are dealt
    over salts like any other hot key."""
    spark, lk, rk = left.sparkSession, [a for a, _ in on], [b for _, b in on]
    whole = lambda x, y: [_equal(x[a], y[b], null_safe) for a, b in on]
    held = materialize(left.withColumn("_id", F.monotonically_increasing_id()))
    hot = None
    if held.count() > least_rows:
        hot, _ = hot_keys(held, lk, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if hot is None:
        plain = held.drop("_id")
        return plain.join(right, whole(plain, right), how).drop(*rk)
    hot = materialize(hot)
    at = lambda df, names: [df[k].eqNullSafe(hot[f"_h{i}"]) for i, k in enumerate(names)]
    names = [f"_h{i}" for i in range(len(on))]
    salted = (held.join(F.broadcast(hot), at(held, lk), "left").drop(*names)
              .withColumn("_salt", F.pmod(F.xxhash64("_id"), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_id", "_salts"))
    copies = (right.join(F.broadcast(hot), at(right, rk), "left").drop(*names)
              .withColumn("_copy", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts"))
    return salted.join(copies, [*whole(salted, copies), salted["_salt"] == copies["_copy"]], how).drop(*rk, "_salt", "_copy")


def measured_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], how: str = "left", null_safe: bool = False) -> DataFrame:
    """Broadcast join after a check of the right side's size, salted join beyond it."""
    right = materialize(right)
    small = broadcast_if_small(right)
    if small is right:
        return salted_join(left, right, on, how, null_safe)
    cond = [_equal(left[a], small[b], null_safe) for a, b in on]
    return left.join(small, cond, how).drop(*[b for _, b in on])
