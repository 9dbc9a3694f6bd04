"""As-of join: for each row on the left, the row on the right that was in force
at its time.

Left and right are united and ordered by (key, time), a right row before left
rows of the same time; the row in force is then a running last value. There is no
pair of rows at any point, so neither many changes of a key nor many rows between
two changes cost more than they are. A key that holds more rows than
``ranklab.windowGroupRows`` is cut into ordered slices: the last value is taken
inside each slice, and a table of one row per (key, slice) carries the last value
of the earlier slices over.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklab.operators.ranking import _slices, needs_slicing


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str,
              values: Mapping[str, str], tie: Sequence[str] = (), skew_safe: bool | None = None) -> DataFrame:
    """``left`` with, for each ``name -> column`` of ``values``, the column of
    the right row with equal ``by`` and the latest ``right_time`` not after
    ``left_time``; of right rows of one time the last by ``tie``.

    A right row without a time is in force from the beginning. A left row
    without a time gets only such a row. A null key matches nothing. A value
    that is null in the row in force stays null; earlier rows do not fill it.
    """
    if clash := [n for n in values if n in left.columns]:
        raise ValueError(f"left has columns {clash}")
    keys = [f"_k{i}" for i in range(len(by))]
    row, val = F.struct(*[F.col(c) for c in left.columns]), F.struct(*[F.col(c).alias(n) for n, c in values.items()])
    named = [F.col(c).alias(k) for c, k in zip(by, keys)]
    order = F.struct(*[F.col(c) for c in tie]) if tie else F.lit(0)
    changes = right.select(*named, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), order.alias("_tie"), val.alias("_val"))
    rows = left.select(*named, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), row.alias("_row"))
    both = changes.unionByName(rows, allowMissingColumns=True)
    sort = [F.col("_t").asc_nulls_first(), F.col("_side"), F.col("_tie")]
    so_far = (Window.unboundedPreceding, Window.currentRow)
    if needs_slicing(both, keys, skew_safe):
        ranged = _slices(both, keys, sort)
        local = ranged.withColumn("_now", F.last("_val", ignorenulls=True).over(
            Window.partitionBy(*keys, "_slice").orderBy(*sort).rowsBetween(*so_far)))
        ends = ranged.groupBy(*keys, "_slice").agg(F.max_by("_val", F.when(F.col("_side") == 0, F.struct("_t", "_tie"))).alias("_end"))
        before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*[F.col(k).alias(f"_c{k}") for k in keys], F.col("_slice").alias("_c_slice"),
                              F.last("_end", ignorenulls=True).over(before).alias("_carried"))
        cond = [F.col("_slice") == F.col("_c_slice")] + [F.col(k).eqNullSafe(F.col(f"_c{k}")) for k in keys]
        found = local.filter("_side = 1").join(carried, cond, "left").withColumn("_now", F.coalesce("_now", "_carried"))
    else:
        w = Window.partitionBy(*keys).orderBy(*sort).rowsBetween(*so_far)
        found = both.withColumn("_now", F.last("_val", ignorenulls=True).over(w)).filter("_side = 1")
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return found.select("_row.*", *[F.when(known, F.col("_now")[n]).alias(n) for n in values])
