"""Ranking inside groups that may be huge.

Per-event ranks are the hot spot of this data model: an event holds every
entrant of that event, so at scale a handful of events own almost all rows and
``Window.partitionBy(event)`` would put each of them into one task.

``rank_within`` therefore has two plans:

* ``skew_safe=False`` - one ``Window`` (fine when groups are small, e.g. per
  entrant or per user);
* ``skew_safe=None`` (default) - measure the largest group and use the
  window when it is under ``WINDOW_GROUP_ROWS``, the sliced plan otherwise;
* ``skew_safe=True`` - the group is cut into ordered *slices* by a range
  partitioning on (group, sort keys). Equal sort keys always land in the same
  slice, so a rank computed inside a slice plus the number of rows of the same
  group in earlier slices is the exact global rank. Slice ids are fixed with a
  reliable ``checkpoint()`` (the range bounds come from sampling; freezing them
  keeps recomputation after an executor loss consistent). Only a table of
  (group, slice, count) - at most groups x slices rows - is windowed per group.

``top_k_within`` keeps the plain window: Spark plans ``rank <= k`` filters with
a partial ``WindowGroupLimit`` before the shuffle, so each map task forwards at
most k rows per group and hot groups never concentrate.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklab.session import ensure_checkpoint_dir

OrderKey = tuple[str | Column, bool]  # (expression, descending)

# Groups up to this many rows are ranked/windowed in one task; larger groups
# take the sliced plans. Override with the Spark conf ``ranklab.windowGroupRows``.
WINDOW_GROUP_ROWS = 1_000_000


def window_group_limit(spark) -> int:
    return int(spark.conf.get("ranklab.windowGroupRows", str(WINDOW_GROUP_ROWS)))


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a reliable checkpoint (the cluster's shared
    ``spark.checkpoint.dir``) and continue from the written data: later
    reads - a size check, several branches - do not recompute the lineage,
    and executor loss cannot force it either."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet under the checkpoint folder and continue
    from the files. For wide layers of a fixed schema: a later read takes only
    the columns that it needs, where a checkpoint is read whole."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/layer-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only after checking its rows and its bytes (the length
    of the rows as JSON; the check stops at ``max_rows + 1`` rows); larger
    inputs stay ordinary join sides. Meant for small dimension-like tables
    (targets, per-season keys) that are already materialized or cheap to
    recompute."""
    size = (df.select(F.octet_length(F.to_json(F.struct("*"))).alias("_bytes")).limit(max_rows + 1)
              .agg(F.count(F.lit(1)).alias("rows"), F.sum("_bytes").alias("bytes")).first())
    return F.broadcast(df) if size["rows"] <= max_rows and (size["bytes"] or 0) <= max_bytes else df


def largest_group(df: DataFrame, group_cols: Sequence[str]) -> int:
    """Row count of the largest group: one aggregation (partial, map-side)
    whose result - a single number - is the size check."""
    if not group_cols:
        return df.count()
    r = df.groupBy(*group_cols).count().agg(F.max("count")).first()[0]
    return int(r or 0)


def needs_slicing(df: DataFrame, group_cols: Sequence[str], skew_safe: bool | None) -> bool:
    """``skew_safe`` True/False forces a plan; None decides by the size of
    the largest group (measured, not guessed)."""
    if skew_safe is not None:
        return skew_safe
    return largest_group(df, group_cols) > window_group_limit(df.sparkSession)

_RANKERS = {
    "rank": F.rank,
    "row_number": F.row_number,
    "dense_rank": F.dense_rank,
}


def _expr(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sort_exprs(order_by: Sequence[OrderKey]) -> list[Column]:
    out = []
    for c, desc in order_by:
        e = _expr(c)
        out.append(e.desc_nulls_last() if desc else e.asc_nulls_last())
    return out


def rank_within(df: DataFrame, group_cols: Sequence[str], order_by: Sequence[OrderKey],
                out: str = "rank", method: str = "rank", skew_safe: bool | None = None,
                slices: int | None = None) -> DataFrame:
    """Add ``out`` = rank/row_number/dense_rank of each row inside its group.

    ``group_cols`` may be empty (one global ranking). The result type is int,
    like Spark's ranking functions. ``skew_safe=None`` measures the largest
    group first (``needs_slicing``), which reads the input once more: callers
    with several rankings over one grouping measure once and pass the answer,
    and keep the input close to a written layer (silver, gold, feature rows).
    """
    ranker = _RANKERS[method]
    sort = _sort_exprs(order_by)
    group = list(group_cols)
    if not needs_slicing(df, group, skew_safe):
        w = Window.partitionBy(*group).orderBy(*sort) if group else Window.orderBy(*sort)
        return df.withColumn(out, ranker().over(w))

    ranged = _slices(df, group, sort, slices)

    local_w = Window.partitionBy(*group, "_slice").orderBy(*sort)
    local = ranged.withColumn(out, ranker().over(local_w))

    if method == "dense_rank":
        keys = [_expr(c) for c, _ in order_by]
        cnt = F.count_distinct(F.struct(*keys)) if keys else F.lit(1)
    else:
        cnt = F.count(F.lit(1))
    counts = ranged.groupBy(*group, "_slice").agg(cnt.cast("long").alias("_n"))
    prior = Window.partitionBy(*group).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1) if group else Window.orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(g).alias(f"_o_{g}") for g in group], F.col("_slice").alias("_o_slice"),
                            F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_off"))
    cond = [F.col("_slice") == F.col("_o_slice")] + [
        F.col(g).eqNullSafe(F.col(f"_o_{g}")) for g in group]
    joined = local.join(offsets, on=cond, how="inner")
    return (joined.withColumn(out, (F.col(out) + F.col("_off")).cast("int"))
                  .drop("_slice", "_o_slice", "_off", *[f"_o_{g}" for g in group]))


def rank_by_value(df: DataFrame, group_cols: Sequence[str], value: str, out: str) -> DataFrame:
    """Rank (method min) by ``value`` descending inside each group, however
    many rows tie: one plus the number of rows with larger values, from the
    counts per distinct (group, value), joined back."""
    counts = materialize(df.groupBy(*group_cols, value).agg(F.count(F.lit(1)).alias("_n")))
    placed = running_within(counts, group_cols, [(value, True)], {"_before": "_n"})
    keys = [*group_cols, value]
    places = broadcast_if_small(materialize(placed.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], (F.col("_before") + 1).cast("int").alias(out))))
    cond = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return df.join(places, cond, "inner").drop(*[f"_k_{k}" for k in keys])


def top_k_within(df: DataFrame, group_cols: Sequence[str], order_by: Sequence[OrderKey],
                 k: int, out: str | None = None, method: str = "row_number") -> DataFrame:
    """Rows ranked <= k inside each group (SRT2). Planned as WindowGroupLimit."""
    sort = _sort_exprs(order_by)
    w = Window.partitionBy(*group_cols).orderBy(*sort) if group_cols else Window.orderBy(*sort)
    col = out or "_rk"
    res = df.withColumn(col, _RANKERS[method]().over(w)).filter(F.col(col) <= k)
    return res if out else res.drop(col)


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row DataFrame (a global aggregate) to
    every row: an equi-join on a constant key with the single row broadcast,
    which is bounded by construction."""
    one = F.lit(1).alias("_one")
    return (df.select("*", one).join(F.broadcast(one_row.select("*", one)), "_one")
              .drop("_one"))


def group_total(df: DataFrame, group_cols: Sequence[str], value: str | Column,
                out: str, how: str = "sum") -> DataFrame:
    """Attach a per-group aggregate to every row via aggregate + join.

    Unlike ``agg().over(partitionBy(group))`` this uses partial (map-side)
    aggregation, so a group holding most rows costs one small shuffle. The
    aggregate table has one row per group; it is broadcast after its size
    check, and beyond it the rows of hot groups are dealt over salts.
    """
    from ranklab.operators.skew import measured_join
    fn = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count, "avg": F.avg}[how]
    agg = df.groupBy(*group_cols).agg(fn(_expr(value)).alias(out))
    if not group_cols:
        return with_scalars(df, agg)
    renamed = agg.select(*[F.col(g).alias(f"_g_{g}") for g in group_cols], out)
    return measured_join(df, renamed, [(g, f"_g_{g}") for g in group_cols], null_safe=True)


def group_totals(df: DataFrame, group_cols: Sequence[str], **totals: Column) -> DataFrame:
    """Attach several per-group aggregates at once: one aggregation, written,
    and one join (broadcast after its size check, salted beyond it)."""
    from ranklab.operators.skew import measured_join
    agg = df.groupBy(*[F.col(g).alias(f"_g_{g}") for g in group_cols]).agg(*[c.alias(n) for n, c in totals.items()])
    return measured_join(df, agg, [(g, f"_g_{g}") for g in group_cols], null_safe=True)


def rolling_rows(df: DataFrame, group_cols: Sequence[str], order_by: Sequence[OrderKey],
                 value: str, k: int, out: str, how: str = "sum",
                 skew_safe: bool | None = None) -> DataFrame:
    """Aggregate of ``value`` over the ``k`` rows before each row of its
    group (frame ROWS BETWEEN k PRECEDING AND 1 PRECEDING), for groups that
    may be huge.

    Each row gets its position ``seq`` in the group (skew-safe row_number),
    then sends its value to the ``k`` following positions (an explode of
    1..k), and the contributions are aggregated per (group, seq) and joined
    back. Every step is keyed by (group, seq), so a hot group spreads over
    all tasks; the cost is k copies of (group, seq, value).
    """
    fn = {"sum": F.sum, "avg": F.avg, "count": F.count, "max": F.max, "min": F.min}[how]
    if not needs_slicing(df, group_cols, skew_safe):
        w = (Window.partitionBy(*group_cols) if group_cols else Window).orderBy(*_sort_exprs(order_by))
        return df.withColumn(out, fn(value).over(w.rowsBetween(-k, -1)))
    seqd = rank_within(df, group_cols, order_by, out="_seq", method="row_number", skew_safe=True)
    sent = (seqd.select(*[F.col(g).alias(f"_r_{g}") for g in group_cols], "_seq",
                        F.col(value).alias("_v"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("_d"))
            .select(*[f"_r_{g}" for g in group_cols], (F.col("_seq") + F.col("_d")).alias("_to"), "_v"))
    agg = sent.groupBy(*[f"_r_{g}" for g in group_cols], "_to").agg(fn("_v").alias(out))
    cond = [F.col("_seq") == F.col("_to")] + [F.col(g).eqNullSafe(F.col(f"_r_{g}")) for g in group_cols]
    return (seqd.join(agg, cond, "left")
                .drop("_to", *[f"_r_{g}" for g in group_cols], "_seq"))


def _slices(df: DataFrame, group: Sequence[str], sort: Sequence[Column],
            slices: int | None = None) -> DataFrame:
    """Range-partition on (group, sort keys), tag each row with its slice id
    and freeze that with a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    keys = [*[F.col(g).asc_nulls_last() for g in group], *sort]
    ranged = df.repartitionByRange(slices, *keys) if slices else df.repartitionByRange(*keys)
    return ranged.withColumn("_slice", F.spark_partition_id()).checkpoint(eager=True)


def running_within(df: DataFrame, group_cols: Sequence[str], order_by: Sequence[OrderKey],
                   sums: dict[str, str | Column], seq: str | None = None,
                   include_current: bool = False, slices: int | None = None) -> DataFrame:
    """Skew-safe running totals per group in ``order_by`` order.

    Adds, for each ``name -> value`` in ``sums``, ``name`` = sum of the value
    over the earlier rows of the group (``include_current`` adds the row
    itself; nulls count as 0) and ``name + '_n'`` = how many of those values
    were non-null; with ``seq`` also the 1-based row number. One slicing pass
    serves all of them: a window inside each (group, slice) plus the totals of
    the group's earlier slices.
    """
    group = list(group_cols)
    sort = _sort_exprs(order_by)
    ranged = _slices(df, group, sort, slices)
    upper = 0 if include_current else -1
    lw = Window.partitionBy(*group, "_slice").orderBy(*sort)
    frame = lw.rowsBetween(Window.unboundedPreceding, upper)
    cols = {}
    for name, v in sums.items():
        e = _expr(v)
        cols[f"_l_{name}"] = F.coalesce(F.sum(F.coalesce(e, F.lit(0))).over(frame), F.lit(0))
        cols[f"_l_{name}_n"] = F.count(e).over(frame)
    if seq:
        cols["_l_seq"] = F.row_number().over(lw)
    local = ranged.withColumns(cols)
    totals = ranged.groupBy(*group, "_slice").agg(
        F.count(F.lit(1)).alias("_t_rows"),
        *[F.coalesce(F.sum(F.coalesce(_expr(v), F.lit(0))), F.lit(0)).alias(f"_t_{n}") for n, v in sums.items()],
        *[F.count(_expr(v)).alias(f"_t_{n}_n") for n, v in sums.items()])
    prior = (Window.partitionBy(*group) if group else Window).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    tcols = ["_t_rows", *[f"_t_{n}" for n in sums], *[f"_t_{n}_n" for n in sums]]
    offsets = totals.select(*[F.col(g).alias(f"_o_{g}") for g in group], F.col("_slice").alias("_o_slice"),
                            *[F.coalesce(F.sum(c).over(prior), F.lit(0)).alias(f"_o{c}") for c in tcols])
    cond = [F.col("_slice") == F.col("_o_slice")] + [F.col(g).eqNullSafe(F.col(f"_o_{g}")) for g in group]
    j = local.join(offsets, cond, "inner")
    out = {}
    for n in sums:
        out[n] = F.col(f"_l_{n}") + F.col(f"_o_t_{n}")
        out[f"{n}_n"] = (F.col(f"_l_{n}_n") + F.col(f"_o_t_{n}_n")).cast("long")
    if seq:
        out[seq] = (F.col("_l_seq") + F.col("_o_t_rows")).cast("int")
    drop = [c for c in j.columns if c.startswith("_l_") or c.startswith("_o")] + ["_slice"]
    return j.withColumns(out).drop(*drop)
