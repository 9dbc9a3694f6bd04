"""Sinks (SNK1-SNK6). Every write goes through Spark's job commit: a failed
or lost task never leaves partial output visible as a finished job."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklab.operators.ranking import materialize, rank_within
from ranklab.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: The column that keeps a row's place in its event, however the event is cut into files.
ORDINAL = "RowOrdinal"
FILE_ROWS = 1_000_000
#: Rows of one call of ``write_bronze`` for one event; the next batch begins behind.
BATCH_ROWS = 1 << 40


def write_bronze(bronze: DataFrame, root: str, mode: str = "overwrite", order_by: Sequence[str] = (),
                 max_rows: int = FILE_ROWS, batch: int = 0) -> None:
    """SNK1: CSV files per event: ``Source=<year>_<Event>_<kind>.csv/part-*.csv``
    (the reference's file naming as the partition value), of ``max_rows`` rows
    at most. Rows of an event are numbered in ``order_by`` order (as they come,
    without it); the number is a column of the files, so that the last of
    several copies is the same whatever files they are in. Rows are dealt by
    ranges of (event, number): no event is one task. ``mode='append'`` adds
    files next to existing ones, whose rows come before those of a larger
    ``batch``."""
    rows = materialize(bronze.withColumn("_at", F.monotonically_increasing_id()))
    keys = [(c, False) for c in (*order_by, "_at")]
    numbered = rank_within(rows, ["Source"], keys, out=ORDINAL, method="row_number").drop("_at")
    numbered = numbered.withColumn(ORDINAL, F.col(ORDINAL).cast("long") + F.lit(batch * BATCH_ROWS))
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // max_rows))
    (numbered.repartitionByRange(tasks, "Source", ORDINAL).sortWithinPartitions("Source", ORDINAL)
     .write.mode(mode).option("header", "true").option("escape", '"').option("maxRecordsPerFile", max_rows)
     .partitionBy("Source").csv(root))


def write_broken_archive(spark: SparkSession, path: str, text: str) -> None:
    """A gzip file that ends half way: a test case for readers of damaged bronze."""
    import gzip
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    whole = gzip.compress(text.encode())
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
    try:
        out.write(bytearray(whole[: len(whole) // 2]))
    finally:
        out.close()


def write_silver(silver: DataFrame, path: str, partition_by: tuple[str, ...] = ("Year",)) -> None:
    """SNK2: silver Parquet, partitioned; with dynamic partition overwrite
    only the partitions present in ``silver`` are replaced."""
    (silver.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by).parquet(path))


def _versions(spark: SparkSession, root: str) -> list[tuple[int, str, bool]]:
    """(number, path, committed) of the version folders under ``root``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        kind, _, number = st.getPath().getName().partition("=")
        if st.isDirectory() and kind == "version" and number.isdigit():
            committed = fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS"))
            out.append((int(number), st.getPath().toString(), committed))
    return out


def write_version(df: DataFrame, root: str) -> str:
    """SNK3: write a complete new version folder (job commit makes it
    all-or-nothing) under the next number and return its path; readers use
    ``latest_version``. Of two writers that take the same number, the later
    fails."""
    number = 1 + max((n for n, _, _ in _versions(df.sparkSession, root)), default=0)
    path = f"{root}/version={number}"
    df.write.mode("errorifexists").parquet(path)
    return path


def latest_version(spark: SparkSession, root: str) -> str | None:
    """The committed version folder (has ``_SUCCESS``) of the largest number
    under ``root``; times of folders play no part."""
    return max(((n, path) for n, path, committed in _versions(spark, root) if committed), default=(0, None))[1]


def write_json_records(df: DataFrame, path: str) -> None:
    """SNK4: JSON lines."""
    df.write.mode("overwrite").json(path)


def prediction_text(picks: DataFrame, events: DataFrame) -> DataFrame:
    """SNK6 (content): per season a heading and three bullets for the
    season's next event. ``picks``: Year, PoleSetter, RaceWinner,
    WinningConstructor; ``events``: Year, race_name."""
    j = picks.join(events.select("Year", "race_name"), "Year")
    text = F.format_string("# %d %s GP Prediction\n\n- Pole Setter: %s\n- Race Winner: %s\n"
                           "- Winning Constructor: %s\n", F.col("Year"), F.initcap("race_name"),
                           F.col("PoleSetter"), F.col("RaceWinner"), F.col("WinningConstructor"))
    return j.select("Year", "race_name", text.alias("text"))


def write_text(df: DataFrame, path: str, col: str = "text") -> None:
    """SNK6: one text record per row."""
    df.select(col).write.mode("overwrite").text(path)
