"""STR1: incremental bronze -> silver ingest with Structured Streaming.

The stream watches the bronze folder (file source; its checkpoint remembers
which files were processed, so nothing is read twice). Each micro-batch takes
the names of the events that its new files belong to - at most
``maxFilesPerTrigger`` - scans *all* files of these events, cleans them and
replaces their silver partitions (dynamic partition overwrite). An event whose
files fall into several batches is thus whole after each of them, whatever
``max_files`` is, and re-running a batch after a failure rewrites the same
partitions: idempotent.
``trigger(availableNow=True)`` processes everything new and stops, the shape
of the reference's "one command after each event".
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklab.operators.silver import coerce_numeric, keep_last, normalize_names
from ranklab.sources.bronze import PATH_RE, scan_bronze, source_name
from ranklab.sources.sinks import write_silver

SILVER_KEY = ("Year", "Circuit", "FullName")
STORED = ("FullName", "TeamName", "HeadshotUrl", "Position", "GridPosition", "Points", "ClassifiedPosition",
          "Source", "Year", "Circuit")


def clean_batch(raw: DataFrame, aliases: Mapping[str, str] | DataFrame | None = None) -> DataFrame:
    """Silver rows of one batch (event index is assigned at read time, as it
    depends on every event): names, numbers, drop rows without a finish,
    keep the last row per (event, entrant)."""
    df = coerce_numeric(normalize_names(raw, "FullName", aliases))
    if "ClassifiedPosition" in df.columns:
        df = coerce_numeric(df, ("ClassifiedPosition",))
    else:
        df = df.withColumn("ClassifiedPosition", F.col("Position"))
    df = (df.filter(F.col("Position").isNotNull())
            .withColumn("Position", F.col("Position").try_cast("int")))
    df = keep_last(df, SILVER_KEY, ["Source", "_row"])
    for c in STORED:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df.select(*STORED)


def ingest(spark: SparkSession, bronze_root: str, silver_path: str, checkpoint: str,
           kind: str = "results", min_bytes: int = 200, max_files: int = 1000,
           aliases: Mapping[str, str] | DataFrame | None = None) -> int:
    """Process all new bronze files and return how many were ingested."""
    seen = {"files": 0}

    def on_batch(batch: DataFrame, epoch_id: int) -> None:
        new = batch.filter(F.col("path").rlike(PATH_RE.format(kind=kind))).distinct().collect()  # max_files at most
        if not new:
            return
        raw = scan_bronze(spark, bronze_root, kind, min_bytes, sources=sorted({r["event"] for r in new}), required=False)
        if raw is not None:
            write_silver(clean_batch(raw, aliases), silver_path, ("Year", "Circuit"))
        seen["files"] += len(new)

    stream = (spark.readStream.format("text").option("recursiveFileLookup", "true")
              .option("maxFilesPerTrigger", max_files).load(bronze_root)
              .select(F.col("_metadata.file_path").alias("path"),
                      source_name().alias("event")))
    q = (stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return seen["files"]


def read_silver(spark: SparkSession, silver_path: str) -> DataFrame:
    """SRC8: the ingested silver table with the global event index."""
    from ranklab.operators.silver import with_event_index
    return with_event_index(spark.read.parquet(silver_path))
