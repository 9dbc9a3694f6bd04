"""Tables of which a merge rewrites only the partitions it touches (OPS1, OPS3).

Below ``root`` lie

* ``data/_commit=<id>/_part=<digest of the keys>/``: Parquet files, never changed;
* ``manifest/<id>/``: a row per live partition (its keys, ``_part``, the
  ``_commit`` that holds its rows, their number and the version that wrote it);
* ``log/<n>``: the manifest and schema of version n, one small JSON file.

A merge writes the new state of touched partitions, then a manifest that takes
all others over from its base, and becomes version n + 1 by a rename that fails
where that name exists: of two writers on one base the later gets ``BaseMoved``
and nothing of it can be seen. A writer that dies leaves folders that no
manifest names.

Defined cases: a null key is a partition like any other; a touched partition
without rows leaves the table; a column that a later commit adds is null in
older files; a column whose type changes raises ``ValueError``; a table without
a version reads as None. Columns named ``_commit`` or ``_part`` are refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ranklab.operators.ranking import broadcast_if_small, materialize

HIDDEN = ("_commit", "_part")


class BaseMoved(RuntimeError):
    """Another commit took the version that would have followed the base."""


@dataclass(frozen=True)
class Version:
    number: int
    commit: str
    schema: StructType
    partition_by: tuple[str, ...]


def part_of(partition_by: Sequence[str]) -> Column:
    """The name of a row's partition: a digest of its keys, nulls included."""
    return F.md5(F.to_json(F.struct(*partition_by), {"ignoreNullFields": "false"}))


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, root: str) -> Version | None:
    """The latest version, None before the first commit."""
    folder, fs = _hadoop_path(spark, f"{root}/log")
    if not fs.exists(folder):
        return None
    names = [st.getPath().getName() for st in fs.listStatus(folder)]
    numbers = [int(n) for n in names if n.isdigit()]
    return version(spark, root, max(numbers)) if numbers else None


def version(spark: SparkSession, root: str, number: int) -> Version:
    """Version ``number``; older ones stay readable."""
    entry = json.loads(spark.read.option("wholetext", "true").text(f"{root}/log/{number}").first()[0])
    return Version(number, entry["commit"], StructType.fromJson(entry["schema"]), tuple(entry["partition_by"]))


def manifest(spark: SparkSession, root: str, at: Version) -> DataFrame:
    """A row per live partition of a version: keys, ``_part``, ``_commit``, ``_rows``, ``_version``."""
    return spark.read.parquet(f"{root}/manifest/{at.commit}")


def _stored(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    # their types are given, or digests of digits would be read as numbers
    whole = StructType([*schema.fields, *(StructField(name, StringType()) for name in HIDDEN)])
    return spark.read.schema(whole).parquet(f"{root}/data")


def read(spark: SparkSession, root: str, keys: DataFrame | None = None, at: Version | None = None) -> DataFrame | None:
    """The rows of a version (the latest without ``at``), or of the partitions
    that ``keys`` names by the partition columns. The manifest prunes the scan:
    folders of replaced, or of other, partitions are listed but not opened."""
    at = at or current(spark, root)
    if at is None:
        return None
    live = manifest(spark, root, at).filter(F.col("_rows") > 0)  # a filter on this side lets Spark prune the other
    if keys is not None:
        wanted = materialize(keys.select(part_of(at.partition_by).alias("_part")).distinct())
        live = live.join(broadcast_if_small(wanted), "_part", "left_semi")
    live = broadcast_if_small(live.select(*HIDDEN))
    return _stored(spark, root, at.schema).join(live, list(HIDDEN), "left_semi").drop(*HIDDEN)


def _merged_schema(old: StructType, new: StructType) -> StructType:
    types = {f.name: f.dataType.simpleString() for f in old}  # whether elements may be null plays no part
    changed = [f.name for f in new if types.get(f.name, f.dataType.simpleString()) != f.dataType.simpleString()]
    if changed:
        raise ValueError(f"stored with another type: {', '.join(changed)}")
    return StructType([*old.fields, *(f for f in new if f.name not in types)])


def commit(changed: DataFrame, root: str, partition_by: Sequence[str], base: Version | None,
           touched: DataFrame | None = None) -> Version:
    """``changed`` (the whole new state of the partitions that it touches)
    becomes the version after ``base``, whose other partitions stay as they
    are. ``touched`` names partitions that are replaced even where ``changed``
    has no row for them. Rows are rebalanced by partition: a large one is split
    over tasks and files, small ones share a task. Raises ``BaseMoved`` where
    another commit came first."""
    spark, keys = changed.sparkSession, list(partition_by)
    clash = sorted(set(HIDDEN) & set(changed.columns))
    if clash:
        raise ValueError(f"reserved columns: {', '.join(clash)}")
    if base is not None and tuple(keys) != base.partition_by:
        raise ValueError(f"the table is partitioned by {', '.join(base.partition_by)}")
    schema = changed.schema if base is None else _merged_schema(base.schema, changed.schema)
    name, number = uuid.uuid4().hex, 1 if base is None else base.number + 1

    named = changed.withColumn("_part", part_of(keys))
    named.hint("rebalance", "_part").write.partitionBy("_part").parquet(f"{root}/data/_commit={name}")
    new = materialize(_stored(spark, root, changed.schema).filter(F.col("_commit") == name)
                      .groupBy(*keys, *HIDDEN).agg(F.count(F.lit(1)).alias("_rows"))
                      .withColumn("_version", F.lit(number).cast("long")))
    live = new
    if base is not None:
        gone = new.select("_part")
        if touched is not None:
            gone = gone.unionByName(touched.select(part_of(keys).alias("_part")))
        live = manifest(spark, root, base).join(gone.distinct(), "_part", "left_anti").select(*new.columns).unionByName(new)
    live.write.parquet(f"{root}/manifest/{name}")
    _claim(spark, root, number, {"commit": name, "schema": schema.jsonValue(), "partition_by": keys})
    return Version(number, name, schema, tuple(keys))


def _claim(spark: SparkSession, root: str, number: int, entry: dict) -> None:
    """Write the entry beside the log and rename it to its number, which fails where that exists."""
    jvm = spark.sparkContext._jvm
    draft, fs = _hadoop_path(spark, f"{root}/log/.{entry['commit']}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps(entry).encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(draft, jvm.org.apache.hadoop.fs.Path(f"{root}/log/{number}"), options)
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        raise BaseMoved(f"version {number} of {root} exists: read it and merge again") from None
