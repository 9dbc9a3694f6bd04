"""A bronze scan that sets damage aside instead of failing on it (SRC1, SRC7).

Three kinds of damage are told apart:

* ``unreadable file``: a compressed file that cannot be read to its end (a
  truncated archive). All of it is set aside, also the records in front of the
  damage, for nothing says that they are whole;
* ``column count``: a record with more or fewer cells than its file's header;
* ``bad bytes``: a record with bytes that are no UTF-8.

A quoted line break is no damage: it belongs to its cell. Everything is
distributed; the driver sees the distinct headers only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklab.operators.ranking import broadcast_if_small, materialize
from ranklab.sources.bronze import _wanted, headers, known_headers, named_columns, read_cells, source_name

#: Files of these endings can break off; others are read as they are.
COMPRESSED = r"\.(gz|bz2|deflate|zst|snappy|lz4)$"
BAD_SCHEMA = "Source string, path string, record string, reason string"
_MARK = "\ufffd"  # what a reader puts for bytes that are no UTF-8


def unreadable_files(spark: SparkSession, root: str, kind: str = "results", years: Sequence[int] | None = None,
                     sources: Sequence[str] | None = None) -> DataFrame:
    """(Source, _path) of compressed files that end before their data do: those
    listed (no content is read for that) without those that can be read whole."""
    wanted = _wanted(kind, years, sources) & F.col("_metadata.file_path").rlike(COMPRESSED)
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).filter(wanted)
              .select(source_name().alias("Source"), F.col("_metadata.file_path").alias("_path")))
    whole = (spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").text(root, wholetext=True)
             .filter(wanted).select(F.col("_metadata.file_path").alias("_path"), F.length("value").alias("n")).filter("n is not null"))
    return listed.join(whole, "_path", "left_anti").select("Source", "_path")


def cells_of(record: F.Column) -> F.Column:
    """Number of cells of a record's text: separators outside quotes, and one."""
    bare = F.regexp_replace(record, '(?s)"(?:[^"]|"")*("|$)', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def scan_with_quarantine(spark: SparkSession, root: str, kind: str = "results", min_bytes: int = 200,
                         years: Sequence[int] | None = None, sources: Sequence[str] | None = None) -> tuple[DataFrame | None, DataFrame]:
    """(rows as ``scan_bronze`` gives them, damage as Source, path, record,
    reason). The rows are None when no file is left to read."""
    lost = materialize(unreadable_files(spark, root, kind, years, sources))
    bad_files = lost.select("Source", F.col("_path").alias("path"), F.lit(None).cast("string").alias("record"), F.lit("unreadable file").alias("reason"))
    files = materialize(headers(spark, root, kind, min_bytes, years, sources, skip_damaged=True).join(lost, "_path", "left_anti"))
    names = known_headers(files)
    if not names:
        return None, bad_files
    width = max(len(n) for n in names.values())
    raw = read_cells(spark, root, kind, names, years, sources, damaged="_text").join(broadcast_if_small(files), "_path")
    cells = [f"_c{i}" for i in range(width)]
    expected = F.create_map(*[x for h, n in names.items() for x in (F.lit(h or ""), F.lit(len(n)))])[F.coalesce("_header", F.lit(""))]
    found = F.when(F.col("_text").isNull(), F.lit(width)).otherwise(cells_of(F.col("_text")))
    text = F.coalesce("_text", F.concat_ws(",", *cells))
    reason = F.when(text.contains(_MARK), "bad bytes").when(found != expected, "column count")
    judged = materialize(raw.withColumns({"_reason": reason, "_record": text}))
    bad = judged.filter("_reason is not null").select("Source", F.col("_path").alias("path"), F.col("_record").alias("record"), F.col("_reason").alias("reason"))
    good = judged.filter("_reason is null").drop("_reason", "_record", "_text")
    return named_columns(good, names, kind), bad.unionByName(bad_files)
