"""Bronze CSV scan (SRC1-SRC7): one CSV per event named
``<year>_<Event_Name>_results.csv`` (or ``_qualifying.csv``), either flat in a
folder or inside ``Source=<file name>`` partition folders as written by
``sinks.write_bronze``.

Spark binds CSV columns by position, while headers differ from file to file
(order, missing or extra columns). The scan therefore

1. reads each file's first line, path and size into a table (file, header);
   only the distinct headers, never a list of files, reach the driver;
2. reads the data once, with as many text columns as the widest header has;
3. joins the file table and takes each column from the place its header names;
4. tags Year / Circuit / Source from the file name.

An event may have any number of part files: it is skipped when all its files
together hold ``min_bytes`` or less (SRC1); no file at all raises.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ranklab.operators.ranking import broadcast_if_small, materialize
from ranklab.sources.sinks import ORDINAL

NAME_RE = r"^(\d+)_(.*)_{kind}\.csv$"
PATH_RE = r"(?:^|/)(?:Source=)?(\d+)_([^/]*)_{kind}\.csv(?:/[^/]*)?$"


def _header_names(line: str) -> list[str]:
    """Column names of a header line, pandas-style: empty -> 'Unnamed: i',
    duplicates -> 'name.1', 'name.2'."""
    import csv
    raw = next(csv.reader([line])) if line else []
    seen: dict[str, int] = {}
    out = []
    for i, name in enumerate(raw):
        name = name if name != "" else f"Unnamed: {i}"
        if name in seen:
            seen[name] += 1
            name = f"{name}.{seen[name]}"
        else:
            seen[name] = 0
        out.append(name)
    return out


def source_name() -> F.Column:
    """The per-event file name: partition value when present, else the file
    name of the path."""
    fname = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1)
    dirname = F.regexp_extract(F.col("_metadata.file_path"), r"Source=([^/]*)/[^/]*$", 1)
    decoded = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    return F.when(dirname != "", decoded(decoded(dirname))).otherwise(decoded(fname))


def _wanted(kind: str, years: Sequence[int] | None, sources: Sequence[str] | None) -> F.Column:
    """Condition on the file path alone: Spark applies it to the listing, so
    files of other kinds, seasons (SRC3) or events are never opened."""
    year = "|".join(str(y) for y in sorted(set(years))) if years is not None else r"\d+"
    out = F.col("_metadata.file_path").rlike(PATH_RE.format(kind=kind).replace(r"(\d+)", f"({year})", 1))
    return out if sources is None else out & source_name().isin(list(sources))


def headers(spark: SparkSession, root: str, kind: str = "results", min_bytes: int = 200,
            years: Sequence[int] | None = None, sources: Sequence[str] | None = None, skip_damaged: bool = False) -> DataFrame:
    """(path, header line) of every file whose *event* holds more than
    ``min_bytes`` in all its part files together."""
    txt = (spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", skip_damaged).text(root)
           .filter(_wanted(kind, years, sources))
           .select("value", F.col("_metadata.file_path").alias("_path"), source_name().alias("_event"),
                   F.col("_metadata.file_size").alias("size"),
                   F.col("_metadata.file_block_start").alias("block"),
                   F.monotonically_increasing_id().alias("_mid")))
    files = (txt.filter(F.col("block") == 0).groupBy("_path", "_event")
             .agg(F.min_by("value", "_mid").alias("_header"), F.first("size").alias("size")))
    files = materialize(files)
    events = files.groupBy("_event").agg(F.sum("size").alias("total")).filter(F.col("total") > min_bytes)
    return files.join(events, "_event", "left_semi").select("_path", "_header")


def scan_bronze(spark: SparkSession, root: str, kind: str = "results", min_bytes: int = 200,
                years: Sequence[int] | None = None, sources: Sequence[str] | None = None,
                required: bool = True) -> DataFrame | None:
    """SRC1/SRC2/SRC3/SRC4/SRC6/SRC7: header-aware scan of every bronze file
    of ``kind`` (of the seasons ``years`` or the events ``sources``, when
    given); all data columns are strings. Adds Year (int), Circuit
    (underscores -> spaces), Source (the event's file name) and ``_row`` (the
    number that ``write_bronze`` stored, file, block, place: the row order
    inside an event, for keep-last dedupes; files without numbers come first).
    Without any matching file it raises, or returns None if not ``required``."""
    files = materialize(headers(spark, root, kind, min_bytes, years, sources))
    names = known_headers(files)
    if not names:
        if required:
            raise FileNotFoundError(f"no {kind} CSV files over {min_bytes} bytes under {root}")
        return None
    raw = read_cells(spark, root, kind, names, years, sources)
    return named_columns(raw.join(broadcast_if_small(files), "_path"), names, kind)


def known_headers(files: DataFrame) -> dict[str | None, list[str]]:
    """The distinct header lines of ``files`` and their column names."""
    known = [r["_header"] for r in files.select("_header").distinct().orderBy("_header").collect()]
    return {h: _header_names(h or "") for h in known}


def read_cells(spark: SparkSession, root: str, kind: str, names: dict[str | None, list[str]], years: Sequence[int] | None = None,
               sources: Sequence[str] | None = None, damaged: str | None = None) -> DataFrame:
    """All records as text cells ``_c0``.. by place, with Source, ``_path`` and
    ``_row``. With ``damaged``, records may hold quoted line breaks, files that
    cannot be read do not fail the job, and that column has the text of every
    record whose number of cells is not the widest header's."""
    width = max(1, *(len(n) for n in names.values()))
    schema = StructType([StructField(f"_c{i}", StringType(), True) for i in range(width)])
    reader = spark.read.option("header", "true").option("escape", '"').option("enforceSchema", "true")
    if damaged:
        schema = schema.add(damaged, StringType())
        reader = reader.option("multiLine", "true").option("ignoreCorruptFiles", "true").option("columnNameOfCorruptRecord", damaged)
    return (reader.schema(schema).option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").csv(root)
            .filter(_wanted(kind, years, sources))
            .select(*schema.names, source_name().alias("Source"), F.col("_metadata.file_path").alias("_path"),
                    F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                             F.monotonically_increasing_id().alias("place")).alias("_row")))


def named_columns(raw: DataFrame, names: dict[str | None, list[str]], kind: str) -> DataFrame:
    """The cells of ``raw`` under the names that each file's ``_header`` gives them."""
    known = list(names)
    columns = [n for n in dict.fromkeys(n for h in known for n in names[h]) if n != ORDINAL]

    def value(name: str) -> F.Column:
        # the place of a column differs from header to header
        places = {h: n.index(name) for h, n in names.items() if name in n}
        if len(places) == len(known) and len(set(places.values())) == 1:
            return F.col(f"_c{next(iter(places.values()))}")
        out = F.lit(None).cast("string")
        for h, i in places.items():
            out = F.when(F.col("_header").eqNullSafe(F.lit(h)), F.col(f"_c{i}")).otherwise(out)
        return out

    name_re = NAME_RE.format(kind=kind)
    row = F.struct(value(ORDINAL).try_cast("long").alias("ordinal"), "_row.*").alias("_row")
    return raw.select(*(value(n).alias(n) for n in columns), row, "Source",
                      F.regexp_extract("Source", name_re, 1).cast("int").alias("Year"),
                      F.translate(F.regexp_extract("Source", name_re, 2), "_", " ").alias("Circuit"))
