"""Helpers shared by the operators: shared-folder tables, shipping the package
to executors, stable row keys, and Arrow columns as byte buffers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition ``[^\x20\x09-\x0D]+``; ``bytes.split()`` cuts at the same six bytes.
SPACES = b" \t\n\r\x0b\x0c"
_shipped: set[str] = set()


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="ranklab-code-")) / "ranklab_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's ``spark.checkpoint.dir``. Only a local
    master may go without that setting (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="ranklab-shared-")
    return f"{base.rstrip('/')}/ranklab-{uuid.uuid4().hex}"


#: Spark's setting that ends an execution's shuffle files with it (from 4.1; unknown and without effect before).
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, partition_by: str | None = None, release: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a lineage
    cut that survives lost executors. With ``release`` the shuffle files of this
    write are deleted when it has ended, not at some later garbage collection."""
    path = shared_folder(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(RELEASE, None)
    if release:
        conf.set(RELEASE, "true")
    try:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    finally:
        if release:
            conf.unset(RELEASE) if before is None else conf.set(RELEASE, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text: str = "text") -> Column:
    """Fingerprint that tells rows with equal ``doc_id`` and different texts apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def crc_mod(column: str, n: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


def partitions_for(rows: int, rows_each: int, least: int = 1) -> int:
    return max(least, -(-rows // rows_each))


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, starts, ends) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, ends[:-1], ends[1:]


def runs(starts: np.ndarray, ends: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each (one row at least)."""
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + size, side="right")))
        yield lo, hi
        lo = hi


def regrouped(batches: Iterable[pa.RecordBatch], column: str, size: int) -> Iterator[pa.Table]:
    """Tables of about ``size`` bytes of ``column``, each of whole rows."""
    held, total = [], 0
    for batch in batches:
        _, starts, ends = byte_column(batch.column(column))
        for lo, hi in runs(starts, ends, size):
            held.append(batch.slice(lo, hi - lo))
            total += int(ends[hi - 1] - starts[lo])
            if total >= size // 2:
                yield pa.Table.from_batches(held).combine_chunks()
                held, total = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one zstd frame: count, (dtype, length) of each, then their bytes."""
    import zstandard
    head = ";".join(f"{a.dtype.str},{len(a)}" for a in arrays).encode()
    raw = len(head).to_bytes(4, "little") + head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    out, at = [], 4 + n
    for item in raw[4:4 + n].decode().split(";"):
        kind, length = item.rsplit(",", 1)
        kind, length = np.dtype(kind), int(length)
        out.append(np.frombuffer(raw, kind, length, at))
        at += kind.itemsize * length
    return out


def low_bytes(values: np.ndarray, n: int) -> np.ndarray:
    """The low ``n`` bytes of each value, as bytes (little-endian)."""
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :n].reshape(-1)


def from_low_bytes(raw: np.ndarray, n: int) -> np.ndarray:
    wide = np.zeros((len(raw) // n, 8), np.uint8)
    wide[:, :n] = raw.reshape(-1, n)
    return wide.reshape(-1).view("<u8").astype(np.uint64)


