"""Token ids of documents in Huffman-coded files.

1. Texts are dealt by a range partitioning over (id, row), so that
   the files follow one another in ascending id order; each part is sorted and
   tokenized in that order, an end id behind every document, and stored, with
   the part's number of ids and counts of ids in a row of its own.
2. The counts of all ids, summed over the parts, give one length-limited
   prefix code for the whole corpus, by package-merge. It is canonical: the
   lengths alone, one row for each id in use, make the file ``codes``.
3. Whole documents are put into segments of about ``SEGMENT_IDS`` ids, one row
   each of the file set ``segments``: where the segment starts in the corpus,
   its documents' ids and lengths, the code bits, and the bit offset of every
   ``BLOCK_IDS``-th id. Segments stand alone, and so do the blocks between two
   offsets: a reader decodes any of them without what is in front.
4. The reader looks up as many bits as the longest code has in one table of
   (id, length) and takes a step in all blocks of a segment at a time.

What the driver holds is bounded: one total for each part, and the code
(at most one row for each id of the vocabulary).

Defined cases: a null text is empty, and an empty text is its end id alone; null
ids come first; rows of one id keep the order in which the table is read, and
equal rows are kept each; an empty table gives files without rows; a text of any length is
one document of one segment; other columns of ``docs`` are not read, whatever
their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_column, pack, partitions_for, record_batch, runs, shared_folder, ship, stored, unpack
from .word_ids import WordTokenizer

END_ID = 2
#: Bytes of text that one part holds, about.
PART_BYTES = 48 << 20
#: Bytes of text that are tokenized at a time.
TEXT_BYTES = 4 << 20
#: Parts whose counts one task sums.
PARTS_SUMMED = 64
SEGMENT_IDS = 1 << 20
BLOCK_IDS = 512
#: Longest code; more only where there are more ids than codes of that length. At most 25, as the reader looks at 32 bits from a byte on.
MAX_BITS = 18
_IDS = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])
_SEGMENTS = pa.schema([("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
                       ("offsets", pa.binary()), ("bits", pa.binary())])
_ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


# the code

def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Bits of each symbol's code (all ``counts`` positive), of the least total
    among prefix codes of at most ``max_bits`` bits: package-merge."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols need codes of more than {max_bits} bits")
    order = np.argsort(counts, kind="stable")
    coins = counts[order].astype(np.int64)
    level, leaves = coins, []
    for bit in range(max_bits):
        if bit:
            pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
            both = np.concatenate([coins, pairs])
            by = np.argsort(both, kind="stable")
            level, is_leaf = both[by], by < n
        else:
            is_leaf = np.ones(n, bool)
        leaves.append(np.concatenate([[0], np.cumsum(is_leaf)]))
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for seen in reversed(leaves):
        of_leaves = int(seen[take])
        lengths[:of_leaves] += 1
        take = 2 * (take - of_leaves)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Codebook:
    """The canonical code of ``ids`` (ascending) with code ``lengths``."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        by = np.lexsort((ids, lengths))
        self.longest = int(lengths.max()) if len(ids) else 1
        room = np.left_shift(1, self.longest - lengths[by])
        ends = np.cumsum(room)
        if len(ids) and (ends[-1] > 1 << self.longest or self.longest > 25):
            raise ValueError("these lengths are no prefix code of at most 25 bits")
        size = int(ids.max()) + 1 if len(ids) else 0
        self.code, self.bits = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code[ids[by]] = (ends - room) >> (self.longest - lengths[by])
        self.bits[ids[by]] = lengths[by]
        self.symbol, self.step = np.zeros(1 << self.longest, np.uint32), np.ones(1 << self.longest, np.int64)
        self.symbol[: room.sum()] = np.repeat(ids[by], room)
        self.step[: room.sum()] = np.repeat(lengths[by], room)

    def encode(self, ids: np.ndarray, block: int = BLOCK_IDS) -> tuple[np.ndarray, bytes]:
        """(bit offset of every ``block``-th id, the bits)."""
        bits = self.bits[ids]
        ends = np.cumsum(bits)
        at = ends - bits
        words = np.zeros((int(ends[-1]) >> 5) + 2 if len(ids) else 0, np.uint64)
        if len(ids):
            place = at >> 5
            wide = self.code[ids] << (64 - (at & 31) - bits).astype(np.uint64)
            first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
            words[place[first]] += np.add.reduceat(wide >> np.uint64(32), first)
            words[place[first] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), first)
        return at[::block], words.astype(">u4").tobytes()

    def decode(self, offsets: np.ndarray, bits: bytes, n: int, block: int = BLOCK_IDS) -> np.ndarray:
        """The ``n`` ids of blocks that begin at ``offsets``; all blocks but the last are full."""
        raw = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        out, at = np.empty((len(offsets), block), np.uint32), offsets.astype(np.int64)
        last, shift = 8 * (len(window) - 1), 32 - self.longest
        for i in range(min(block, n)):
            seen = ((window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(shift)).astype(np.int64)
            out[:, i] = self.symbol[seen]
            at = np.minimum(at + self.step[seen], last)
        return out.reshape(-1)[:n]


# writing

def _tokenize(path: str, end_id: int, added_tokens: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, at, total = WordTokenizer.of_worker(path, added_tokens), 0, np.zeros(0, np.int64)
        for batch in batches:
            _, starts, ends = byte_column(batch.column("text"))
            for lo, hi in runs(starts, ends, TEXT_BYTES):
                some = batch.slice(lo, hi - lo)
                ids, lengths = coder.encode_documents(some.column("text"), end_id)
                upto = np.concatenate([[0], np.cumsum(lengths)])
                cut = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer((4 * upto).astype(np.int32)), pa.py_buffer(ids)])
                yield record_batch(_IDS, some.column("part"), some.column("doc_id"), at + upto[:-1], cut, pa.nulls(len(cut), pa.binary()))
                at += int(upto[-1])
                part = some.column("part")[0].as_py()
                found = np.bincount(np.frombuffer(ids, "<u4"), minlength=len(total))
                found[: len(total)] += total
                total = found
        if at:  # the part's own row: how many ids there are, and of which
            used = np.flatnonzero(total)
            yield record_batch(_IDS, [part], [None], [at], [None], [pack(used, total[used])])
    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for used, n in map(unpack, batch.column("counts").to_pylist()):
            total = np.concatenate([total, np.zeros(max(0, int(used[-1]) + 1 - len(total)), np.int64)])
            total[used] += n
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])


def _encode(ids: list[int], lengths: list[int], bases: list[int], segment_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, held, size, nearest = Codebook(np.array(ids, np.int64), np.array(lengths, np.int64)), [], 0, None

        def segment() -> pa.RecordBatch:
            tokens = np.frombuffer(b"".join(x for _, x in held), "<u4")
            offsets, bits = book.encode(tokens)
            return record_batch(_SEGMENTS, [nearest], [len(tokens)], [[d for d, _ in held]], [[len(x) // 4 for _, x in held]],
                                [offsets.astype("<u4").tobytes()], [bits])

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("part", "doc_id", "at", "ids"))
            for part, doc, at, found in zip(*columns):
                start = bases[part] + at
                if held and (start != nearest + size or size + len(found) // 4 > segment_ids):
                    yield segment()
                    held, size = [], 0
                if not held:
                    nearest = start
                held.append((doc, found))
                size += len(found) // 4
        if held:
            yield segment()
    return run


def write_ids(docs: DataFrame, tokenizer_path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text",
              end_id: int = END_ID, added_tokens: bool = False, max_bits: int = MAX_BITS) -> str:
    """Write the files of all documents below ``folder`` (a new shared one by
    default) and return it."""
    spark = docs.sparkSession
    ship(spark)
    folder = folder or shared_folder(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = partitions_for(int(size), PART_BYTES)
    keys = [F.col("doc_id").asc_nulls_first(), F.col("row")]
    dealt = texts.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *keys)
    ordered = dealt.sortWithinPartitions(*keys).select(F.spark_partition_id().alias("part"), "doc_id", "text")
    ids = stored(ordered.mapInArrow(_tokenize(tokenizer_path, end_id, added_tokens), _ddl(_IDS)))

    of_parts = ids.where("counts is not null")
    summed = of_parts.select("counts").coalesce(partitions_for(parts, PARTS_SUMMED)).mapInArrow(_count, "id long, n long")
    counts = summed.groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toPandas()
    symbols = counts["id"].to_numpy()
    lengths = code_lengths(counts["n"].to_numpy(), max(max_bits, int(len(symbols) - 1).bit_length()))
    spark.createDataFrame([(int(i), int(b)) for i, b in zip(symbols, lengths)], "id long, bits int").write.parquet(f"{folder}/codes")

    ends = of_parts.select("part", "at").collect()
    totals = np.zeros(max((r.part for r in ends), default=0) + 1, np.int64)
    for r in ends:
        totals[r.part] = r["at"]
    bases = (np.cumsum(totals) - totals).tolist()
    coded = ids.where("counts is null").drop("counts").mapInArrow(_encode(symbols.tolist(), lengths.tolist(), bases, SEGMENT_IDS), _ddl(_SEGMENTS))
    coded.write.option("compression", "none").parquet(f"{folder}/segments")
    return folder


# reading

def _decode(ids: list[int], lengths: list[int], digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(np.array(ids, np.int64), np.array(lengths, np.int64))
        for batch in batches:
            for s in batch.to_pylist():
                tokens = book.decode(np.frombuffer(s["offsets"], "<u4"), s["bits"], s["n_ids"]).astype("<u4").tobytes()
                ends = np.cumsum(np.array(s["lengths"], np.int64))
                starts = ends - s["lengths"]
                cut = [tokens[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist())]
                last = [zlib.crc32(x) for x in cut] if digest else cut
                yield record_batch(_DIGESTS if digest else _ROWS, s["doc_ids"], s["start"] + starts, s["lengths"], last)
    return run


def read_ids(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and the ids (little-endian
    unsigned 32-bit numbers) of every document of the files; with ``digest``, ids_crc32 instead of the ids."""
    ship(spark)
    codes = spark.read.schema("id long, bits int").parquet(f"{folder}/codes").orderBy("id").toPandas()
    segments = spark.read.schema(_ddl(_SEGMENTS)).parquet(f"{folder}/segments")
    return segments.mapInArrow(_decode(codes["id"].tolist(), codes["bits"].tolist(), digest), _ddl(_DIGESTS if digest else _ROWS))
