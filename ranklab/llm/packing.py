"""Best-fit packing of token sequences with certified bin counts.

1. Every text is tokenized and cut into pieces of at most ``capacity`` tokens.
2. Pieces are stored with a number of their own, by which they are dealt over
   parts of bounded size whatever their ids; each part is packed by best-fit
   decreasing.
3. Each part's bin count is certified by lower bounds from dual feasible
   functions. Parts that meet their bound are done. Parts with a gap keep their
   full bins and exchange the pieces of the others: these are dealt anew over
   fewer parts and packed again. An exchange that needs more bins than before
   is not taken.

Defined cases: null text is empty and is one piece of the end id; a null id is
kept; repeated rows are packed each; an empty table gives an empty result. With
``added_tokens`` the strings of the tokenizer's added tokens get their single
ids, as of the plain tokenizer; without, they are text like any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_column, partitions_for, record_batch, runs, ship, stored
from .word_ids import WordTokenizer

CAPACITY = 2048
#: Pieces packed by one task.
PART_PIECES = 20_000
ROUNDS = 3
#: Bytes of text that are tokenized at a time.
TEXT_BYTES = 4 << 20
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64())])


def _tokenize(path: str, capacity: int, end_id: int, added_tokens: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordTokenizer.of_worker(path, added_tokens)
        for batch in batches:
            _, starts, ends = byte_column(batch.column("text"))
            for lo, hi in runs(starts, ends, TEXT_BYTES):
                part = batch.slice(lo, hi - lo)
                ids, sizes = coder.encode_documents(part.column("text"), end_id)
                pieces = -(-sizes // capacity)
                of = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(sizes[of] - start, capacity)
                begin, raw = 4 * ((np.cumsum(sizes) - sizes)[of] + start), memoryview(ids)
                crc = [zlib.crc32(raw[x:y]) for x, y in zip(begin.tolist(), (begin + 4 * length).tolist())]
                yield record_batch(_PIECES, part.column("doc_id").take(pa.array(of)), piece, start, length, crc)
    return run


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each piece and the number of bins. A piece goes into the
    open bin with the least room that holds it."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, count = 0, 0  # bit r: some bin has room r
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b, count = capacity, count, count + 1
        bins[i], offsets[i] = b, capacity - room
        left = room - size
        if left:
            if not by_room[left]:
                rooms |= 1 << left
            by_room[left].append(b)
    return bins, offsets, count


def bin_bound(lengths: np.ndarray, capacity: int, ks: int = 20) -> int:
    """Lower bound of the bins that ``lengths`` need: the best of the dual
    feasible functions f_e (sizes above capacity - e count as a whole bin, sizes
    below e as nothing) combined with u_k (sizes rounded to multiples of
    capacity / k), for all e up to half the capacity and k up to ``ks``."""
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(object if len(lengths) > 1 << 40 else np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    e = np.arange(capacity // 2 + 1)
    above = np.cumsum(counts[::-1])[::-1]
    whole = np.append(above, 0)[capacity - e + 1]
    best = 0
    for k in range(1, ks + 1):
        step = (k + 1) * size
        # u_k in units of 1 / (k * capacity); k = 1 stands for the identity
        worth = k * size if k == 1 else np.where(step % capacity == 0, k * size, (step // capacity) * capacity)
        below = np.concatenate(([0], np.cumsum(counts * worth)))
        total = whole * k * capacity + below[capacity - e + 1] - below[e]
        best = max(best, int(-(-total.max() // (k * capacity))))
    return best


def _pack_part(capacity: int, turn: int):
    def run(key, table: pd.DataFrame) -> pd.DataFrame:
        lengths = table["length"].to_numpy()
        bins, offsets, count = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, lengths, minlength=count)
        table["sequence_id"] = (turn << 56) + (int(key[0]) << 24) + bins
        table["offset"] = offsets
        table["gap"] = count - bin_bound(lengths, capacity)
        table["full"] = fill[bins] == capacity
        return table
    return run


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, part_pieces: int = PART_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id, offset and
    ``gap``: the bins by which the piece's part may exceed the optimum."""
    ship(pieces.sparkSession)
    pieces = stored(pieces.withColumn("_number", F.monotonically_increasing_id()))
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)
    out = schema + ", part long, sequence_id long, offset long, gap long, full boolean"
    left, done, n = pieces, None, pieces.count()
    had = None
    for turn in range(rounds):
        parts = partitions_for(n, part_pieces)
        dealt = left.withColumn("part", F.pmod(F.xxhash64("_number", F.lit(turn)), F.lit(parts)))
        packed = stored(dealt.groupBy("part").applyInPandas(_pack_part(capacity, turn), out))
        open_ = packed.where("gap > 0 and not full")
        if had is not None:
            before, waiting = had
            if packed.agg(F.count_distinct("sequence_id")).first()[0] >= before:
                done = done.unionByName(waiting)  # no better: the former packing stands
                break
        closed = packed.where("not (gap > 0 and not full)")
        done = closed if done is None else done.unionByName(closed)
        row = open_.agg(F.count("*").alias("n"), F.count_distinct("sequence_id").alias("bins"),
                        F.count_distinct("part").alias("parts")).first()
        if turn == rounds - 1 or row.n == 0 or (turn and row.parts == 1):
            done = done.unionByName(open_)
            break
        had, n = (row.bins, open_), row.n
        left = open_.select(*pieces.columns)
    return done.drop("_number", "part", "full")


def best_fit_packing(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                     capacity: int = CAPACITY, end_id: int = 0, added_tokens: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, gap of every piece."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = texts.mapInArrow(_tokenize(tokenizer_path, capacity, end_id, added_tokens),
                              "doc_id long, piece int, start long, length long, ids_crc32 long")
    return pack_pieces(pieces, capacity)
