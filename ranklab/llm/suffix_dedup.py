"""Removal of repeated byte strings by bucket-pointer refinement.

A byte is removed when a ``width``-byte string covering it also starts in a
document with a smaller id. The suffixes that matter are put into buckets and
the buckets refined until ``width`` bytes are sorted:

1. *Initial q-gram buckets.* Every window of ``width`` bytes is represented by
   its anchor suffix (:mod:`.byte_anchors`, one suffix in about 17 bytes); equal
   windows lie in the same bucket of their anchor's q-gram. Buckets are dealt
   over the cluster as packed blobs.
2. *First refinement.* A bucket is split by the fingerprint of all bytes that
   the anchor's windows cover. Members of one part agree in all those windows,
   so all but the smallest document lose them at once. Every window covers half
   of the room on one side of its q-gram; of the parts only those go on that
   agree with a part of another document in the q-gram and that half.
3. *Recursive refinement.* The windows of those suffixes are sorted exactly:
   identifiers of 1-byte buckets give those of 2, 4, ... ``width`` bytes by
   sorting on the pair (identifier, identifier at the later offset); each
   level's identifiers are used again by the next. The smallest document of
   every full bucket is compared with each member.

Very large buckets (common passages with different surroundings) are dealt by
the q-gram and that half, about twice as long, instead of by q-gram.
What a suffix takes in the shuffle does not depend on the number of partitions:
ids go as differences, and the fingerprint of a text only with an id of several
rows.

Defined cases: null text is empty; a null id is neither smaller nor larger than
any other, so such rows keep all bytes; rows that share an id never remove each
other's bytes; texts shorter than ``width`` keep all bytes; an empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_anchors import Substrings, anchors, mix
from .common import (byte_column, from_low_bytes, low_bytes, pack, partitions_for, record_batch, regrouped, runs,
                     ship, stored, unpack)

WIDTH = 50
Q = 18
#: Bytes kept of the q-gram bucket number (a clash only costs time) and of the
#: fingerprint that splits a bucket (compared inside one bucket).
BUCKET_BYTES, PART_BYTES = 5, 6
#: What is kept of the fingerprint of each side (a clash only costs time).
SIDE = "<u2"
#: Buckets with more parts than this are dealt by longer strings.
LARGE_BUCKET = 1000
#: So many ids of several rows may be broadcast; beyond, each row has its text's fingerprint.
REPEATED_IDS = 100_000
ROWS_PER_PARTITION = 2500
_SCAN_BYTES, _CHUNK_BYTES = 8 << 20, 1 << 18

_BLOBS = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])
_MARKS = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("spans", pa.binary()), ("asks", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                  ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))])


def _by_group(groups: np.ndarray, n: int) -> list[np.ndarray]:
    order = np.argsort(groups, kind="stable")
    return np.split(order, np.searchsorted(groups[order], np.arange(1, n)))


def _planes(values: np.ndarray) -> np.ndarray:
    """The bytes of whole numbers, the first byte of all, then the second, ..."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T.reshape(-1)


def _from_planes(raw: np.ndarray, kind: str) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _ids(docs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _planes(np.diff(docs.astype("<i8").view("<u8"), prepend=np.uint64(0))), _planes(keys.astype("<i8"))


def _from_ids(docs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(_from_planes(docs, "<u8"), dtype=np.uint64).view(np.int64), _from_planes(keys, "<i8")


def _places(local: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows 0, 1, ... in turn and ascending places in each, as bits and differences."""
    new = np.diff(local, prepend=-1) > 0
    return np.packbits(new), _planes(np.where(new, first, np.diff(first, prepend=0)).astype("<i4"))


def _from_places(bits: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = _from_planes(steps, "<i4").astype(np.int64)
    new = np.unpackbits(bits, count=len(step)).astype(bool)
    local, total = np.cumsum(new) - 1, np.cumsum(step)
    return local, (total - (total - step)[new][local]).astype(np.int32)


def _sides(width: int, q: int, rel: np.ndarray, more: np.ndarray):
    """(bytes of the left half, has windows with it, has other windows): of the windows that
    begin at least ``half`` bytes before the q-gram, and of the others, which all cover
    ``width - half + 1`` bytes from the q-gram on."""
    half = (width - q) // 2
    return half, rel >= half, rel.astype(np.int64) - more < half


def _scan(width: int, q: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in regrouped(batches, "text", _SCAN_BYTES):
            table = table.take(np.argsort(table.column("doc").to_numpy(), kind="stable"))
            buf, starts, ends = byte_column(table.column("text"))
            docs, keys = (table.column(c).to_numpy() for c in ("doc", "key"))
            found = []
            for lo, hi in runs(starts, ends, _CHUNK_BYTES):
                base = starts[lo]
                part, s, e = buf[base:ends[hi - 1]], starts[lo:hi] - base, ends[lo:hi] - base
                long = np.flatnonzero(e - s >= width)
                pos, first, last, gram = anchors(part, s[long], e[long], width, q)
                which = long[np.searchsorted(e[long], pos, side="right")]
                prints, (half, on_left, on_right) = Substrings(part), _sides(width, q, pos - first, last - first)
                left, right = np.zeros((2, len(pos)), np.uint64)
                left[on_left] = prints(pos[on_left] - half, pos[on_left] + q)
                right[on_right] = prints(pos[on_right], pos[on_right] + width - half + 1)
                found.append((gram, prints(first, last + width), (which + lo).astype(np.int32), (first - s[which]).astype(np.int32),
                              (pos - first).astype(np.uint8), (last - first).astype(np.uint8), left.astype(SIDE), right.astype(SIDE)))
            if not found:
                continue
            gram, part, which, first, rel, more, left, right = map(np.concatenate, zip(*found))
            for b, at in enumerate(_by_group((gram % np.uint64(buckets)).astype(np.int64), buckets)):
                if len(at):
                    used, local = np.unique(which[at], return_inverse=True)
                    blob = pack(*_ids(docs[used], keys[used]), *_places(local, first[at]), rel[at], more[at],
                                low_bytes(gram[at] // np.uint64(buckets), BUCKET_BYTES), low_bytes(part[at], PART_BYTES),
                                left[at], right[at])
                    yield record_batch(_BLOBS, [b], [blob])
    return run


def _marks(doc, key, order, span=None, ask=None) -> pa.RecordBatch:
    """Rows by document. ``order`` sorts the entries by (doc, key)."""
    doc, key = doc[order], key[order]
    cut = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))))
    ends = np.append(cut[1:], len(doc))
    rows = [[None] * len(cut) if x is None else [x[order[i:j]].tobytes() for i, j in zip(cut, ends)] for x in (span, ask)]
    return record_batch(_MARKS, doc[cut], key[cut], *rows)


def _split(width: int, q: int):
    """First refinement of the buckets of one partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = []
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_numpy(), batch.column("blob").to_pylist()):
                docs, keys, local, step, rel, more, gram, part, left, right = unpack(blob)
                (docs, keys), (local, first) = _from_ids(docs, keys), _from_places(local, step)
                columns.append((np.full(len(local), bucket, np.int32), docs[local], keys[local], first,
                                rel, more, from_low_bytes(gram, BUCKET_BYTES), from_low_bytes(part, PART_BYTES),
                                left, right))
        if not columns:
            return
        bucket, doc, key, first, rel, more, gram, part, left, right = map(np.concatenate, zip(*columns))
        del columns
        gram = gram ^ (bucket.astype(np.uint64) << np.uint64(8 * BUCKET_BYTES))
        part ^= (rel.astype(np.uint64) << np.uint64(48)) | (more.astype(np.uint64) << np.uint64(56))
        order = np.lexsort((doc, part, gram))
        gram, part, doc = gram[order], part[order], doc[order]
        new_gram = np.concatenate(([True], gram[1:] != gram[:-1]))
        new_part = new_gram | np.concatenate(([True], part[1:] != part[:-1]))
        of_gram, of_part = np.cumsum(new_gram) - 1, np.cumsum(new_part) - 1
        smallest = doc[np.flatnonzero(new_part)][of_part]
        parts = np.bincount(of_gram[new_part])
        g = np.flatnonzero(new_gram)
        several = (np.minimum.reduceat(doc, g) != np.maximum.reduceat(doc, g)) & (parts > 1)
        gone = np.flatnonzero(doc != smallest)
        asked = np.flatnonzero((doc == smallest) & several[of_gram])
        first, rel, more, key = (x[order] for x in (first, rel, more, key))
        for block in np.array_split(gone, max(1, len(gone) // 50_000)):
            if len(block):
                what = np.stack((first[block], first[block] + more[block] + width), 1).astype("<u4")
                yield _marks(doc[block], key[block], np.lexsort((key[block], doc[block])), span=what)
        left, right = left[order[asked]], right[order[asked]]
        at, ask = _asks(width, q, doc[asked], gram[asked], of_part[asked], first[asked], rel[asked], more[asked], left, right)
        at = asked[at]
        for block in np.array_split(np.arange(len(at)), max(1, len(at) // 50_000)):
            if len(block):
                d, k = doc[at[block]], key[at[block]]
                yield _marks(d, k, np.lexsort((k, d)), ask=ask[block])
    return run


def _asks(width: int, q: int, doc, gram, part, first, rel, more, left, right) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes (by place) have windows to compare, and of each the first window, the
    q-gram's place behind it, the number of further windows, and what deals it out: the
    q-gram (0) or, in large buckets, the q-gram and the half to its left (1) or right (2)."""
    half, on_left, on_right = _sides(width, q, rel, more)
    for has, side in ((on_left, left), (on_right, right)):
        which = np.flatnonzero(has)
        if len(which):
            has[which] = _shared(mix(gram[which] + mix(side[which].astype(np.uint64) + np.uint64(1))), doc[which])
    first, rel, last = (x.astype(np.int64) for x in (first, rel, first + more.astype(np.int64)))
    useful = np.flatnonzero(on_left | on_right)
    _, bucket = np.unique(gram[useful], return_inverse=True)
    seen = bucket[np.diff(part[useful], prepend=-1) > 0]  # parts ascend
    large = np.zeros(len(doc), bool)
    large[useful] = (np.bincount(seen, minlength=1) > LARGE_BUCKET)[bucket]
    out = []
    for kind, chosen in ((0, ~large & (on_left | on_right)), (1, large & on_left), (2, large & on_right)):
        at = np.flatnonzero(chosen)
        # only a half of the windows where only that half is shared
        from_right = ~on_left[at] if kind == 0 else kind == 2
        to_left = ~on_right[at] if kind == 0 else kind == 1
        middle = first[at] + rel[at] - half
        begin = np.where(from_right, np.maximum(first[at], middle + 1), first[at])
        end = np.where(to_left, np.minimum(last[at], middle), last[at])
        out.append((at, np.stack((begin, first[at] + rel[at] - begin, end - begin, np.full(len(at), kind)), 1).astype("<u4")))
    return tuple(map(np.concatenate, zip(*out)))


def _spread(width: int, q: int, buckets: int):
    """The bytes of the asked windows, dealt by q-gram or, for large buckets, by a longer string."""
    half = (width - q) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in regrouped(batches, "text", _SCAN_BYTES):
            buf, starts, _ = byte_column(table.column("text"))
            docs, keys = (table.column(c).to_numpy() for c in ("doc", "key"))
            raw = [b"".join(x) for x in table.column("asks").to_pylist()]
            asks = np.frombuffer(b"".join(raw), "<u4").reshape(-1, 4).astype(np.int64)
            if not len(asks):
                continue
            row = np.repeat(np.arange(len(raw)), [len(x) // 16 for x in raw])
            lead, rel, more, kind = asks.T
            begin = lead + starts[row]
            key_at = begin + rel - np.where(kind == 1, half, 0)
            key_n = np.choose(kind, (q, half + q, width - half + 1))
            mark = _fingerprints(buf, key_at, key_n) % np.uint64(buckets)
            size = more + width
            for b, at in enumerate(_by_group(mark.astype(np.int64), buckets)):
                if len(at):
                    many = size[at]
                    where = np.repeat(begin[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                    used, local = np.unique(row[at], return_inverse=True)
                    yield record_batch(_BLOBS, [b], [pack(*_ids(docs[used], keys[used]), _planes(local.astype("<i4")),
                                                          _planes(lead[at].astype("<i4")), more[at].astype(np.uint8), buf[where])])
    return run


def _fingerprints(buf: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of ``buf[at:at + size]`` by content, for few sizes."""
    out = np.zeros(len(at), np.uint64)
    for n in np.unique(size):
        which = np.flatnonzero(size == n)
        h = np.zeros(len(which), np.uint64)
        for j in range(int(n)):
            h = mix(h + buf[at[which] + j] + np.uint64(1))
        out[which] = h
    return out


def refine(buf: np.ndarray, at: np.ndarray, width: int, q: int = 7) -> np.ndarray:
    """Bucket of the ``width`` bytes at each ``at`` (equal buckets: equal bytes).
    ``q``-gram buckets come from the bytes themselves; sorting on the pair of a
    bucket and the bucket ``step`` bytes later refines them to twice the depth."""
    size = min(q, width)
    ids = np.zeros(len(buf) - size + 1, np.int64)
    for j in range(size):
        ids = (ids << 8) | buf[j:j + len(ids)]
    if size == width:
        return np.unique(ids[at], return_inverse=True)[1]
    while True:
        ids = np.unique(ids, return_inverse=True)[1]
        step = min(size, width - size)
        n = len(ids) - step
        pair = ids[:n] * (int(ids.max()) + 1) + ids[step:]
        size += step
        if size == width:
            return np.unique(pair[at], return_inverse=True)[1]
        ids = pair


def _shared(window: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which windows have a fingerprint that several documents have."""
    order = np.argsort(window, kind="stable")
    window, doc = window[order], doc[order]
    new = np.flatnonzero(np.concatenate(([True], window[1:] != window[:-1])))
    several = np.minimum.reduceat(doc, new) != np.maximum.reduceat(doc, new)
    out = np.empty(len(window), bool)
    out[order] = np.repeat(several, np.diff(np.append(new, len(window))))
    return out


def _resolve(width: int):
    """Exact refinement of the windows of one partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = []
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                docs, keys, local, lead, more, raw = unpack(blob)
                (docs, keys), local = _from_ids(docs, keys), _from_planes(local, "<i4")
                columns.append((docs[local], keys[local], _from_planes(lead, "<i4"), more, raw))
        if not columns:
            return
        doc, key, lead, more, buf = map(np.concatenate, zip(*columns))
        del columns

        def windows(more):
            n = more.astype(np.int64) + 1
            entry = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)
            size = n + width - 1
            return entry, step, (np.cumsum(size) - size)[entry] + step, size

        # strings without a window that another document may have need no sorting
        entry, step, at, size = windows(more)
        useful = np.bincount(entry, _shared(Substrings(buf)(at, at + width), doc[entry]), minlength=len(more)) > 0
        if not useful.any():
            return
        buf, doc, key, lead, more = buf[np.repeat(useful, size)], doc[useful], key[useful], lead[useful], more[useful]
        entry, step, at, _ = windows(more)
        bucket = refine(buf, at, width)
        smallest = np.full(int(bucket.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(smallest, bucket, doc[entry])
        gone = np.flatnonzero(smallest[bucket] < doc[entry])
        entry, start = entry[gone], (lead[entry] + step)[gone]
        for block in np.array_split(np.arange(len(gone)), max(1, len(gone) // 400_000)):
            if len(block):
                e, s = entry[block], start[block]
                new = np.flatnonzero(np.concatenate(([True], (e[1:] != e[:-1]) | (s[1:] != s[:-1] + 1))))
                last = np.append(new[1:], len(e)) - 1
                d, k = doc[e[new]], key[e[new]]
                yield _marks(d, k, np.lexsort((k, d)), np.stack((s[new], s[last] + width), 1).astype("<u4"))
    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, starts, ends = byte_column(batch.column("text"))
        rows = []
        for doc, s, e, spans in zip(batch.column("doc_id").to_pylist(), starts, ends, batch.column("spans").to_pylist()):
            body, gone, out = buf[s:e], 0, []
            if spans:
                span = np.frombuffer(b"".join(x for x in spans if x), "<u4").reshape(-1, 2).astype(np.int64)
                change = np.zeros(e - s + 1, np.int32)
                np.add.at(change, span[:, 0], 1)
                np.add.at(change, span[:, 1], -1)
                hit = np.cumsum(change)[:-1] > 0
                gone = int(hit.sum())
                body = body[~hit]
                out = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))).tolist()
            rows.append((doc, int(e - s), gone, len(out) // 2, hashlib.sha256(body.tobytes()).hexdigest(), out))
        if rows:
            yield record_batch(_OUT, *zip(*rows))


def _short_keys(base: DataFrame) -> DataFrame:
    """``base`` with key 0 where the id has one row."""
    ids = stored(base.groupBy("doc").count().where("count > 1").select("doc", F.lit(True).alias("several")))
    n = ids.count()
    if n > REPEATED_IDS:
        return base
    none = F.col("doc").bitwiseAND(F.lit(0))  # 0; a literal would be dropped from the keys of the joins and part them from the shuffle
    if n == 0:
        return base.withColumn("key", none)
    marked = base.join(F.broadcast(ids), "doc", "left")  # at most REPEATED_IDS rows
    return marked.select("doc_id", "doc", F.when(F.col("several"), F.col("key")).otherwise(none).alias("key"), "text")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, q: int = Q) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and ``spans`` (begin and
    end byte of each removed run, in turn) of every row."""
    spark = docs.sparkSession
    ship(spark)
    doc, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    # (doc, key) tells different rows apart and is never null, so both joins below share one shuffle of the texts
    base = _short_keys(docs.select(doc.alias("doc_id"), F.coalesce(doc, F.lit(0)).alias("doc"), F.xxhash64(doc.isNull(), text).alias("key"), text.alias("text")))
    parts = partitions_for(base.count(), ROWS_PER_PARTITION, 4)
    texts = base.repartition(parts, "doc", "key")
    long = base.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= width)).select("doc", "key", "text")
    blobs = long.mapInArrow(_scan(width, q, parts), "bucket int, blob binary")
    marks = stored(blobs.repartition(parts, "bucket").mapInArrow(_split(width, q), "doc long, key long, spans binary, asks binary"), release=True)
    asks = marks.where("asks is not null").groupBy("doc", "key").agg(F.collect_list("asks").alias("asks"))
    asked = texts.join(asks, ["doc", "key"])  # equal rows ask alike, which changes no minimum
    spread = asked.select("doc_id", "doc", "key", "text", "asks").mapInArrow(_spread(width, q, parts), "bucket int, blob binary")
    exact = spread.repartition(parts, "bucket").mapInArrow(_resolve(width), "doc long, key long, spans binary, asks binary")
    spans = (marks.where("spans is not null").unionByName(exact).groupBy("doc", "key")
             .agg(F.collect_list("spans").alias("spans")))
    both = texts.join(spans, ["doc", "key"], "left").select("doc_id", "doc", "key", "text", "spans")
    return both.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
