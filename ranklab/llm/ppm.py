"""Prediction by partial matching over the bytes of texts.

The model is a trie of byte contexts of up to four bytes, counted over all
training texts. The symbol after a context is coded from the longest known
context; where it was not seen there, the coder pays the escape probability
``d / (n + d)`` (n occurrences, d different symbols: escape method C) and goes
to the next shorter context, from which the symbols of the longer one are
excluded. After the empty context all remaining byte values are alike. A text
is read with its letters A-Z in lower case and closed by a zero byte, and is
preceded by zero bytes; its score is the log10 probability of all its bytes and
the closing one.

The trie is never in one place. Texts are packed into blocks; a block sends the
5-byte strings (context and symbol) it holds, once each with its training
count, to the partition that owns the context's last two bytes. All longer
contexts that end in these bytes meet there, so counts, escapes and exclusions
of orders 4, 3 and 2 are settled there and every string's log10 probability
goes back to the blocks that asked. Orders 1 and 0 are tables of at most 65,536
and 256 counts, whatever the corpus, and are sent to all tasks. Word counts of
the unigram base score go the same way by the word's 64-bit fingerprint.

Defined cases: null text is empty (one token, the end; one byte, the closing
one); with no training text every byte has probability 1/256; ids may be null
or repeat; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_column, pack, partitions_for, record_batch, regrouped, runs, ship, stored, unpack

#: Bytes of text in one block (the unit that asks for probabilities).
BLOCK_BYTES = 12 << 20
ROWS_PER_PARTITION = 4000
_CHUNK = 1 << 20
_U = np.uint64
_END_WORD = 0  # fingerprint that stands for the end token

_PARTS = pa.schema([("block", pa.string()), ("kind", pa.string()), ("bucket", pa.int32()), ("blob", pa.binary())])
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
                     ("bits_per_byte", pa.float64())])


def _fold() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def laid_out(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, each behind four zero bytes, and a last four;
    the second array has the place of each text's closing zero byte."""
    sizes = (ends - starts) + 4
    close = np.cumsum(sizes)
    out = np.zeros(int(close[-1]) + 1 if len(close) else 0, np.uint8)
    begin = close - sizes + 4
    at = np.repeat(begin - starts, ends - starts)
    source = np.arange(int(starts[0]), int(ends[-1])) if len(starts) else np.zeros(0, np.int64)
    out[source + at] = _fold()[buf[source]]
    return out, close


def five_grams(laid: np.ndarray, close: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 5-byte string ending at every byte of every text and at its closing
    byte, and the begin of each text's strings. A text's closing byte is the
    first of the zeros before the next text."""
    wide = laid.astype(np.uint64)
    n = len(wide) - 4
    gram = wide[:n]
    for j in range(1, 5):
        gram = (gram << _U(8)) | wide[j:n + j]
    # the gram at i ends at byte i + 4; three of four zeros between texts end nothing
    begin = np.concatenate(([0], close[:-1]))
    keep = np.ones(n, bool)
    for j in range(1, 4):
        at = close[:-1] + j - 4
        keep[at] = False
    sizes = np.diff(np.concatenate(([0], close))) - 3
    return gram[keep], np.concatenate(([0], np.cumsum(sizes)[:-1]))


def _counted(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and their counts (or sums of weights)."""
    if weights is None:
        values = np.sort(values)
    else:
        order = np.argsort(values, kind="stable")
        values, weights = values[order], weights[order]
    new = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(values))) if weights is None else np.add.reduceat(weights, new) if len(new) else weights
    return values[new], count


def word_bags(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Distinct words of each text: their number, (word, times) text by text, and
    the fingerprint of each word, with the end token's behind them."""
    numbers: dict[bytes, int] = {}
    lines, tally = [], []
    for s, e in zip(starts.tolist(), ends.tolist()):
        words = [numbers.setdefault(w, len(numbers)) for w in buf[s:e].tobytes().lower().split()]
        value, count = np.unique(np.array(words, np.int32), return_counts=True)
        lines.append(value)
        tally.append(count.astype(np.int32))
    sizes = np.array([len(x) for x in lines], np.int64)
    value, times = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (lines, tally))
    prints = np.fromiter((xxhash.xxh3_64_intdigest(w) or 1 for w in numbers), np.uint64, len(numbers))
    return sizes, value, times, np.append(prints, _U(_END_WORD))


def _gather(buckets: int):
    """Blocks of text, and what each asks for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in regrouped(batches, "text", BLOCK_BYTES):
            yield from block(table)

    def block(table: pa.Table) -> Iterator[pa.RecordBatch]:
        buf, starts, ends = byte_column(table.column("text"))
        doc = table.column("doc_id").combine_chunks()
        held = table.column("held_out").to_numpy()
        known, ids = doc.is_valid().to_numpy(zero_copy_only=False), doc.fill_null(0).to_numpy()
        train_grams, all_grams, pairs = [], [], np.zeros(1 << 16, np.int64)
        for lo, hi in runs(starts, ends, _CHUNK):
            laid, close = laid_out(buf, starts[lo:hi], ends[lo:hi])
            gram, begin = five_grams(laid, close)
            train = np.repeat(~held[lo:hi], np.diff(np.append(begin, len(gram))))
            value, count = _counted(gram[train])
            train_grams.append((value, count))
            all_grams.append(_counted(gram[~train])[0])
            pairs += np.bincount((gram[train] & _U(0xFFFF)).astype(np.int64), minlength=1 << 16)
        value, count = _counted(*(np.concatenate(x) for x in zip(*train_grams)))
        extra = np.setdiff1d(np.concatenate(all_grams), value)
        gram, count = np.concatenate((value, extra)), np.concatenate((count, np.zeros(len(extra), count.dtype)))
        name = xxhash.xxh3_128_hexdigest(pack(ids, ends - starts) + buf[:1 << 16].tobytes())
        name += f"-{np.random.default_rng().integers(1 << 62):x}"

        sizes, value, times, prints = word_bags(buf, starts, ends)
        trained = np.bincount(value, np.repeat(~held, sizes) * times, minlength=len(prints) - 1).astype(np.int64)
        trained = np.append(trained, int((~held).sum()))

        def dealt(keys, owner, weights, kind):
            order = np.lexsort((keys, owner))
            keys, owner, weights = keys[order], owner[order], weights[order]
            cut = np.searchsorted(owner, np.arange(buckets + 1))
            for b in np.unique(owner).tolist():
                i, j = cut[b], cut[b + 1]
                yield record_batch(_PARTS, [name], [kind], [b], [pack(np.diff(keys[i:j], prepend=_U(0)), weights[i:j].astype(np.int32))])

        owner = ((gram >> _U(8)) & _U(0xFFFF)) * _U(0x9E3779B97F4A7C15)
        yield from dealt(gram, ((owner >> _U(32)) % _U(buckets)).astype(np.int64), count, "gram")
        yield from dealt(prints, (prints % _U(buckets)).astype(np.int64), trained, "word")
        at = np.flatnonzero(pairs)
        yield record_batch(_PARTS, [name], ["pair"], [0], [pack(at.astype(np.int32), pairs[at])])
        body = buf[int(starts[0]):int(ends[-1])] if len(starts) else buf[:0]
        yield record_batch(_PARTS, [name], ["text"], [0], [pack(
            ids, known, held.astype(bool), (ends - starts).astype(np.int64), body)])
    return run


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for blob in batch.column("blob").to_pylist():
            at, n = unpack(blob)
            total[at] += n
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["pair", "n"])


def _read(batches: Iterator[pa.RecordBatch]) -> dict[str, list]:
    found: dict[str, list] = {"gram": [], "word": []}
    for batch in batches:
        for block, kind, bucket, blob in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "bucket", "blob"))):
            step, count = unpack(blob)
            found[kind].append((block, bucket, np.cumsum(step, dtype=np.uint64), count.astype(np.int64)))
    return found


def _word_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training tokens and distinct training tokens of the partition's words."""
    found = _read(batches)["word"]
    if found:
        value, count = _counted(np.concatenate([x[2] for x in found]), np.concatenate([x[3] for x in found]))
        yield pa.RecordBatch.from_arrays([pa.array([int(count.sum())], pa.int64()), pa.array([int((count > 0).sum())], pa.int64())], ["n", "v"])


def _lookup(keys: np.ndarray, table: np.ndarray, values: np.ndarray, missing=0):
    if not len(table):
        return np.full(len(keys), missing, values.dtype)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, values[at], missing)


def log_probabilities(grams: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of the last byte of each gram after its first four.

    ``grams`` are sorted distinct 5-byte strings, complete for every two-byte
    context end among them; ``counts`` their training counts; ``pairs`` the
    training counts of all two-byte strings (65,536)."""
    symbol = grams & _U(0xFF)
    result = np.zeros(len(grams))
    open_ = np.ones(len(grams), bool)
    seen_gram, seen_count = grams[counts > 0], counts[counts > 0]
    pair_table = pairs.reshape(256, 256)
    # of the context one longer than the present order, by gram: symbols seen there and their sum here
    longer_context = longer_symbol = None
    for order in (4, 3, 2, 1, 0):
        width = _U((1 << (8 * (order + 1))) - 1) if order < 7 else None
        if order >= 2:
            here, here_count = _counted(seen_gram & width, seen_count)
        elif order == 1:
            here = np.flatnonzero(pair_table.reshape(-1)).astype(np.uint64)
            here_count = pairs[here.astype(np.int64)]
        else:
            totals = pair_table.sum(0)
            here = np.flatnonzero(totals).astype(np.uint64)
            here_count = totals[here.astype(np.int64)]
        context, total = _counted(here >> _U(8), here_count)
        _, distinct = _counted(here >> _U(8))
        own = (grams >> _U(8)) & (width >> _U(8))
        n, d = _lookup(own, context, total), _lookup(own, context, distinct)
        if longer_context is not None:
            # excluded: what the longer contexts' symbols count in this shorter context
            short = ((longer_context & (width >> _U(8))) << _U(8)) | longer_symbol
            out_context, out_count = _counted(longer_context, _lookup(short, here, here_count))
            _, out_symbols = _counted(longer_context)
            before = (grams >> _U(8)) & longer_width
            n, d = n - _lookup(before, out_context, out_count), d - _lookup(before, out_context, out_symbols)
        c = _lookup((own << _U(8)) | symbol, here, here_count)
        hit, escaped = open_ & (c > 0), open_ & (c == 0) & (n > 0)
        result[hit] += np.log10(c[hit] / (n[hit] + d[hit]))
        result[escaped] += np.log10(d[escaped] / (n[escaped] + d[escaped]))
        open_ &= c == 0
        longer_context, longer_symbol, longer_width = here >> _U(8), here & _U(0xFF), width >> _U(8)
    if open_.any():
        result[open_] -= np.log10(256 - int((pair_table.sum(0) > 0).sum()))
    return result


def _answers(pairs: np.ndarray):
    """Sums over all blocks, sent back to each block in the order it asked
    (probabilities in single precision: they are summed in double)."""
    kinds = {"gram": np.float32, "word": np.int64}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, found in _read(batches).items():
            if not found:
                continue
            value, count = _counted(np.concatenate([x[2] for x in found]), np.concatenate([x[3] for x in found]))
            told = log_probabilities(value, count, pairs) if kind == "gram" else count
            for block, bucket, keys, _ in found:
                yield record_batch(_PARTS, [block], [kind], [bucket], [pack(
                    np.diff(keys, prepend=_U(0)), told[np.searchsorted(value, keys)].astype(kinds[kind]))])
    return run


def _score(n: int, v: int):
    """One block: its text part and the answers to it."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        answers: dict[str, list] = {"gram": [], "word": [], "text": []}
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist()):
            answers[kind].append(unpack(blob))
        ids, known, held, lengths, body = answers["text"][0]
        ends = np.cumsum(lengths)
        starts = ends - lengths
        sizes, value, times, prints = word_bags(body, starts, ends)

        def ordered(kind):
            keys = np.concatenate([np.cumsum(a[0], dtype=np.uint64) for a in answers[kind]])
            told = np.concatenate([a[1] for a in answers[kind]])
            order = np.argsort(keys)
            return keys[order], told[order]

        keys, told = ordered("word")
        count = _lookup(prints, keys, told)
        worth = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
        row = np.repeat(np.arange(len(ids)), sizes)
        base = np.bincount(row, worth[value] * times, minlength=len(ids)) + worth[-1]
        tokens = np.bincount(row, times, minlength=len(ids)).astype(np.int64) + 1
        hits = np.bincount(row, (count[value] > 0) * times, minlength=len(ids)).astype(np.int64) + int(count[-1] > 0)

        keys, told = ordered("gram")
        score = np.zeros(len(ids))
        for lo, hi in runs(starts, ends, _CHUNK):
            laid, close = laid_out(body, starts[lo:hi], ends[lo:hi])
            gram, begin = five_grams(laid, close)
            score[lo:hi] = np.add.reduceat(told[np.searchsorted(keys, gram)].astype(float), begin)
        doc = pa.array(ids, pa.int64(), mask=~known)
        rows = len(ids)
        return pa.Table.from_arrays([
            doc, pa.array(held), pa.array(tokens), pa.array(hits), pa.array(np.full(rows, n, np.int64)), pa.array(base),
            pa.array(score), pa.array(-score / np.log10(2) / (lengths + 1))], schema=_SCORES)
    return run


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all rows by a model of those with ``held_out`` false (null: true)."""
    spark = docs.sparkSession
    ship(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(True)).alias("held_out"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = partitions_for(base.count(), ROWS_PER_PARTITION, 4)
    gathered = stored(base.mapInArrow(_gather(parts), "block string, kind string, bucket int, blob binary"), "kind")
    asked = gathered.where("kind in ('gram', 'word')").repartition(parts, "bucket")
    pairs = np.zeros(1 << 16, np.int64)
    sums = gathered.where("kind = 'pair'").mapInArrow(_pair_sums, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    for r in sums.toLocalIterator():  # at most 65,536 rows
        pairs[r.pair] = r.n
    total = (gathered.where("kind = 'word'").repartition(parts, "bucket").mapInArrow(_word_totals, "n long, v long")
             .agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first())
    answers = asked.select("block", "kind", "bucket", "blob").mapInArrow(_answers(pairs), "block string, kind string, bucket int, blob binary")
    both = gathered.where("kind = 'text'").select("block", "kind", "blob").unionByName(answers.select("block", "kind", "blob"))
    return both.groupBy("block").applyInArrow(
        _score(total.n or 0, total.v or 0),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
