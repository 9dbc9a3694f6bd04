"""Huffman-coded id files: the code against plain Huffman coding, files by exact round trip."""

import heapq
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ranklab.llm import catalog, huffman_ids
from ranklab.llm.common import documents


def huffman_total(counts):
    heap, total = sorted(counts), 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        total += a + b
        heapq.heappush(heap, a + b)
    return total


def best_limited(counts, bits):
    """Least total over all length choices of a few symbols."""
    best, counts = None, sorted(counts, reverse=True)

    def go(i, least, kraft, total):
        nonlocal best
        if kraft > 1 << bits:
            return
        if i == len(counts):
            best = total if best is None else min(best, total)
            return
        for n in range(least, bits + 1):
            go(i + 1, n, kraft + (1 << bits - n), total + n * counts[i])
    go(0, 1, 0, 0)
    return best


def test_lengths_are_the_best():
    rng = np.random.default_rng(3)
    for _ in range(30):
        counts = rng.integers(1, 1000, rng.integers(2, 300))
        lengths = huffman_ids.code_lengths(counts, 25)
        assert (lengths * counts).sum() == huffman_total(counts.tolist())
    for _ in range(30):
        counts = (rng.pareto(0.4, 7) + 1).astype(np.int64)
        lengths = huffman_ids.code_lengths(counts, 3)
        assert lengths.max() <= 3 and (lengths * counts).sum() == best_limited(counts.tolist(), 3)
    fib = np.array([1, 1] + [0] * 28)
    for i in range(2, 30):
        fib[i] = fib[i - 1] + fib[i - 2]
    lengths = huffman_ids.code_lengths(fib, 8)
    assert lengths.max() == 8 and (2.0 ** -lengths).sum() <= 1
    assert huffman_ids.code_lengths(np.array([5])).tolist() == [1] and len(huffman_ids.code_lengths(np.zeros(0, int))) == 0
    with pytest.raises(ValueError):
        huffman_ids.code_lengths(np.ones(5), 2)


def test_blocks_stand_alone():
    rng = np.random.default_rng(4)
    for n in (1, 2, 511, 512, 513, 20_000):
        ids = np.minimum(rng.pareto(0.5, n), 40_000).astype(np.uint32)
        symbols, counts = np.unique(ids, return_counts=True)
        book = huffman_ids.Codebook(symbols.astype(np.int64), huffman_ids.code_lengths(counts))
        offsets, bits = book.encode(ids)
        assert len(offsets) == -(-n // huffman_ids.BLOCK_IDS) and np.array_equal(book.decode(offsets, bits, n), ids)
        for b in range(0, len(offsets), 7):  # any block without the others
            want = ids[b * huffman_ids.BLOCK_IDS:(b + 1) * huffman_ids.BLOCK_IDS]
            assert np.array_equal(book.decode(offsets[b:b + 1], bits, len(want)), want)


def test_codes_are_canonical():
    book = huffman_ids.Codebook(np.array([3, 5, 9, 11]), np.array([2, 1, 3, 3]))
    assert [(int(book.code[i]), int(book.bits[i])) for i in (5, 3, 9, 11)] == [(0, 1), (2, 2), (6, 3), (7, 3)]


def plain(coder, text):
    return np.array(coder.encode(text or "", add_special_tokens=False).ids + [2], "<u4").tobytes()


def check(rows, want):
    """``want``: (doc_id, ids) in ascending order, null first; ties in any order."""
    rows = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [d for d, _ in want]
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows]).tolist()[:-1]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == Counter((d, len(x) // 4, zlib.crc32(x)) for d, x in want)


def test_query_gives_what_the_tokenizer_does(spark):
    sf = "/root/testdata/sf0.001"
    coder = Tokenizer.from_file(catalog.TOKENIZER)
    want = [(r.doc_id, plain(coder, r.text)) for r in sorted(documents(spark, sf).collect(), key=lambda r: r.doc_id)]
    check(catalog.op11_huffman_ids(spark, sf).collect(), want)


def test_odd_rows_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(huffman_ids, "PART_BYTES", 4000)
    monkeypatch.setattr(huffman_ids, "SEGMENT_IDS", 300)
    coder = Tokenizer.from_file(catalog.TOKENIZER)
    data = [(None, None), (None, "no id"), (7, ""), (7, "İ. Ünï–çode <|endoftext|> क़."), (8, "same row"), (8, "same row"), (-3, "word " * 40_000)]
    data += [(None, "one key holds many rows")] * 60 + [(100 - i, f"text {i}, it's {i}") for i in range(60)]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("part", "ids", "at", "row", "start")})
    folder = huffman_ids.write_ids(docs.repartition(5), catalog.TOKENIZER, added_tokens=True)
    want = [(d, plain(coder, t)) for d, t in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0))]
    check(huffman_ids.read_ids(spark, folder, digest=True).collect(), want)
    files = spark.read.parquet(f"{folder}/segments").collect()
    assert len(files) > 5 and all(len(s.lengths) == 1 or s.n_ids <= 300 for s in files)
    whole = sorted(huffman_ids.read_ids(spark, folder).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, bytes(r.ids)) for r in whole) == Counter(want)


def test_empty_table(spark):
    folder = huffman_ids.write_ids(spark.createDataFrame([], "doc_id long, text string"), catalog.TOKENIZER)
    assert huffman_ids.read_ids(spark, folder).count() == 0
