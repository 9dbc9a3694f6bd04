"""Cross-tokenizer alignment: which tokens of two vocabularies stand for the same bytes.

A text's tokens by both tokenizers are laid over the same bytes. Where a token
of A and a token of B end at the same byte, both can be cut. The cuts are found
by divide and conquer: near the middle of an interval a token of A is looked for
whose end is, by bisection among B's ends, the end of a token of B; the interval
is halved there and both halves are treated alike. An interval without such an
end inside is a leaf: a group of A tokens and a group of B tokens that cover the
same bytes. All intervals of a block of texts take their step together; the end
of a text is a common end, so no group crosses texts.

*Counts over the corpus.* A link is a pair of tokens that end together. Texts
are stored in blocks with their links; each block's distinct pairs are counted
before anything is shuffled, and every pair's total and its B token's best total
go back to the blocks that asked for them. What moves is one row for each pair
of a block, so frequent pairs are as many rows as there are blocks, and nothing
is broadcast.

Defined cases: a null or empty text, and one whose tokens do not spell its bytes
(a tokenizer that normalises), has no tokens: zeros and an empty digest; null
ids and repeated rows are kept, each counting as a text; equal best counts are
all best; an empty table gives an empty result; texts of any length are aligned
whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record_batch, regrouped, ship, stored

#: Bytes of text of a block.
BLOCK_BYTES = 16 << 20
#: Bytes of text that are tokenized and aligned at a time.
PIECE_BYTES = 1 << 20
_DOCS = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                   ("groups_sha256", pa.string()), ("links", pa.binary())])
_DOCS_DDL = "block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"
_PAIRS = pa.schema([("block", pa.int64()), ("pair", pa.int64()), ("n", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                  ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])
_OUT_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_level_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable
    characters of Latin-1 for themselves, the other bytes in order from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """Tokenizer A: space + text; its special tokens' strings are plain text.

    Where the merges of ``path`` make the ids in their order, as byte-level
    vocabularies do, the ids are also merge ranks, and ``tiktoken`` gives the
    same ids at a quarter of the cost; any other file is read by ``tokenizers``.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, alphabet = model["vocab"], byte_level_alphabet()
        self.bytes = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            # an entry of other characters never comes out of a text
            self.bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else b""
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        if [vocab.get(m) for m in merges] == list(range(256, 256 + len(merges))):
            import tiktoken
            from public_tokenizers import PATTERN
            self.ranks = tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks={self.bytes[i]: i for i in range(256 + len(merges))},
                                           special_tokens={})
        else:
            from tokenizers import Tokenizer
            self.ranks, self.tokenizer = None, Tokenizer.from_file(path)
            self.tokenizer.encode_special_tokens = True

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        spaced = [" " + t for t in texts]
        if self.ranks:
            return [self.ranks.encode_to_numpy(t, disallowed_special=()) for t in spaced]
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(spaced, add_special_tokens=False)]


class Pieces:
    """Tokenizer B, which adds the space itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        self.processor = SentencePieceProcessor(model_file=path)
        p = self.processor
        self.bytes = [bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode()
                      for i in range(p.get_piece_size())]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.uint32) for x in self.processor.encode(texts, num_threads=1)]


def _of_worker(kind: type, path: str):
    """One per Python worker process and path, kept between tasks."""
    held = sys.modules.setdefault("_ranklab_aligners", types.ModuleType("_ranklab_aligners")).__dict__
    key = f"{kind.__name__} {path}"
    if key not in held:
        held[key] = kind(path)
    return held[key]


def common_cuts(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Places in ``ends_a`` (ascending) of the ends that ``ends_b`` has too, by
    divide and conquer. Both have the same last end."""
    if not len(ends_a):
        return np.zeros(0, np.int64)
    found = [np.array([len(ends_a) - 1])]
    # intervals [lo, hi) of places, and how many of their places were looked at: middle, middle - 1, middle + 1, middle - 2, ...
    lo, hi, seen = np.array([0]), np.array([len(ends_a) - 1]), np.array([0])
    while len(lo := lo[open_ := hi - lo > seen]):
        hi, seen = hi[open_], seen[open_]
        middle, left, right = (lo + hi) // 2, (seen + 1) // 2, seen // 2
        at = np.where(seen % 2, middle - left, middle + right)
        probe = ends_a[at]
        cut = ends_b[np.searchsorted(ends_b, probe)] == probe
        found.append(at[cut])
        on = ~cut
        none = np.zeros(np.count_nonzero(cut), np.int64)
        lo, hi, seen = (np.concatenate(x) for x in ((lo[cut], (middle + right + 1)[cut], lo[on]), ((middle - left)[cut], hi[cut], hi[on]),
                                                    (none, none, seen[on] + 1)))
    return np.sort(np.concatenate(found))


class Aligned:
    """The alignment of a run of texts: ``n_a``, ``n_b`` and ``n_groups`` of each,
    the ids, and the places of the tokens that end each group."""

    def __init__(self, ids_a: list[np.ndarray], ids_b: list[np.ndarray], sizes_a: np.ndarray, sizes_b: np.ndarray):
        def laid(ids, sizes):
            flat = np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int64)
            return flat, np.cumsum(sizes[flat]), np.fromiter(map(len, ids), np.int64, len(ids))
        self.a, ends_a, self.n_a = laid(ids_a, sizes_a)
        self.b, ends_b, self.n_b = laid(ids_b, sizes_b)
        self.cuts_a = common_cuts(ends_a, ends_b)
        self.cuts_b = np.searchsorted(ends_b, ends_a[self.cuts_a])
        upto = np.searchsorted(self.cuts_a, np.cumsum(self.n_a))
        self.n_groups = np.diff(upto, prepend=0)

    def digests(self, names: list[bytes]) -> list[str]:
        """SHA-256 of each text's groups, `a1,a2|b1;a3|b2`. ``names[3 * id + k]`` is the id's number and ',', '|' or ';'."""
        sizes_a, sizes_b = np.diff(self.cuts_a, prepend=-1), np.diff(self.cuts_b, prepend=-1)
        keys_a, keys_b = 3 * self.a, 3 * self.b
        keys_a[self.cuts_a] += 1
        keys_b[self.cuts_b] += 2
        order = np.empty(len(keys_a) + len(keys_b), np.int64)
        order[np.arange(len(keys_a)) + np.repeat(self.cuts_b + 1 - sizes_b, sizes_a)] = keys_a
        order[np.arange(len(keys_b)) + np.repeat(self.cuts_a + 1, sizes_b)] = keys_b
        ends, get, out = np.cumsum(self.n_a + self.n_b).tolist(), names.__getitem__, []
        for lo, hi in zip([0, *ends], ends):
            out.append(hashlib.sha256(b"".join(map(get, order[lo:hi].tolist()))[:-1]).hexdigest() if hi > lo else "")
        return out


def _numbers(n: int) -> list[bytes]:
    return [b"%d%c" % (i, c) for i in range(n) for c in b",|;"]


def _align(path_a: str, path_b: str, piece_bytes: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        coder_a, coder_b = _of_worker(ByteLevel, path_a), _of_worker(Pieces, path_b)
        most = max(len(coder_a.bytes), len(coder_b.bytes))
        names, wide = _numbers(most), most > 1 << 16
        sizes = [np.fromiter(map(len, c.bytes), np.int64, len(c.bytes)) for c in (coder_a, coder_b)]
        block, held, none = TaskContext.get().partitionId() << 32, 0, np.zeros(0, np.uint32)
        for table in regrouped(batches, "text", piece_bytes):
            texts = [t or "" for t in table.column("text").to_pylist()]
            spelled = [b" " + t.encode() for t in texts]
            ids = []
            for coder in (coder_a, coder_b):
                get = coder.bytes.__getitem__
                ids.append([x if t and b"".join(map(get, x.tolist())) == s else none for t, x, s in zip(texts, coder.encode(texts), spelled)])
            both = [len(x) and len(y) for x, y in zip(*ids)]
            found = Aligned(*([x if ok else none for x, ok in zip(of, both)] for of in ids), *sizes)
            links = found.a[found.cuts_a] << (32 if wide else 16) | found.b[found.cuts_b]
            raw, width = links.astype("<u8" if wide else "<u4").tobytes(), 8 if wide else 4
            ends = (width * np.cumsum(found.n_groups)).tolist()
            yield record_batch(_DOCS, np.full(len(texts), block), table.column("doc_id").combine_chunks(), found.n_a, found.n_b, found.n_groups,
                               found.digests(names), [raw[lo:hi] for lo, hi in zip([0, *ends], ends)])
            held += sum(map(len, spelled))
            if held >= block_bytes:
                block, held = block + 1, 0
    return run


def _pairs_of(links: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """The pairs ``a << 32 | b`` of all links of some texts."""
    raw, n = b"".join(links.to_pylist()), int(sizes.sum())
    if len(raw) == 8 * n:
        return np.frombuffer(raw, "<u8").astype(np.int64)
    short = np.frombuffer(raw, "<u4").astype(np.int64)
    return short >> 16 << 32 | short & 0xFFFF


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    now = None

    def counted() -> pa.RecordBatch:
        pairs, n = np.unique(np.concatenate(held), return_counts=True)
        return record_batch(_PAIRS, np.full(len(pairs), now), pairs, n)

    for batch in batches:
        blocks, sizes = batch.column("block").to_numpy(), batch.column("n_groups").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for lo, hi in zip(edges, edges[1:]):
            if hi > lo:
                if held and now != blocks[lo]:
                    yield counted()
                    held = []
                now = int(blocks[lo])
                held.append(_pairs_of(batch.column("links").slice(lo, hi - lo), sizes[lo:hi]))
    if held:
        yield counted()


def _sum_up(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """One block's texts with the counts of their links."""
    docs = docs.combine_chunks()
    sizes = docs.column("n_groups").to_numpy()
    links = _pairs_of(docs.column("links"), sizes)
    pairs, first = np.unique(answers.column("pair").to_numpy(), return_index=True)
    at = first[np.searchsorted(pairs, links)] if len(links) else np.zeros(0, np.int64)
    total, best = answers.column("total").to_numpy(), answers.column("best").to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)

    def per_text(values: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(values)])
        return upto[ends] - upto[ends - sizes]
    return pa.Table.from_arrays([pa.array(x, f.type) if isinstance(x, np.ndarray) else x.cast(f.type) for x, f in zip(
        (docs.column("doc_id"), docs.column("n_a"), docs.column("n_b"), docs.column("n_groups"), sizes, per_text(best[at]),
         per_text(total[at]), docs.column("groups_sha256")), _OUT)], schema=_OUT)


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tokens of A and B, groups, links, links whose pair is its B token's most frequent, the
    sum of the links' counts, and the digest of the groups, for every row."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    laid = stored(texts.mapInArrow(_align(path_a, path_b, PIECE_BYTES, BLOCK_BYTES), _DOCS_DDL))
    pairs = stored(laid.select("block", "n_groups", "links").mapInArrow(_count, "block long, pair long, n long"))
    totals = pairs.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF))
    totals = stored(totals)
    best = totals.groupBy("b").agg(F.max("total").alias("most"))
    known = totals.join(best, "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    answers = pairs.select("block", "pair").join(known, "pair")
    return laid.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_sum_up, _OUT_DDL)
