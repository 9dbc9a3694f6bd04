"""Near-duplicate classes by DartMinHash over word shingles.

*Signature.* Every shingle owns an area: its weight by an endless rank axis.
Hash-seeded darts (a Poisson process of rate one) are thrown into the dyadic
regions of that area, independent of the text that holds the shingle; darts
above the shingle's weight in a text miss. A dart also hashes to one of ``k``
coordinates, whose signature value is the dart of earliest rank. Ranks are
looked at up to ``(k ln k + 2k) / total weight``, so the work depends on ``k``
and the number of shingles, not on their product; texts with an empty
coordinate are thrown again with twice that limit. Two texts agree in a
coordinate with probability equal to their weighted Jaccard similarity.

*Banded joining.* Texts that agree in a whole band of coordinates are
candidates. Candidates are compared exactly (shingles of the whole texts), first
with the smallest id of each band bucket, so a bucket of any size costs a row
per member. The texts of buckets whose members are then still in different
classes are settled by an exact prefix filter (``rare_pairs``): they are compared
where they share one of their rarest shingles. Texts that have a passage in
common but are not similar do not meet there, however many they are; a similar
pair always does.

Defined cases: texts are words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case;
a text of one to four words is one shingle; texts without words are near copies
only of equal texts; null text is empty; equal texts are one class. Texts are
told apart by their hash, whatever their ids: the texts of a repeated id are
classed each by itself, and rows with a null id like all others (a class in
which no row has an id has a null class_id); texts of any length are signed and
compared whole; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklab.operators.skew import salted_join

from .byte_anchors import BASE, MIX, Substrings, mix
from .common import byte_column, partitions_for, record_batch, runs, ship, stored
from .components import connected_components

WORDS, SIMILARITY = 5, (4, 5)
BANDS, ROWS = 42, 6
#: Shingles beyond which frequent ones are dealt over salts.
SALTED_ROWS = 100_000
#: Cells of the maps by which texts are told apart before they are compared.
MAP_BITS = 1024
ROWS_PER_PARTITION = 4000
_CHUNK = 1 << 18
_U = np.uint64


def _space_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[32, 9, 10, 11, 12, 13]] = True
    return table


def _fold_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def shingles(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: int = WORDS):
    """(text, fingerprint, count) of the distinct shingles of texts that lie end
    to end in ``buf``, ordered by text and fingerprint."""
    space = _space_table()[buf]
    edge = space.copy()
    first = np.ones(len(buf) + 1, bool)
    first[1:-1] = space[:-1]
    first[starts[starts < len(buf)]] = True
    last = np.ones(len(buf) + 1, bool)
    last[:-1] = space
    last[starts[starts < len(buf)]] = True
    lo = np.flatnonzero(first[:-1] & ~edge)
    hi = np.flatnonzero(last[1:] & ~edge) + 1
    text = np.searchsorted(ends, lo, side="right")
    word = Substrings(_fold_table()[buf])(lo, hi)
    n = len(word)
    gram = np.zeros(n, np.uint64)
    each = np.bincount(text, minlength=len(starts))
    size = np.minimum(each, words)[text]  # short texts: one shingle of all their words
    place = np.arange(n) - (np.cumsum(each) - each)[text]
    for j in range(words):
        use = j < size
        source = np.minimum(np.arange(n) + j, n - 1)
        gram = np.where(use, mix(gram * BASE + word[source]), gram)
    whole = place + size <= each[text]
    text, gram = text[whole], gram[whole]
    order = np.lexsort((gram, text))
    text, gram = text[order], gram[order]
    new = np.flatnonzero(np.concatenate(([True], (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])))) if len(gram) else order
    return text[new], gram[new], np.diff(np.append(new, len(gram)))


def _poisson_table(area: float) -> np.ndarray:
    """Cumulative probabilities of Poisson(area), up to where they reach one."""
    top = int(area + 12 * math.sqrt(area) + 24)
    logs = np.cumsum(np.concatenate(([-area], np.log(area / np.arange(1, top)))))
    return np.cumsum(np.exp(logs))


def dart_signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, k: int) -> np.ndarray:
    """Signatures (texts by ``k``) of weighted sets. ``text`` is ascending;
    texts without elements get zeros. A value holds the rank (40 bits of fixed
    point over 2**31) and 24 bits that name the dart."""
    none = np.iinfo(np.uint64).max
    out = np.full((texts, k), none, np.uint64)
    total = np.bincount(text, weight, minlength=texts)
    limit = np.zeros(texts)
    limit[total > 0] = (k * math.log(k) + 2 * k) / total[total > 0]
    todo = total > 0
    while todo.any():
        use = todo[text]
        t, e, w, reach = text[use], element[use], weight[use].astype(float), limit[text[use]]
        flat = out.reshape(-1)
        heavy = 0
        while heavy < 60 and (some := w > 2 ** heavy - 1).any():
            rank = 0
            while rank < 31 and (hit := some & (reach > 2 ** rank - 1)).any():
                seed = e[hit] ^ mix(np.array([(heavy << 8) + rank + 1], np.uint64) * BASE)
                # darts of the region [2^heavy - 1, 2^(heavy+1) - 1) x [2^rank - 1, 2^(rank+1) - 1)
                u = (mix(seed) >> _U(11)).astype(float) * 2.0 ** -53
                darts = np.searchsorted(_poisson_table(2.0 ** (heavy + rank)), u)
                at = np.repeat(np.flatnonzero(hit), darts)
                number = np.arange(len(at)) - np.repeat(np.cumsum(darts) - darts, darts)
                h = mix(np.repeat(seed, darts) + (number + 1).astype(np.uint64) * MIX)
                place = 2.0 ** rank * (1 + (h >> _U(24)).astype(float) * 2.0 ** -40) - 1
                keep = place < reach[at]
                if heavy or (w[hit] < 1).any():
                    height = 2.0 ** heavy * (1 + (mix(h ^ MIX) >> _U(11)).astype(float) * 2.0 ** -53) - 1
                    keep &= height < w[at]
                at, h, place = at[keep], h[keep], place[keep]
                name = mix(h + BASE)
                coordinate = ((name >> _U(32)) * _U(k)) >> _U(32)
                value = ((place * 2.0 ** 9).astype(np.uint64) << _U(24)) | (name & _U(0xFFFFFF))
                np.minimum.at(flat, t[at] * k + coordinate.astype(np.int64), value)
                rank += 1
            heavy += 1
        todo = todo & (out == none).any(1) & (limit < 2.0 ** 30)
        limit *= 2
    out[out == none] = 0
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.zeros((len(signatures), bands), np.uint64)
    for r in range(rows):
        h = mix(h * BASE + signatures[:, r * bands:(r + 1) * bands])
    return mix(h + np.arange(1, bands + 1, dtype=np.uint64) * MIX).view(np.int64)


_SIGNED = pa.schema([("row", pa.int64()), ("doc", pa.int64()), ("hash", pa.binary()), ("size", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _sign(words: int, bands: int, rows: int, counted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, starts, ends = byte_column(batch.column("text"))
            for lo, hi in runs(starts, ends, _CHUNK):
                base = starts[lo]
                text, gram, count = shingles(buf[base:ends[hi - 1]], starts[lo:hi] - base, ends[lo:hi] - base, words)
                signed = dart_signatures(text, gram, count if counted else np.ones(len(gram)), hi - lo, bands * rows)
                size = np.bincount(text, minlength=hi - lo)
                keys = band_keys(signed, bands, rows)
                lists = [k if n else [] for k, n in zip(keys, size)]
                yield record_batch(_SIGNED, *(batch.column(c).slice(lo, hi - lo) for c in ("row", "doc", "hash")), size, lists)
    return run


_MAP = [f"m{i}" for i in range(MAP_BITS // 64)]
_GRAMS = pa.schema([("text_id", pa.int64()), ("class", pa.int64()), ("n", pa.int64()), ("grams", pa.list_(pa.int64())), *((m, pa.int64()) for m in _MAP)])
_GRAMS_DDL = "text_id long, class long, n long, grams array<long>, " + ", ".join(f"{m} long" for m in _MAP)


def parity_maps(text: np.ndarray, gram: np.ndarray, texts: int) -> np.ndarray:
    """For each text a bit for each of ``MAP_BITS`` cells: whether an odd number of its shingles falls there.
    Where the bits of two texts differ, a shingle lies that only one of them has, and no two such cells share it."""
    out = []
    cell = (gram >> _U(64 - int(MAP_BITS).bit_length() + 1)).astype(np.int64)
    for lo in range(0, texts, 1000):
        hi = min(lo + 1000, texts)
        i, j = np.searchsorted(text, (lo, hi))
        odd = np.bincount((text[i:j] - lo) * MAP_BITS + cell[i:j], minlength=(hi - lo) * MAP_BITS).astype(np.uint8) & 1
        out.append(np.packbits(odd.reshape(-1, MAP_BITS), axis=1).view(np.int64))
    return np.concatenate(out)


def _grams(words: int, counted: bool):
    """Each text's shingles as a set of numbers; of a shingle that counts several times, each occurrence is one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, starts, ends = byte_column(batch.column("text"))
            for lo, hi in runs(starts, ends, _CHUNK):
                base = starts[lo]
                text, gram, count = shingles(buf[base:ends[hi - 1]], starts[lo:hi] - base, ends[lo:hi] - base, words)
                if counted:
                    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    text, gram = np.repeat(text, count), mix(np.repeat(gram, count) + nth.astype(np.uint64) * MIX)
                cut = np.searchsorted(text, np.arange(hi - lo + 1))
                sets = [gram[i:j].view(np.int64) for i, j in zip(cut, cut[1:])]
                yield record_batch(_GRAMS, batch.column("text_id").slice(lo, hi - lo), batch.column("class").slice(lo, hi - lo),
                                   np.diff(cut), sets, *parity_maps(text, gram, hi - lo).T)
    return run


def rare_pairs(texts: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY, counted: bool = False) -> DataFrame:
    """Pairs (a < b) of ``texts`` (text_id, class, text) in different classes, among them every pair of at least
    ``similarity``: an exact prefix filter.

    All shingles are put in one order, the rarest first. Of two similar texts
    the larger one's first ``n - ceil(t n) + 1`` shingles and the smaller one's first
    ``n - ceil(2 t n / (1 + t)) + 1`` have one in common, so texts meet only where
    they share a shingle that is among their rarest; a passage that many share
    is not. Of the classes at such a shingle the largest does not meet itself.
    Two texts that meet are a pair unless their sizes, the places of the shingle
    in their orders, or the cells in which their ``parity_maps`` differ leave too
    few shingles in common; each of these is a bound, so no similar pair is lost."""
    up, down = similarity
    members = stored(texts.select("text_id", "class", "text").mapInArrow(_grams(words, counted), _GRAMS_DDL))
    tokens = members.select("text_id", F.explode("grams").alias("gram"))
    often = stored(tokens.groupBy("gram").agg(F.count("*").alias("texts")).where("texts > 1"))
    # a shingle of one text meets nothing; it only counts in that text's order, in front of all others
    shared = salted_join(tokens, often.withColumnRenamed("gram", "often"), [("gram", "often")], "inner", least_rows=SALTED_ROWS)
    order = shared.groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("texts", "gram"))).alias("order"))
    first = F.expr(f"cast(n - (n * {up} + {down - 1}) div {down} + 1 as int)")
    index = F.expr(f"cast(n - (n * {2 * up} + {up + down - 1}) div {up + down} + 1 as int)")
    placed = members.drop("grams", *_MAP).join(order, "text_id").withColumn("alone", F.expr("cast(n - size(order) as int)"))
    placed = placed.select("text_id", "class", "n", "alone", index.alias("index"), F.posexplode(F.slice("order", 1, F.greatest(first - F.col("alone"), F.lit(0)))))
    posting = stored(placed.select("text_id", "class", "n", F.col("col.gram").alias("gram"), (F.col("pos") + F.col("alone")).alias("at"),
                                   (F.col("pos") + F.col("alone") < F.col("index")).alias("indexed")))
    classes = posting.groupBy("gram", "class").agg(F.count("*").alias("size"))
    mixed = classes.groupBy("gram").agg(F.max(F.struct("size", "class")).alias("most"), F.count("*").alias("n_classes")).where("n_classes > 1")
    met = stored(posting.join(mixed.select("gram", F.col("most.class").alias("largest")), "gram")
                 .withColumn("many", F.col("class") == F.col("largest")).drop("largest")
                 .join(members.select("text_id", *_MAP), "text_id"))
    x, y = (met.select(*(F.col(c).alias(c + side) for c in met.columns)) for side in ("_a", "_b"))
    smaller = F.struct("n_a", "text_id_a") < F.struct("n_b", "text_id_b")
    # at most: what may be common in front of the shared shingle, it, and what may be common behind
    most = F.least("at_a", "at_b") + 1 + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) - 1
    both = F.col("n_a") + F.col("n_b")
    differ = sum((F.bit_count(F.col(m + "_a").bitwiseXOR(F.col(m + "_b"))) for m in _MAP[1:]), F.bit_count(F.col("m0_a").bitwiseXOR(F.col("m0_b"))))
    may = (F.least("n_a", "n_b") * down >= F.greatest("n_a", "n_b") * up) & (most * (up + down) >= both * up) & (differ * (up + down) <= both * (down - up))
    pairs = x.where("not many_a").join(y, (F.col("gram_a") == F.col("gram_b")) & (F.col("class_a") != F.col("class_b"))
                                       & (F.col("many_b") | (F.col("text_id_a") < F.col("text_id_b")))
                                       & F.when(smaller, F.col("indexed_a")).otherwise(F.col("indexed_b")) & may)
    return pairs.select(F.least("text_id_a", "text_id_b").alias("a"), F.greatest("text_id_a", "text_id_b").alias("b")).distinct()


_COMPARED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("both", pa.int64()), ("either", pa.int64())])


def _compare(words: int, counted: bool):
    def sets(texts: list[bytes]):
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - [len(t) for t in texts]
        text, gram, count = shingles(np.frombuffer(b"".join(texts), np.uint8), starts, ends, words)
        cut = np.searchsorted(text, np.arange(len(texts) + 1))
        return [(gram[i:j], count[i:j] if counted else np.ones(j - i, np.int64)) for i, j in zip(cut, cut[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
                texts: dict[bytes, int] = {}
                pair = [[texts.setdefault(t.encode(), len(texts)) for t in part.column(c).to_pylist()] for c in ("text_a", "text_b")]
                known, out = sets(list(texts)), []
                for x, y, i, j in zip(a, b, *pair):
                    (g, m), (h, n) = known[i], known[j]
                    _, p, q = np.intersect1d(g, h, assume_unique=True, return_indices=True)
                    both = int(np.minimum(m[p], n[q]).sum())
                    out.append((x, y, both, int(m.sum() + n.sum()) - both))
                if out:
                    yield record_batch(_COMPARED, *zip(*out))
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                    similarity: tuple[int, int] = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
                    counted: bool = False, parts: int | None = None) -> DataFrame:
    """doc_id, class_id (smallest id of the class), text_id (smallest id of the
    equal texts) of every row. Texts are linked when the Jaccard similarity of
    their shingle sets (``counted``: of shingle counts) is at least ``similarity``."""
    base, known = text_classes(docs, id_col, text_col, words, similarity, bands, rows, counted, parts)
    return base.select("doc", "hash").join(known, "hash", "left").select(F.col("doc").alias("doc_id"), "class_id", "text_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each class: of the smallest id (null last) and, of that id's texts, the smallest hash."""
    # the caller's columns travel as one struct, so their names meet no name of this function
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("columns")
    base, known = text_classes(docs, id_col, text_col, keep=(rest, F.col(text_col).isNull().alias("no_text")))
    # per text, then per class: a class of any size is combined before it moves
    of_text = base.groupBy("hash").agg(F.min(F.struct(F.col("doc").isNull().alias("nameless"), "doc", "row")).alias("best"))
    order = F.struct("best.nameless", "best.doc", "hash", "best.row")
    best = known.join(of_text, "hash").groupBy("component").agg(F.min(order).alias("best")).select(F.col("best.row").alias("row"))
    return base.join(best, "row", "left_semi").select(
        *(F.when(~F.col("kept.no_text"), F.col("text")).alias(c) if c == text_col else F.col(f"kept.columns.`{c}`").alias(c) for c in docs.columns))


def text_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                 similarity: tuple[int, int] = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
                 counted: bool = False, parts: int | None = None, keep: tuple[str | Column, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The stored rows (row, doc, hash, text, and the columns ``keep`` as a struct
    ``kept``), and hash, component, class_id, text_id of each distinct text. The
    number of one of its rows stands for a text in buckets, pairs and components."""
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc"),
                       F.unhex(F.sha2(text, 256)).alias("hash"), text.alias("text"), *([F.struct(*keep).alias("kept")] if keep else []))
    base = stored(base)  # row numbers stay as they are
    parts = parts or partitions_for(base.count(), ROWS_PER_PARTITION, 4)
    signed = stored(base.select("row", "doc", "hash", "text").mapInArrow(
        _sign(words, bands, rows, counted), "row long, doc long, hash binary, size long, bands array<long>"))
    firsts = stored(signed.groupBy("hash").agg(F.min("row").alias("text_id"), F.min("doc").alias("first_id"), F.min_by("bands", "row").alias("bands")))
    member = firsts.select("text_id", F.explode("bands").alias("band"))
    lead = member.groupBy("band").agg(F.min("text_id").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = stored(member.join(lead, "band"))  # members of buckets with several texts
    texts = base.select(F.col("row").alias("text_id"), "text").repartition(parts, "text_id")
    compare = _compare(words, counted)
    up, down = similarity

    def compared(pairs: DataFrame) -> DataFrame:
        left = pairs.join(texts.withColumnRenamed("text", "text_a"), pairs.a == F.col("text_id")).drop("text_id")
        both = left.join(texts.withColumnRenamed("text", "text_b"), F.col("b") == F.col("text_id")).drop("text_id")
        return stored(both.select("a", "b", "text_a", "text_b").repartition("a", "b")
                      .mapInArrow(compare, "a long, b long, both long, either long"))

    linked = F.expr(f"{down} * both >= {up} * either and either > 0")
    seen = compared(shared.where("text_id > lead").select(F.col("lead").alias("a"), F.col("text_id").alias("b")).distinct())
    classes = connected_components(seen.where(linked).select("a", "b"))
    # buckets whose members are in different classes: their texts may have links that the leads did not show
    placed = shared.join(classes, shared.text_id == classes.node, "left").select(
        "band", "text_id", F.coalesce("component", "text_id").alias("class"))
    open_ = placed.groupBy("band").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("band")
    open_texts = placed.join(open_, "band").select("text_id", "class").distinct()
    pairs = rare_pairs(texts.join(open_texts, "text_id"), words, similarity, counted)
    pairs = stored(pairs.join(seen, ["a", "b"], "left_anti"))
    if not pairs.isEmpty():
        classes = connected_components(seen.unionByName(compared(pairs)).where(linked).select("a", "b"))
    placed = stored(firsts.join(classes, firsts.text_id == classes.node, "left").select(
        "hash", F.coalesce("component", "text_id").alias("component"), "first_id"))
    least = stored(placed.groupBy("component").agg(F.min("first_id").alias("class_id")))
    return base, placed.join(least, "component").select("hash", "component", "class_id", F.col("first_id").alias("text_id"))
