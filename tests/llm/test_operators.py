"""Operators against brute force on small rows with nulls, empty, repeated and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ranklab.llm import dart_minhash, decontamination, language_id, packing, quality_classifier, quality_rules, secret_scan, sharding, suffix_dedup
from ranklab.llm.common import crc_mod, documents

SF = "/root/testdata/sf0.001"
BLANKS = re.compile(rb"[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows(spark):
    return sorted(((r.doc_id, r.text) for r in documents(spark, SF).collect()), key=lambda r: r[0])


def odd_docs(spark, extra=()):
    """Null, empty, repeated and clashing rows beside the given ones."""
    data = [(9001, None, None, None), (9002, "", "en", "s"), (9003, " \n\t", "en", "s"), (None, "no id here but some words follow", None, None),
            (9004, "same row twice", "fr", "s"), (9004, "same row twice", "fr", "s"), *extra]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    return df.withColumns({"doc": F.lit("x"), "key": F.lit(1), "score": F.lit(2.0), "words": F.lit("w"), "n": F.lit(1)})


# sharding

def claim_turns(shards, slots):
    orders = []
    for s in shards:
        o, k = sharding.name_hash("offset:" + s) % slots, sharding.name_hash("skip:" + s) % (slots - 1) + 1
        orders.append([(o + j * k) % slots for j in range(slots)])
    table, turn = {}, 0
    while len(table) < slots:
        order = orders[turn % len(shards)]
        table[next(x for x in order if x not in table)] = turn % len(shards)
        turn += 1
    return [table[i] for i in range(slots)]


def test_lookup_table():
    names = sharding.shard_names(7)
    assert sharding.lookup_table(names, 251) == claim_turns(names, 251)
    counts = Counter(sharding.lookup_table(sharding.shard_names(), sharding.SLOTS)).values()
    assert max(counts) - min(counts) <= 1
    weighted = Counter(sharding.lookup_table(names[:2], 1009, [2.0, 1.0]))
    assert weighted[0] / weighted[1] == pytest.approx(2, rel=0.02)
    before, after = (sharding.lookup_table(names[:n], 4099) for n in (7, 6))
    assert sum(a != b for a, b in zip(before, after) if a != 6) < 0.1 * 4099  # little moves besides the removed shard
    for bad in (([], 7), (names, 8), (names, 5), (["a", "a"], 7)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_place(spark):
    df = odd_docs(spark).withColumn("shard", F.lit("old"))
    out = sharding.place(df, "doc_id", sharding.shard_names(3), 31).collect()
    table = sharding.lookup_table(sharding.shard_names(3), 31)
    assert len(out) == 6
    for r in out:
        slot = sharding.name_hash("" if r.doc_id is None else str(r.doc_id)) % 31
        assert (r.slot, r.shard) == (slot, f"shard-{table[slot]:03d}")
    assert sharding.place(df.limit(0), "doc_id", ["a"], 31).count() == 0


# language identification

def test_language(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    out = language_id.identify_languages(docs, crc_mod("doc_id", 3) == 1).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_language_edges(spark):
    extra = [(i, t, lang, "s") for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 5)]
    extra += [(100, "12345 !!", "en", "s"), (101, "THE CAT " * 20000, None, "s")]
    out = {r.doc_id: r for r in language_id.identify_languages(odd_docs(spark, extra), F.col("doc_id") > 99).collect()}
    assert [out[i].lang_pred for i in (9001, 9002, 9003, 100)] == ["und"] * 4 and out[9001].score == 0
    assert out[101].lang_pred == "en" and out[0].lang_pred == "en" and out[1].lang_pred == "de"
    none = language_id.identify_languages(odd_docs(spark), F.lit(True)).collect()
    assert len(none) == 6 and {r.lang_pred for r in none} == {"und"}


# secrets

def test_secrets(spark, rows):
    key = "AKIA" + "Q7Z4" * 4
    extra = [(1, f"use {key}, then {key}.", "en", "s"), (2, f'token = "{hashlib.sha1(b"a").hexdigest()}" end', "en", "s"),
             (3, "plainwordsthatareverylong " * 3, "en", "s"), (4, "x" * 300_000, "en", "s"), (5, None, "en", "s")]
    extra += [(10 + i, t, "en", "s") for i, t in rows[:60]]
    extra += [(500 + i, f"my password={hashlib.md5(str(i).encode()).hexdigest()[:18]} is here", "en", "s") for i in range(30)]
    docs = odd_docs(spark, extra)
    out = secret_scan.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[1] == "use <secret>, then <secret>." and got[2] == 'token = "<secret>" end'
    assert got[3] == extra[2][1] and got[5] is None and got[9001] is None and got[9004] == "same row twice"
    assert all(got[500 + i] == "my password=<secret> is here" for i in range(30))
    empty = secret_scan.scan(docs.limit(0))
    assert empty.count() == 0


# quality rules

def base_counts(text):
    words = [w for w in BLANKS.split(text.encode()) if w]
    grams = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            hit |= set(range(i, i + 8))
    lines, dup, old = text.split("\n"), 0, set()
    for line in lines:
        if [w for w in BLANKS.split(line.encode()) if w]:
            dup += line in old
            old.add(line)
    return (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(hit))


def test_quality_rules(spark, rows):
    extra = [(i, t, "en", "src") for i, t in rows] + [(8000, "é à # " * 40 + "\n" + "a\x1cb\n\na\x1cb", "en", "src"), (8001, "word " * 50_000, "en", "src")]
    out = quality_rules.apply_rules(odd_docs(spark, extra)).collect()
    assert len(out) == len(extra) + 6
    texts = {i: t for i, t, *_ in extra} | {9001: "", 9002: "", 9003: " \n\t", 9004: "same row twice", None: "no id here but some words follow"}
    for r in out:
        want = base_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality_rules.apply_rules(odd_docs(spark).limit(0)).count() == 0


def test_mcd(spark):
    """The distributed steps find the planted outliers and the clean rows' scatter."""
    rng = np.random.default_rng(3)
    clean, bad = rng.normal(size=(900, 2)) @ np.array([[2, 1], [0, 1.5]]), rng.normal(size=(90, 2)) * 0.1 + (14, -12)
    data = [(i, "a", *map(float, x)) for i, x in enumerate(np.concatenate((clean, bad)))] + [(5000 + i, "tiny", 0.0, 0.0) for i in range(5)]
    df = spark.createDataFrame(data, "row long, cell string, length double, word_length double")
    got = {r.row: r.distance for r in quality_rules.mcd_distances(df, ["length", "word_length"], least=20).collect()}
    assert not any(5000 + i in got for i in range(5))
    far = {i for i, d in got.items() if d > quality_rules.chi2_quantile(2, 0.9999)}
    assert set(range(900, 990)) <= far and len(far) <= 93
    assert np.median([got[i] for i in range(900)]) == pytest.approx(1.386, rel=0.25)


# repeats

def test_repeats(spark, rows):
    passage = " ".join(f"w{i}" for i in range(30))
    data = [(i, t) for i, t in rows[:80]] + [(700 + i, f"{'z' * i}{passage}{i}") for i in range(12)]
    data += [(800, "a" * 400), (801, "a" * 60), (802, "short"), (803, None), (803, "x" * 70), (803, "x" * 70), (None, "a" * 80), (804, "é" * 40)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({"doc": F.lit(1), "key": F.lit("k"), "spans": F.lit(0)})
    got = suffix_dedup.remove_repeats(df).collect()
    assert len(got) == len(data)
    first = {}
    for i, t in data:
        b = (t or "").encode()
        for p in range(len(b) - 49) if i is not None else ():
            first[b[p:p + 50]] = min(i, first.get(b[p:p + 50], i))
    want = Counter()
    for i, t in data:
        b = (t or "").encode()
        hit = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if i is not None and first[b[p:p + 50]] < i:
                hit[p:p + 50] = True
        n = int((np.diff(np.concatenate(([0], hit))) == 1).sum())
        want[i, len(b), int(hit.sum()), n, hashlib.sha256(np.frombuffer(b, np.uint8)[~hit].tobytes()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_large_buckets_by_window(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LARGE_BUCKET", 2)
    test_repeats(spark, [])


# quality classifier

def test_quality_classifier(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = documents(spark, sf), documents(spark, sf, "labels")
    out = quality_classifier.quality_scores(docs, labels, crc_mod("doc_id", 5) == 0).join(labels, "doc_id").collect()
    held = [(r.score, r.quality, r.predicted) for r in out if r.held_out]
    good, bad = ([s for s, q, _ in held if q == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    odd = quality_classifier.quality_scores(odd_docs(spark), labels.limit(0), F.lit(False)).collect()
    assert len(odd) == 6 and {r.score for r in odd} == {0.5}


# decontamination

def test_decontamination(spark):
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    item = " ".join(alphabet[i] * 3 for i in range(14))
    items = [(10, item), (2, "Short phrase"), (3, None), (4, "!!"), (5, item), (6, "xx " * 11), (7, "lone")]
    window = " ".join(alphabet[i] * 3 for i in range(2, 12))
    data = [(1, f"pre {window.upper()} post"), (2, f"{item}; {item}"), (3, window[:-4]), (4, "a SHORT-phrase, é"), (5, "xx " * 15), (6, None), (6, ""),
            (7, "É Lone é"), (7, "É Lone é"), (None, window), (8, "nothing" * 20_000)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({"key": F.lit(0), "item_id": F.lit(1), "term": F.lit("t")})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("phrase", F.lit("p"))

    def words(t):
        t = "".join(c.lower() if c.isascii() else c for c in t or "")
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t) if w]

    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for s in range(max(len(w) - 9, 1)) if w else ():
            windows[tuple(w[s:s + 10])].add(str(i))
    want = Counter()
    for d, t in data:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s:s + n])]
        want[d, len(w), len(hit), len(found), tuple(sorted(found)), bool(hit)] += 1
    got = decontamination.contamination(df, bench).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r.items), r.contaminated) for r in got) == want
    assert decontamination.contamination(df.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in decontamination.contamination(df, bench.limit(0)).collect())
    base = decontamination.keyed(spark.createDataFrame([(1, "alpha x x beta"), (2, "alpha " + "x " * 9 + "beta")], "doc_id long, text string"), "doc_id", "text")
    two = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    assert [r.doc for r in decontamination.occurrences(base, two, proximity=4)[0].collect()] == [1]


# packing

def test_packing(spark, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    extra = [(i, t, "en", "s") for i, t in rows[:100]] + [(8000, "long text, it's don't é … « ok ».! <|endoftext|> " * 900, "en", "s")]
    extra += [(8001, "nb sp x\x1cy", "en", "s"), (8002, "ab" * 3000, "en", "s")]
    docs = odd_docs(spark, extra)
    got = packing.best_fit_packing(docs, path).collect()
    coder = Tokenizer.from_file(path)
    coder.encode_special_tokens = True
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = np.array(coder.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        for k, s in enumerate(range(0, len(ids), 2048)):
            cut = ids[s:s + 2048]
            want[r.doc_id, k, s, len(cut), zlib.crc32(cut.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:i]) for i in range(len(v))] and sum(n for _, n in v) <= 2048
    assert len(by) <= -(-sum(r.length for r in got) // 2048) + 1
    assert packing.best_fit_packing(docs.limit(0), path).count() == 0


def test_bounds_and_exchange(spark):
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = rng.integers(1, 101, rng.integers(1, 60))
        bins, offsets, n = packing.best_fit_decreasing(lengths, 100)
        assert np.bincount(bins, lengths).max() <= 100 and n >= packing.bin_bound(lengths, 100) >= -(-lengths.sum() // 100)
    assert packing.bin_bound(np.array([60] * 5), 100) == 5 and packing.bin_bound(np.array([40] * 5), 100) == 3
    pieces = spark.createDataFrame([(i, 0, int(n)) for i, n in enumerate(rng.integers(300, 700, 400))], "doc_id long, piece int, length long")
    out = packing.pack_pieces(pieces, 1000, part_pieces=40).collect()
    assert len(out) == 400 and len({r.doc_id for r in out}) == 400
    fill = Counter()
    for r in out:
        fill[r.sequence_id] += r.length
    one = packing.best_fit_decreasing(np.array([r.length for r in out]), 1000)[2]
    assert max(fill.values()) <= 1000 and len(fill) <= 1.1 * one


# near duplicates

def test_signatures_estimate_similarity():
    k, elements = 2000, dart_minhash.mix(np.arange(1, 200, dtype=np.uint64))
    a, b = np.arange(0, 150), np.arange(50, 199)
    text = np.concatenate((np.zeros(len(a), int), np.ones(len(b), int)))
    for weight in (np.ones(199), np.random.default_rng(0).integers(1, 9, 199)):
        s = dart_minhash.dart_signatures(text, elements[np.concatenate((a, b))], np.concatenate((weight[a], weight[b])), 2, k)
        want = weight[50:150].sum() / weight.sum()
        assert (s[0] == s[1]).mean() == pytest.approx(want, abs=0.04)


def test_near_duplicates(spark, rows):
    rng = np.random.default_rng(5)
    long = [f"word{rng.integers(5000)}" for _ in range(300)]
    data = [(i, t) for i, t in rows]
    for i in range(25):
        w = list(long)
        w[rng.integers(300)] = f"new{i}"
        data.append((3000 + i, " ".join(w)))
    data += [(4000, "one two"), (4001, "ONE  two"), (4002, "one two"), (4003, None), (4004, ""), (None, "one two"), (4005, " \n"), (4006, "a b c d e f"), (4006, "a b c d e f")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({"band": F.lit(1), "hash": F.lit("h"), "node": F.lit(0)})
    got = defaultdict(set)
    for r in dart_minhash.near_duplicates(df).collect():
        got[r.doc_id].add(r.class_id)

    def sets(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    known = [(i, t or "", sets(t)) for i, t in data if i is not None]
    parent = list(range(len(known)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, t, s) in enumerate(known):
        for y in range(x):
            j, u, v = known[y]
            if t == u or (s and v and 5 * len(s & v) >= 4 * len(s | v)):
                parent[root(x)] = root(y)
    least = {}
    for x, (i, *_) in enumerate(known):
        least[root(x)] = min(i, least.get(root(x), i))
    for x, (i, *_) in enumerate(known):
        assert got[i] == {least[root(x)]}, i
    assert got[None] == {4000}
    assert dart_minhash.near_duplicates(df.limit(0)).count() == 0
