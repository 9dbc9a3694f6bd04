"""Texts of one bucket are told apart without losing a pair at the similarity."""

import itertools
import random

import numpy as np
import pytest

from ranklab.llm import dart_minhash as dm


def grams(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    x, y = grams(a), grams(b)
    return 5 * len(x & y) >= 4 * len(x | y) and bool(x | y)


def found(spark, texts, classes=None):
    rows = [(i, classes[i] if classes else i, t) for i, t in enumerate(texts)]
    return {(r.a, r.b) for r in dm.rare_pairs(spark.createDataFrame(rows, "text_id long, class long, text string")).collect()}


def sharing(common, own, marks):
    """Texts of ``common`` words that all share and ``own`` words of their own."""
    head = " ".join(f"c{i}" for i in range(common))
    return [head + " " + " ".join(f"{m}x{i}" for i in range(own)) for m in marks]


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        at = rng.randrange(len(out))
        out[at:at + rng.randint(0, 1)] = [f"e{rng.randrange(10 ** 6)}"] * rng.randint(0, 2)
    return " ".join(out)


def test_pairs_at_the_similarity_stay_and_distant_ones_go(spark):
    near = sharing(184, 20, "abcdefgh")  # 180 shared shingles of 200 in each text: 180 / 220 = 0.818
    assert found(spark, near) == set(itertools.combinations(range(8), 2))
    for common in (104, 154, 174):  # 0.33, 0.6 and 0.74 similar: one long shared passage
        assert found(spark, sharing(common, 204 - common, [f"m{i}" for i in range(40)])) == set()


@pytest.mark.parametrize("seed", range(4))
def test_no_link_between_classes_is_lost(spark, seed):
    rng = random.Random(seed)
    texts = ["", "one two", "one two", "a b c d e"]
    for g in range(6):
        base = [f"g{g}w{rng.randrange(60)}" for _ in range(rng.choice([6, 30, 120]))] + [f"p{i}" for i in range(20)]
        texts += [edited(rng, base, rng.choice([0, 1, 2, 3, 6, 12])) for _ in range(12)]
    classes = [rng.randrange(30) if rng.random() < 0.5 else 1000 + i for i in range(len(texts))]
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if classes[i] != classes[j] and similar(texts[i], texts[j])}
    got = found(spark, texts, classes)
    assert want and want <= got and all(classes[i] != classes[j] for i, j in got)


def test_counted_shingles(spark):
    texts = ["x " * 30, "x " * 32, "x " * 60, "y " * 5]
    rows = spark.createDataFrame(list(enumerate(texts)), "text_id long, text string").selectExpr("text_id", "text_id as class", "text")
    assert {(r.a, r.b) for r in dm.rare_pairs(rows, counted=True).collect()} == {(0, 1)}  # 26 and 28 times one shingle
    assert {(r.a, r.b) for r in dm.rare_pairs(rows).collect()} == {(0, 1), (0, 2), (1, 2)}


def test_a_large_class_does_not_meet_itself(spark):
    texts = sharing(184, 8, [f"m{i}" for i in range(30)])
    assert found(spark, texts, [7] * 30) == set()
    assert found(spark, texts, [7] * 29 + [8]) == {(i, 29) for i in range(29)}


def test_shared_passage_stays_many_classes(spark):
    """Texts of a shared passage that are not similar enough stay apart; a near copy among them is found."""
    texts = sharing(60, 40, [f"m{i}" for i in range(60)])
    twin = texts[30].rsplit(" ", 1)[0] + " other"
    df = spark.createDataFrame(list(enumerate([*texts, twin])), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in dm.near_duplicates(df).collect()}
    assert got[60] == got[30] == 30
    assert len(set(got.values())) == 60


def test_maps_never_differ_in_more_cells_than_shingles():
    rng = np.random.default_rng(5)
    for n in (0, 1, 50, 3000):
        sets = [np.unique(dm.mix(rng.integers(0, 4000, n).astype(np.uint64) + np.uint64(1))) for _ in range(6)]
        text = np.repeat(np.arange(6), [len(x) for x in sets])
        maps = dm.parity_maps(text, np.concatenate(sets), 6)
        for i, j in itertools.combinations(range(6), 2):
            cells = sum(int(x).bit_count() for x in (maps[i] ^ maps[j]).view(np.uint64))
            apart = len(np.setxor1d(sets[i], sets[j]))
            assert cells <= apart and (cells >= 0.8 * apart or apart > 200)


def test_empty(spark):
    assert found(spark, [""]) == set()
    assert dm.rare_pairs(spark.createDataFrame([], "text_id long, class long, text string")).count() == 0
