"""Pairs of non-leading members are compared also when the leaders bring no new pair."""

import numpy as np

from ranklab.llm import dart_minhash as dm


def keys(texts):
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(t) for t in raw])
    text, gram, count = dm.shingles(np.frombuffer(b"".join(raw), np.uint8), ends - [len(t) for t in raw], ends, 5)
    return dm.band_keys(dm.dart_signatures(text, gram, np.ones(len(gram)), len(raw), 2), 2, 1)


def test_members_without_a_new_leader_pair(spark):
    # nested texts of 100, 118, 140 and 165 shingles: neighbours are similar, others are not
    for salt in range(2000):
        words = [f"s{salt}w{i}" for i in range(169)]
        a1, b1, b2, a2 = texts = [" ".join(words[:n + 4]) for n in (165, 100, 118, 140)]
        first, second = keys(texts).T
        # one bucket of all four, led by a1, and one in which b1 and b2 are alone
        if len(set(first)) == 1 and second[1] == second[2] and second[1] not in (second[0], second[3]):
            break
    else:
        raise AssertionError("no such texts")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.class_id for r in dm.near_duplicates(df, bands=2, rows=1).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0}
