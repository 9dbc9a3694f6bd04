"""Rows of rare languages and sources are judged; outliers of single statistics."""

import numpy as np

from ranklab.llm import quality_rules as qr

LIMIT = qr.chi2_quantile(len(qr.SPREADS), qr.CUT)


def prose(rng, n=None):
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    words = ["".join(rng.choice(letters, rng.integers(3, 8))) for _ in range(n or rng.integers(80, 160))]
    return "\n".join(" ".join(words[i:i + 10]) for i in range(0, len(words), 10))


def judged(spark, data):
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    return {r.doc_id: r for r in qr.apply_rules(df).collect()}


def test_every_row_is_judged(spark):
    rng = np.random.default_rng(0)
    bad = " ".join("#$%" + w.upper() for w in prose(rng, 100).split())
    data = [(i, prose(rng), "en", "large") for i in range(150)]
    data += [(200 + i, prose(rng), "en", "rare") for i in range(5)] + [(300, bad, "en", "rare")]
    data += [(400 + i, prose(rng), "xx", None) for i in range(3)] + [(500, bad, "xx", None), (501, bad, None, "large")]
    got = judged(spark, data)
    assert not any(r.base_failed or r.distance is None for r in got.values())
    assert {i for i, r in got.items() if not r.kept} == {300, 500, 501}
    # the rare source is judged by all rows of its language: it stands at the distance the large source has
    assert np.median([got[200 + i].distance for i in range(5)]) < 3 * np.median([got[i].distance for i in range(150)])
    few = judged(spark, data[:3])
    assert all(r.distance is not None and r.kept for r in few.values())


def test_planted_single_outliers(spark):
    """At CUT, each of five statistics rejects alone; the other two cannot by their least spread."""
    rng = np.random.default_rng(1)
    data = [(i, prose(rng), "en", "s") for i in range(200)]
    one = prose(rng, 120).split()
    planted = {
        900: prose(rng, 15_000),
        901: " ".join(a + b + c for a, b, c in zip(one, one[1:], one[2:])),
        902: " ".join(w + "#" for w in one),
        903: " ".join(one[int(i)] for i in rng.integers(0, 8, 120)),
        904: " ".join(one).upper(),
    }
    got = judged(spark, data + [(i, t, "en", "s") for i, t in planted.items()])
    assert not any(got[i].base_failed for i in planted)
    assert {i for i, r in got.items() if not r.kept} == set(planted)
    # the farthest values of the shares: all lines repeated, and the base rule's limit of repeated words
    assert (1 / qr.SPREADS["dup_lines"]) ** 2 < LIMIT and qr.MOST_REPEAT_PERCENT / 100 / qr.SPREADS["repeats"] ** 2 < LIMIT
