import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ranklab.llm.ppm import score_texts


def brute(train, text):
    """log10 probability by the definition: dictionaries of contexts, one symbol at a time."""
    counts = [defaultdict(Counter) for _ in range(5)]
    for t in train:
        laid = b"\0" * 4 + t.encode().lower() + b"\0"
        for i in range(4, len(laid)):
            for k in range(5):
                counts[k][laid[i - k:i]][laid[i]] += 1
    laid, total = b"\0" * 4 + text.encode().lower() + b"\0", 0.0
    for i in range(4, len(laid)):
        excluded, done = set(), False
        for k in (4, 3, 2, 1, 0):
            seen = {s: n for s, n in counts[k][laid[i - k:i]].items() if s not in excluded}
            n, d = sum(seen.values()), len(seen)
            if laid[i] in seen:
                total += math.log10(seen[laid[i]] / (n + d))
                done = True
                break
            if n:
                total += math.log10(d / (n + d))
            excluded |= set(counts[k][laid[i - k:i]])
        if not done:
            total -= math.log10(256 - len(excluded))
    return total


def test_equals_definition(spark):
    texts = ["The cat sat on the mat", "the cat ate", None, "", "Zebra é quiet", "cat cat cat cat", "the mat\nsat", "the mat\nsat",
             "\t ", "unseen €uro words"]
    rows = [(i, t, i % 3 == 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean").withColumn("score", F.lit("clash")).repartition(3)
    got = {r.doc_id: r for r in score_texts(df, F.col("held")).collect()}
    train = [t or "" for _, t, h in rows if not h]
    words = Counter(w for t in train for w in [*t.encode().lower().split(), None])
    n, v = sum(words.values()), len(words)
    for i, t, h in rows:
        tokens = [*(t or "").encode().lower().split(), None]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (h, len(tokens), n)
        assert r.n_known == sum(words[w] > 0 for w in tokens)
        assert r.base_score == pytest.approx(sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens))
        assert r.score == pytest.approx(brute(train, t or "")), i


def test_no_training_and_empty_table(spark):
    df = spark.createDataFrame([(1, "ab", True), (None, None, True)], "doc_id long, text string, held boolean")
    got = {r.doc_id: r for r in score_texts(df, F.col("held")).collect()}
    assert got[1].score == pytest.approx(-3 * math.log10(256)) and got[None].score == pytest.approx(-math.log10(256))
    assert got[1].n_known == 0 and got[1].train_tokens == 0
    assert score_texts(df.limit(0), F.col("held")).count() == 0
