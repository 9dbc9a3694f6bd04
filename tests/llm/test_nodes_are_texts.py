"""Near-dedup tells texts apart by their hash, not by their id."""

from collections import Counter

import corpus_pipeline
from ranklab.llm import dart_minhash


def text(mark, last="end"):
    return " ".join(f"{mark}{i}" for i in range(120)) + " " + last


def test_repeated_and_null_ids(spark):
    data = [(5, text("a")), (5, text("b")), (5, text("b")), (6, text("a", "fin")), (7, text("b", "fin")),
            (None, text("c")), (None, text("c", "fin")), (None, text("c")), (None, text("a", "stop")), (None, text("d"))]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.class_id) for r in dart_minhash.near_duplicates(docs).collect())
    assert got == Counter({(5, 5): 3, (6, 5): 1, (7, 5): 1, (None, None): 4, (None, 5): 1})
    left = dict(corpus_pipeline.STAGES)["minhash_near_dedup"](spark, docs, "")
    assert left.columns == docs.columns
    rows = Counter((r.doc_id, r.text) for r in left.collect())
    nameless = {t for i, t in rows if i is None}
    assert sum(rows.values()) == 4 and rows[5, text("a")] == rows[5, text("b")] == 1
    assert text("d") in nameless and len(nameless & {text("c"), text("c", "fin")}) == 1
