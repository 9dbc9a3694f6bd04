"""Caller's columns with the names that operators and stages use inside."""

import corpus_pipeline
from ranklab.llm import dart_minhash, sharding

SF = "/root/testdata/sf0.001"
NAMES = ["_row_doc", "_row_text", "_no_text", "_values", "_doc", "_key", "_slot", "_shard", "slot", "row", "columns", "kept", "hash", "doc", "key", "found", "own_text", "a.b"]


def test_stages_and_operators(spark):
    text = [" ".join(f"{w}{i}" for i in range(60)) for w in ("river", "candle", "garden")]
    data = [(i, t, "en", "s", len(t)) for i, t in enumerate([*text, text[0]])]
    plain = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    docs = spark.createDataFrame([(*r, *[f"{n}/{r[0]}" for n in NAMES]) for r in data],
                                 "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES))
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert all(r[n] == f"{n}/{r.doc_id}" for r in out.collect() for n in NAMES), name
        assert ids(out) == ids(stage(spark, plain, SF)), name
    assert ids(dart_minhash.one_of_each(docs)) == [0, 1, 2]
    want = {r.doc_id: (r.slot, r.shard) for r in sharding.place(plain, "doc_id", sharding.shard_names()).collect()}
    placed = sharding.place(docs, "doc_id", sharding.shard_names())
    assert placed.columns == [*docs.columns, "shard"]
    assert {r.doc_id: (r.slot, r.shard) for r in placed.collect()} == want and all(r["_slot"] == f"_slot/{r.doc_id}" for r in placed.collect())
