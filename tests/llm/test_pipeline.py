"""The pipeline against its parts and brute force."""

from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from ranklab.llm import dart_minhash, decontamination, quality_rules
from ranklab.llm.common import documents

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_near_dedup", "benchmark_decontamination", "secret_scans", "best_fit_packing"]
    docs = documents(spark, SF)
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality_rules"](spark, docs, SF)
    assert kept.columns == docs.columns
    assert ids(kept) == ids(quality_rules.apply_rules(docs).where("kept"))
    one = stage["minhash_near_dedup"](spark, kept, SF)
    assert ids(one) == ids(dart_minhash.near_duplicates(kept).where("doc_id = class_id"))
    clean = stage["benchmark_decontamination"](spark, one, SF)
    assert ids(clean) == ids(decontamination.contamination(one, documents(spark, SF, "benchmark")).where("not contaminated"))
    safe = stage["secret_scans"](spark, clean, SF)
    assert safe.columns == docs.columns and ids(safe) == ids(clean)
    assert all(r.n_chars == len(r.text) for r in safe.collect())
    packed = stage["best_fit_packing"](spark, safe, SF).collect()
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {r.doc_id: len(coder.encode(r.text, add_special_tokens=False).ids) + 1 for r in safe.collect()}
    got = Counter()
    for r in packed:
        got[r.doc_id] += r.length
    assert got == sizes
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed) == Counter(
        (r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect())


def test_nulls_and_repeats(spark):
    words = " ".join(f"word{i}" for i in range(60))
    data = [(1, words, "en", "s", 5), (1, words, "en", "s", 5), (None, words, None, None, None), (None, words + " more and more", None, "s", 1),
            (None, "quite different " + " ".join(f"other{i}" for i in range(40)), "en", "s", 1), (2, None, "en", "s", 0), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality_rules"](spark, docs, SF)
    assert kept.count() == 5
    one = stage["minhash_near_dedup"](spark, kept, SF)
    assert Counter(r.doc_id for r in one.collect())[1] == 1 and all(r.text != words for r in one.collect() if r.doc_id is None)
    assert stage["benchmark_decontamination"](spark, one, SF).count() == one.count()
    none = docs.limit(0)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, none, SF).count() == 0, name


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {f"op{n}_" for n in range(1, 14)} == {f"{x.split('_')[0]}_" for x in names if x.startswith("op")}
    assert {"op1_shard_lookup", "op8_inverted_index"} <= set(__spark_entry__.oracle_sql())
