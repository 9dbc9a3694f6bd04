"""The registered packing gives the ids of the unmodified tokenizer."""

import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from ranklab.llm import catalog

TEXTS = ["a text <|endoftext|> goes on", "x<|startoftext|>y, it's <|ENDOFTEXT|> here", "<|endoftext|>", "plain words, only."]


def test_ids_of_the_plain_tokenizer(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    coder = Tokenizer.from_file(catalog.TOKENIZER)
    want = set()
    for i, t in enumerate(TEXTS):
        ids = np.array(coder.encode(t, add_special_tokens=False).ids + [0], "<u4")
        want.add((i, len(ids), zlib.crc32(ids.tobytes())))
    assert 49407 in coder.encode(TEXTS[0], add_special_tokens=False).ids
    for got in (catalog.op9_certified_packing(spark, str(tmp_path)), dict(corpus_pipeline.STAGES)["best_fit_packing"](spark, docs, "")):
        assert {(r.doc_id, r.length, r.ids_crc32) for r in got.collect()} == want
