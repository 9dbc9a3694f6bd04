"""What op5 shuffles: no more per suffix with more partitions, only windows that
another document may have, and nothing kept that was read."""

from __future__ import annotations

import os
import re
import time

import numpy as np
import pyarrow as pa
import pytest
import test_operators

from ranklab.llm import suffix_dedup
from ranklab.llm.common import stored


def _texts(n=400, size=3000):
    rng = np.random.default_rng(5)
    return ["".join(map(chr, rng.integers(97, 123, size))) for _ in range(n)]


def _batch(texts):
    keys = np.random.default_rng(6).integers(-(1 << 62), 1 << 62, len(texts))
    return pa.RecordBatch.from_pydict({"doc": pa.array(range(10 ** 6, 10 ** 6 + len(texts)), pa.int64()),
                                       "key": pa.array(keys * 0, pa.int64()), "text": texts})


def _blobs(texts, parts):
    return list(suffix_dedup._scan(50, 18, parts)(iter([_batch(texts)])))


def test_bytes_of_a_suffix_do_not_grow_with_the_partitions():
    texts = _texts()
    size = {n: sum(len(x) for b in _blobs(texts, n) for x in b.column("blob").to_pylist()) for n in (4, 512)}
    assert size[512] < 1.25 * size[4]
    assert size[512] / sum(map(len, texts)) < 1.3  # 17 bytes of text hold one suffix


def test_a_common_phrase_alone_asks_nothing():
    common = "twenty common bytes "
    texts = [t[:100] + common + t[100:] for t in _texts(60, 200)]
    passage = _texts(1, 80)[0]
    both = [t[:60] + passage + t[60:] for t in _texts(8, 150)]
    marks = [b for b in suffix_dedup._split(50, 18)(iter(_blobs(texts, 1)))]
    assert not any(x for b in marks for x in b.column("asks").to_pylist())
    marks = [b for b in suffix_dedup._split(50, 18)(iter(_blobs(both, 1)))]
    assert any(x for b in marks for x in b.column("asks").to_pylist())


def test_ids_and_places_come_back():
    docs, keys = np.array([-5, 3, 3, 1 << 62], np.int64), np.array([0, 7, -7, 0], np.int64)
    assert [x.tolist() for x in suffix_dedup._from_ids(*suffix_dedup._ids(docs, keys))] == [docs.tolist(), keys.tolist()]
    local, first = np.array([0, 0, 1, 2, 2, 2]), np.array([4, 9, 70_000, 0, 1, 300])
    assert [x.tolist() for x in suffix_dedup._from_places(*suffix_dedup._places(local, first))] == [local.tolist(), first.tolist()]


@pytest.mark.parametrize("several", [0, 100_000])
@pytest.mark.parametrize("large", [0, 1000])
def test_repeated_ids_and_dealing_by_halves(spark, monkeypatch, several, large):
    monkeypatch.setattr(suffix_dedup, "REPEATED_IDS", several)
    monkeypatch.setattr(suffix_dedup, "LARGE_BUCKET", large)
    test_operators.test_repeats(spark, [])




def test_the_texts_are_shuffled_by_both_keys_only(spark):
    df = spark.createDataFrame([(i, f"text {i} " * 20) for i in range(20)], "doc_id long, text string")
    plan = suffix_dedup.remove_repeats(df)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(doc#\w+, key#\w+, \d+\), REPARTITION_BY_NUM", plan)
    assert not re.search(r"hashpartitioning\((doc|key)#\w+, \d+\)", plan)


def test_a_released_write_keeps_no_shuffle(spark, tmp_path):
    def files():
        roots = [x for x in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
        return sum(f.startswith("shuffle_") for r in roots for _, _, names in os.walk(r) for f in names)

    before = files()
    out = stored(spark.range(1000).repartition(7, "id"), release=True)
    deadline = time.time() + 20
    while files() > before and time.time() < deadline:
        time.sleep(0.2)
    assert files() <= before and out.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
