"""Benchmark items without an id are searched like any other."""

import duckdb
from pyspark.sql import functions as F

from ranklab.llm import decontamination
from ranklab.llm.catalog import OP8_ORACLE


def test_null_items(spark, tmp_path):
    passage, other = (" ".join(f"{c}{i}" for i in range(12)) for c in "pq")
    items = [(None, passage), (None, other), (7, other)]
    data = [(1, f"before {passage} after"), (2, f"{other}, {passage}"), (3, "nothing of them"), (None, other)]
    docs, bench = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(docs, bench)
    rows = {r.doc_id: (r.n_hit, r.n_items, r.items, r.contaminated) for r in got.collect()}
    assert rows == {1: (12, 1, [], True), 2: (24, 2, ["7"], True), 3: (0, 0, [], False), None: (12, 2, ["7"], True)}
    con = duckdb.connect()
    for name, df in (("documents", docs), ("benchmark", bench)):
        df.coalesce(1).write.parquet(str(tmp_path / name))
        con.execute(f"create view {name} as select * from read_parquet('{tmp_path / name}/*.parquet')")
    like = got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")
    key = lambda t: (t[0] is None, t)
    assert sorted((tuple(r) for r in like.collect()), key=key) == sorted(con.execute(OP8_ORACLE).fetchall(), key=key)
