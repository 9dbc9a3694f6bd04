"""Parts stay of bounded size whatever the ids."""

from collections import Counter

from pyspark.sql import functions as F

from ranklab.llm import packing


def test_one_key_is_dealt_over_parts(spark):
    pieces = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), (300 + F.col("id")).alias("length"))
    out = packing.pack_pieces(pieces, 1000, part_pieces=20, rounds=1)
    assert out.columns == ["doc_id", "piece", "length", "sequence_id", "offset", "gap"]
    rows = out.collect()
    parts, fill = Counter(r.sequence_id >> 24 for r in rows), Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert len(rows) == 400 and len(parts) == 20 and max(parts.values()) < 60 and max(fill.values()) <= 1000
