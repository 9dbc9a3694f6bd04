"""The letter tables count the words of all texts."""

from pyspark.sql import functions as F

from ranklab.llm import secret_scan


def test_rare_words_of_many_texts(spark):
    letters = [chr(97 + i) for i in range(26)]
    rare = [a + b + a + b for a in letters[:20] for b in letters[20:]]
    data = [(i, i, "common words in every text") for i in range(9000)]
    data += [(10_000 + 2 * i + j, 10_000 + 2 * i + j, f"common {w}") for i, w in enumerate(rare) for j in (0, 1)]
    moves, pieces = secret_scan.language_tables(spark.createDataFrame(data, "doc long, key long, text string"))
    assert {r.piece for r in pieces.collect()} >= set(rare)
    assert {r.pair for r in moves.select(F.col("pair")).collect()} >= {w[:2] for w in rare}
