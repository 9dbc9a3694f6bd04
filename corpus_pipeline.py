"""A training corpus from ``documents``: quality rules, near-duplicate removal,
benchmark decontamination, secret redaction, packing.

Each stage gets the documents that its predecessor left (as written and read
again) and returns what goes on; the last returns the packed pieces. Rows are
told apart by id and text, so null ids and repeated rows are handled: near-dedup
leaves one of equal rows, the other stages treat each alike. Null and empty texts
fail the quality rules; very long texts are read whole; of tied near copies the
smallest id stays; an empty table gives an empty result; further columns go
through the first four stages whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklab.llm import dart_minhash, decontamination, packing, quality_rules, secret_scan
from ranklab.llm.catalog import TOKENIZER
from ranklab.llm.common import documents, stored

_ROW = ["_row_doc", "_row_text"]


def _row(doc_id: Column, text: Column) -> list[Column]:
    """The id (0 for null) and a fingerprint that equal rows share."""
    doc = doc_id.cast("long")
    return [F.coalesce(doc, F.lit(0)).alias(_ROW[0]), F.xxhash64(doc.isNull(), F.coalesce(text, F.lit(""))).alias(_ROW[1])]


def _chosen(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """``docs`` whose row is in ``rows`` (``left_semi``) or is not (``left_anti``).
    The columns of documents travel as one struct, so they may have any names."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_row(F.col("doc_id"), F.col("text")))
    return own.join(rows, _ROW, how).select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the outlier verdict keep."""
    marked = docs.select("doc_id", "text", "lang", "source", *_row(F.col("doc_id"), F.col("text")))
    return _chosen(docs, quality_rules.apply_rules(marked, keep=tuple(_ROW)).where("kept").select(*_ROW).distinct(), "left_semi")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: the smallest id's (null last), and of its texts the smallest hash's."""
    return dart_minhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    hit = decontamination.contamination(docs, documents(spark, sf_dir, "benchmark")).where("contaminated")
    return _chosen(docs, hit.select(F.col("doc").alias(_ROW[0]), F.col("key").alias(_ROW[1])).distinct(), "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced; ``n_chars`` follows the text."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,048 tokens and their places in sequences."""
    return packing.best_fit_packing(docs, TOKENIZER, added_tokens=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("secret_scans", secrets),
    ("best_fit_packing", pack),
]
#: Outlier estimates, classes of near copies, the forest and the packing are not SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
