"""Registered queries of the operators: one for each, over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (alignment, dart_minhash, decontamination, huffman_ids, language_id, merkle_manifest, packing, ppm, quality_classifier,
               quality_rules, secret_scan, sharding, suffix_dedup)
from .common import crc_mod, documents

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


class Query(NamedTuple):
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None


def op1_shard_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document, 32 shards over 4,099 slots."""
    return sharding.place(documents(spark, sf_dir).select("doc_id"), "doc_id", sharding.shard_names())


def op2_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(documents(spark, sf_dir), crc_mod("doc_id", 3) == 1)


def op3_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per secret found: where it is, its digest, and the forest's probability."""
    found = secret_scan.scan(documents(spark, sf_dir)).where("is_secret")
    return found.select(F.col("doc").alias("doc_id"), F.col("position").cast("long").alias("position"),
                        F.length("value").cast("long").alias("length"), F.sha2("value", 256).alias("value_sha256"), "issued", "probability")


def op4_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")


def op5_bucket_pointer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir)).drop("spans")


def op6_dictionary_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(documents(spark, sf_dir), documents(spark, sf_dir, "labels"), crc_mod("doc_id", 5) == 0)


def op7_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_texts(documents(spark, sf_dir), crc_mod("doc_id", 5) == 1)


def op8_inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op9_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(documents(spark, sf_dir), TOKENIZER, added_tokens=True)


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(documents(spark, sf_dir))


def op11_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the files and reads them back."""
    folder = huffman_ids.write_ids(documents(spark, sf_dir), TOKENIZER, added_tokens=True)
    return huffman_ids.read_ids(spark, folder, digest=True)


def op12_dag_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all rows, half of which are claimed without their line ends."""
    tampered = F.when(crc_mod("doc_id", 2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return merkle_manifest.proofs(merkle_manifest.build(documents(spark, sf_dir), claims={"text": tampered}))


def op13_shared_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), BYTE_LEVEL, PIECES)


_HASH = "('0x' || substr(md5({}), 1, 15))::BIGINT"
#: The table is filled one claim a step, as the shards take turns.
OP1_ORACLE = f"""
WITH RECURSIVE shard AS (
  SELECT i, 'shard-' || lpad(i::VARCHAR, 3, '0') AS name FROM range({sharding.SHARDS}) r(i)),
prefer AS (
  SELECT i, {_HASH.format("'offset:' || name")} % {sharding.SLOTS} AS start, {_HASH.format("'skip:' || name")} % {sharding.SLOTS - 1} + 1 AS skip FROM shard),
fill(step, slots) AS (
  SELECT 0::BIGINT, list_transform(range({sharding.SLOTS}), lambda x: -1::BIGINT)
  UNION ALL
  SELECT step + 1, list_transform(range({sharding.SLOTS}), lambda x: CASE WHEN x = free THEN i ELSE slots[x + 1] END)
  FROM (SELECT step, slots, i,
          list_filter(list_transform(range({sharding.SLOTS}), lambda j: (start + j * skip) % {sharding.SLOTS}), lambda s: slots[s + 1] = -1)[1] AS free
        FROM fill JOIN prefer ON i = step % {sharding.SHARDS} WHERE step < {sharding.SLOTS})),
filled AS (SELECT slots FROM fill WHERE step = {sharding.SLOTS}),
hashed AS (SELECT doc_id, {_HASH.format("coalesce(doc_id::VARCHAR, '')")} % {sharding.SLOTS} AS slot FROM documents)
SELECT doc_id, slot, name AS shard FROM hashed, filled JOIN shard ON shard.i = slots[slot + 1]
"""

_WORDS = "list_filter(regexp_split_to_array({}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_N = decontamination.WINDOW
OP8_ORACLE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS.format(_FOLD.format("coalesce(text, '')"))} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format(_FOLD.format("coalesce(text, '')"))} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), {_N}) AS n, array_to_string(w[i : i + {_N} - 1], ' ') AS phrase
        FROM b, unnest(range(1, greatest(len(w) - {_N - 1}, 1) + 1)) u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS phrase FROM d, sizes, unnest(range(1, len(w) - n + 2)) u(i)),
hit AS (SELECT r, i, n, item_id FROM grams JOIN win USING (n, phrase)),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) u(p) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)
"""



def _op12_oracle(leaf_levels: int = 14, top_levels: int = 6) -> str:
    """A step for each level: nodes, the other nodes of each node's run, the leaf's path so far. A
    source of more than 3 ** 14 rows, or more than 3 ** 6 sources, would need more steps."""
    text = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR END"
    row = [text.format(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = "sha256(" + " || ".join([*row, text.format("text")]) + ")"
    altered = "CASE WHEN odd THEN text ELSE replace(text, chr(10), '') END"
    claim = "sha256(" + " || ".join([*row, text.format(f"({altered})")]) + ")"
    table = [_crc_of_byte(b) for b in range(256)]
    crc = (f"list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), "
           f"lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1]))")
    steps = [f"""d0 AS (SELECT *, coalesce({crc} & 1, 0) = 0 AS odd FROM documents)""",
             f"""d AS (SELECT doc_id, source, {leaf} AS leaf, {claim} AS claim FROM d0)""",
             """s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM documents))""",
             """p0 AS (SELECT doc_id, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf, claim AS acc, '' AS proof
  FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source)""",
             """n0 AS (SELECT tree, i, leaf AS h FROM p0)"""]

    def level(k: int, nodes: str, path: str) -> list[str]:
        """Level ``k`` over ``nodes`` (tree, i, h): its nodes, each lower node's siblings, and the paths."""
        return [f"""c{k} AS (SELECT tree, count(*) AS n FROM {nodes} GROUP BY tree)""",
                f"""n{k} AS (SELECT x.tree, CASE WHEN n > 1 THEN i // 3 ELSE i END AS i,
    CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY x.i)) ELSE any_value(h) END AS h
  FROM {nodes} x JOIN c{k} USING (tree) GROUP BY x.tree, CASE WHEN n > 1 THEN i // 3 ELSE i END)""",
                f"""s{k} AS (SELECT a.tree, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS r
  FROM {nodes} a JOIN {nodes} b ON a.tree = b.tree AND a.i // 3 = b.i // 3 GROUP BY a.tree, a.i)""",
                f"""p{k} AS (SELECT doc_id, p.tree, CASE WHEN n > 1 THEN p.i // 3 ELSE p.i END AS i, leaf,
    CASE WHEN n > 1 THEN sha256(l || acc || r) ELSE acc END AS acc, CASE WHEN n > 1 THEN proof || l || r ELSE proof END AS proof
    {", source_tree" if k > leaf_levels else ""}
  FROM {path} p JOIN c{k} USING (tree) JOIN s{k} x ON x.tree = p.tree AND x.i = p.i)"""]

    for k in range(1, leaf_levels + 1):
        steps += level(k, f"n{k - 1}", f"p{k - 1}")
    steps += [f"""tn AS (SELECT 0 AS tree, tree AS i, h FROM n{leaf_levels})""",
              f"""tp AS (SELECT doc_id, 0 AS tree, tree AS i, leaf, acc, proof, tree AS source_tree FROM p{leaf_levels})"""]
    last_nodes, last_path = "tn", "tp"
    for k in range(leaf_levels + 1, leaf_levels + top_levels + 1):
        steps += level(k, last_nodes, last_path)
        last_nodes, last_path = f"n{k}", f"p{k}"
    return "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, leaf, b.h AS subroot, t.h AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = t.h AS verified
FROM {last_path} p JOIN n{leaf_levels} b ON b.tree = p.source_tree CROSS JOIN {last_nodes} t
"""


def _crc_of_byte(b: int) -> int:
    for _ in range(8):
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return b


REGISTRY: dict[str, Query] = {
    "op1_shard_lookup": Query(op1_shard_lookup, OP1_ORACLE),
    "op2_language_centroids": Query(op2_language_centroids),
    "op3_secret_forest": Query(op3_secret_forest),
    "op4_robust_outliers": Query(op4_robust_outliers),
    "op5_bucket_pointer_dedup": Query(op5_bucket_pointer_dedup),
    "op6_dictionary_compression": Query(op6_dictionary_compression),
    "op7_partial_matching": Query(op7_partial_matching),
    "op8_inverted_index": Query(op8_inverted_index, OP8_ORACLE),
    "op9_certified_packing": Query(op9_certified_packing),
    "op10_dart_minhash": Query(op10_dart_minhash),
    "op11_huffman_ids": Query(op11_huffman_ids),
    "op12_dag_manifest": Query(op12_dag_manifest, _op12_oracle()),
    "op13_shared_cuts": Query(op13_shared_cuts),
}
