"""Language identification by nearest centroid.

Texts become normalised TF-IDF vectors of letter n-grams (1 to 3 letters of the
lower-cased text, runs of other characters count as one blank) over ``buckets``
hashed dimensions. Each language has several centroids, clustered by spherical
k-means. A text gets the language of the centroid with the largest cosine; it is
rejected when its distance is beyond the one that the language's own training
texts reach.

Document frequencies cover all training texts. The centroids are fitted on at
most about ``sample`` training texts per language, chosen by a hash of the id
(``SAMPLE``, the documented bound of the fit), and the rejection distances on the
same ones.

Defined cases: null text and text without a letter are ``und`` with score 0; a
training row without language is not learned from; without training rows every
text is ``und``; ids may be null or repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_anchors import BASE, MIX, mix
from .common import record_batch, ship, stored

BUCKETS = 4096
CENTROIDS = 4
SAMPLE = 600
REJECT_QUANTILE = 0.999
UNDETERMINED = "und"
_U = np.uint64


@functools.cache
def _letters() -> np.ndarray:
    """The lower-case form's code point of each letter, 0 for other code points."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        if chr(c).isalpha():
            table[c] = c
    return table


def term_counts(text: str, buckets: int) -> np.ndarray | None:
    """Counts by hashed n-gram; None without a letter."""
    code = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = code > 0
    if not keep.any():
        return None
    keep[1:] |= code[:-1] > 0  # one blank behind each run of letters
    code = np.concatenate((np.zeros(1, np.uint64), code[keep].astype(np.uint64), np.zeros(1, np.uint64)))
    counts = np.zeros(buckets)
    gram = np.zeros(len(code), np.uint64)
    for n in (1, 2, 3):
        gram = gram[: len(code) - n + 1] * BASE + code[n - 1:] + _U(1)
        salt = _U(n * int(MIX) % 2 ** 64)
        counts += np.bincount((mix(gram + salt) % _U(buckets)).astype(np.int64), minlength=buckets)
    return counts


def vectors(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised TF-IDF vectors, and which texts have a letter."""
    out, known = np.zeros((len(texts), len(idf)), np.float32), np.zeros(len(texts), bool)
    for i, t in enumerate(texts):
        counts = term_counts(t, len(idf)) if t else None
        if counts is not None:
            v = np.log1p(counts) * idf
            out[i], known[i] = v / max(np.linalg.norm(v), 1e-12), True
    return out, known


def _frequencies(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(buckets, np.int64), 0
        for batch in batches:
            for t in batch.column("text").to_pylist():
                counts = term_counts(t, buckets) if t else None
                if counts is not None:
                    seen += counts > 0
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(buckets), -1), pa.int32()), pa.array(np.append(seen, n), pa.int64())], ["term", "n"])
    return run


def _cluster(idf: np.ndarray, centroids: int, quantile: float):
    def run(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        """Spherical k-means of one language's sample, started from far-apart texts."""
        x, known = vectors(table.sort_values("order")["text"].tolist(), idf)
        x = x[known]
        if not len(x):
            return pd.DataFrame({"lang": [], "centroid": [], "reach": []})
        start = [x.mean(0) / np.linalg.norm(x.mean(0))]
        while len(start) < min(centroids, len(x)):
            start.append(x[np.argmin(np.max(x @ np.array(start).T, axis=1))])
        c = np.array(start)
        for _ in range(10):
            nearest = np.argmax(x @ c.T, axis=1)
            for j in range(len(c)):
                if (nearest == j).any():
                    m = x[nearest == j].mean(0)
                    c[j] = m / np.linalg.norm(m)
        reach = float(np.quantile(1 - np.max(x @ c.T, axis=1), quantile))
        return pd.DataFrame({"lang": key[0], "centroid": [v.astype(float).tolist() for v in c], "reach": reach})
    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()),
                  ("distance", pa.float64()), ("rejected", pa.bool_())])


def _predict(names: list[str], centroids: np.ndarray, reach: np.ndarray, idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                x, known = vectors(part.column("text").to_pylist(), idf)
                n = len(known)
                best, score = np.zeros(n, np.int64), np.zeros(n)
                if len(names):
                    near = x @ centroids.T
                    best, score = np.argmax(near, axis=1), np.clip(np.max(near, axis=1), 0, 1).astype(float)
                known &= len(names) > 0
                label = [names[b] if k else UNDETERMINED for b, k in zip(best, known)]
                score = np.where(known, score, 0.0)
                far = ~known | ((1 - score) > (reach[best] if len(names) else 0))
                yield record_batch(_OUT, part.column("doc_id"), part.column("held_out"), label, score, 1 - score, far)
    return run


def identify_languages(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                       buckets: int = BUCKETS, centroids: int = CENTROIDS, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score (cosine), distance, rejected of every
    row, learned from the rows with ``held_out`` false and a language. The
    language always names the nearest centroid's; ``rejected`` says that even
    this one is too far."""
    spark = docs.sparkSession
    ship(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(True)).alias("held_out"),
                       F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    train = base.where("not held_out and lang is not null")
    counted = train.select("text").mapInArrow(_frequencies(buckets), "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    seen = dict(map(tuple, counted.collect()))  # buckets + 1 rows
    total = seen.get(-1, 0)
    idf = np.array([np.log((1 + total) / (1 + seen.get(i, 0))) + 1 for i in range(buckets)])
    share = train.groupBy("lang").agg((F.lit(sample) / F.count("*")).alias("share"))
    order = F.xxhash64("doc_id")
    chosen = (train.join(F.broadcast(share), "lang").withColumn("order", order)  # a row per language
              .where(F.pmod("order", F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("lang", "order", "text"))
    fitted = stored(chosen.groupBy("lang").applyInPandas(_cluster(idf, centroids, REJECT_QUANTILE), "lang string, centroid array<double>, reach double"))
    model = sorted(fitted.collect(), key=lambda r: (r.lang, r.centroid))
    names = [r.lang for r in model]
    points = np.array([r.centroid for r in model], np.float32).reshape(len(model), buckets)
    reach = np.array([r.reach for r in model])
    return base.select("doc_id", "held_out", "text").mapInArrow(
        _predict(names, points, reach, idf),
        "doc_id long, held_out boolean, lang_pred string, score double, distance double, rejected boolean")
