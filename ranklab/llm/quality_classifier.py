"""Quality score by compression: how much better a text compresses with a
dictionary of good text than with one of bad text.

Two zstandard dictionaries are built from labelled texts. A text is cut into
chunks of ``CHUNK`` bytes (all of it), each is compressed with either dictionary
and with none; ``(bad - good) / (bad + good)`` of the summed sizes is the
normalised difference. Its calibration is a logistic curve of the difference
together with the text's own compression ratio and length, which tell how much
the difference can say.

The dictionaries and the curve are fitted on a bounded sample: at most about
``sample`` labelled texts per label, chosen by a hash of the id (``SAMPLE``); a
third of it (another hash) calibrates, the rest builds the dictionaries.

Defined cases: null text is empty; empty texts get the curve's value at zero
difference; with only one label seen every text scores that label's share; ids
may be null or repeat; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_column, record_batch, ship

SAMPLE = 1500
CHUNK = 4096
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
#: Scores from here on are predicted as label 1.
THRESHOLD = 0.3


def build_dictionary(texts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """Raw zstandard dictionary: the trained entries where training succeeds
    (it needs many varied samples), else the samples themselves."""
    import zstandard
    pieces = [t[i:i + CHUNK] for t in texts for i in range(0, len(t), CHUNK)]
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:]


class Sizes:
    """Compressed sizes of texts with the good dictionary, the bad one and none."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard
        plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.coders = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False,
                                                write_dict_id=False) if d else plain for d in (good, bad, b"")]

    def __call__(self, text: bytes) -> tuple[int, int, int]:
        return tuple(sum(len(c.compress(text[i:i + CHUNK])) for i in range(0, len(text), CHUNK)) for c in self.coders)


def features(sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Columns for the curve, from (good, bad, none) sizes and byte lengths."""
    good, bad, none = np.asarray(sizes, float).reshape(-1, 3).T
    n = np.maximum(np.asarray(lengths, float), 1)
    difference = (bad - good) / np.maximum(bad + good, 1)
    ratio, size = np.log((none + 16) / (n + 16)), np.log(n)
    saved = (bad - good) / n
    return np.stack((np.ones(len(n)), difference, saved, ratio, ratio ** 2, size, difference * ratio, difference * size, ratio * size), 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, mean, scale) of a ridge-penalised logistic regression, by Newton steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    mean[0], scale[0] = 0, 1
    z, w = (x - mean) / scale, np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale


def curve(x: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    w, mean, scale = model
    return 1 / (1 + np.exp(-np.clip(((x - mean) / scale) @ w, -30, 30)))


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()),
                  ("difference", pa.float64())])


def _predict(good: bytes, bad: bytes, model, share: float, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Sizes(good, bad)
        for batch in batches:
            buf, starts, ends = byte_column(batch.column("text"))
            sizes = np.array([measure(buf[s:e].tobytes()) for s, e in zip(starts, ends)]).reshape(-1, 3)
            x = features(sizes, ends - starts)
            score = curve(x, model) if model else np.full(len(x), share)
            yield record_batch(_OUT, batch.column("doc_id"), batch.column("held_out"), score, (score >= threshold).astype(np.int32), x[:, 1])
    return run


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, difference of every row; labels count
    only where ``held_out`` is false."""
    ship(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(True)).alias("held_out"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    train = base.where("not held_out").select("doc_id").join(known, "doc_id").groupBy("doc_id", "label").count()
    counts = {r.label: r.n for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    good = bad = b""
    model = None
    if len(counts) == 2:
        lot = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 30)) / float(1 << 30)
        within = F.when(F.col("label") == 1, lot < sample / counts[1]).otherwise(lot < sample / counts[0])
        chosen = train.where(within).select("doc_id", "label")  # about `sample` rows a label
        rows = base.where("not held_out").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text").distinct().orderBy("doc_id", "text").collect()
        texts = {0: ([], []), 1: ([], [])}
        for r in rows:
            texts[r.label][r.doc_id * 2654435761 % 2 ** 32 % 3 == 0].append(r.text.encode())
        bad, good = (build_dictionary(texts[label][0]) for label in (0, 1))
        measure = Sizes(good, bad)
        tried = [(t, label) for label in (0, 1) for t in texts[label][1]]
        if len({label for _, label in tried}) == 2:
            x = features(np.array([measure(t) for t, _ in tried]), np.array([len(t) for t, _ in tried]))
            # the sample has equally many of both labels: the constant goes back to the labels' shares
            w, mean, scale = fit_logistic(x, np.array([label for _, label in tried], float))
            n = [sum(label == k for _, label in tried) for k in (0, 1)]
            w[0] += np.log(share / (1 - share)) - np.log(n[1] / n[0])
            model = (w, mean, scale)
    return base.mapInArrow(_predict(good, bad, model, share, threshold),
                           "doc_id long, held_out boolean, score double, predicted int, difference double")
