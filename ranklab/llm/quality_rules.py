"""Quality rules: fixed base rules, then robust multivariate outliers.

Text statistics are transformed to roughly even scales. For each cell (language
and source, null being a value like any other) a minimum-covariance-determinant
estimate of centre and scatter is found by concentration steps: the rows with
the smallest Mahalanobis distances (a share ``ALPHA`` of the cell) give the next
centre and scatter. A step is two grouped aggregates over the statistics of all
rows (a mergeable quantile and sums of products), so a cell of any size is
spread over the cluster. A last reweighting step uses all rows within the 97.5 %
distance. Rows beyond the ``CUT`` distance are rejected.

Rows of a cell with fewer than ``LEAST_ROWS`` rows are judged by the estimate
over all rows of their language, and where the language has fewer, by the
estimate over all rows, so every row that passes the base rules has a distance.
Each statistic has a least spread (``SPREADS``), so a cell whose texts agree in a
statistic does not reject every other value of it.

Defined cases: null text has no words and fails the base rules; null language or
source is a cell of its own; ids may be null or repeat; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, byte_column, record_batch, ship, stored

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
LEAST_WORDS, MOST_REPEAT_PERCENT = 20, 30
ALPHA, STEPS, CUT, LEAST_ROWS = 0.75, 3, 1 - 1e-9, 100
#: Least standard deviation of each transformed statistic.
SPREADS = {"length": 0.5, "word_length": 0.04, "symbols": 0.05, "dup_lines": 0.15, "repeats": 0.12, "variety": 0.06, "capitals": 0.04}
#: Parameter tables of up to so many cells are broadcast (under 10 KB each).
BROADCAST_CELLS = 5000

_STATS = pa.schema([(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
                                               "n_distinct", "n_capitals")])


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words in ``window``-word windows that occur twice or more (exact: windows
    get identifiers by sorting pairs of the identifiers of their halves)."""
    if len(ids) <= window:
        return 0
    size, level = 1, ids.astype(np.int64)
    while size < window:
        n = len(level) - size
        level = np.unique(level[:n] * (int(level.max()) + 1) + level[size:size + n], return_inverse=True)[1]
        size *= 2
    twice = np.bincount(level)[level] > 1
    change = np.zeros(len(ids) + 1, np.int64)
    change[:len(twice)] += twice
    change[window:] -= twice
    return int((np.cumsum(change[:-1]) > 0).sum())


def text_statistics(text: bytes) -> tuple[int, ...]:
    words = text.split()
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    bare = text.translate(None, SPACES)
    points = len(bare) - len(bare.translate(None, bytes(c for c in range(256) if not 128 <= c < 192)))
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    return (len(words), points, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(ids),
            len(lines), len(numbers), len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")))


def _measure(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, starts, ends = byte_column(batch.column("text"))
            rows = [text_statistics(buf[s:e].tobytes()) for s, e in zip(starts, ends)]
            if rows:
                rest = [batch.column(c) for c in batch.schema.names if c != "text"]
                yield record_batch(pa.schema([*(f for f in batch.schema if f.name != "text"), *schema]), *rest, *zip(*rows))
    return run


def transformed() -> dict[str, Column]:
    n = F.col("n_words")
    return {
        "length": F.log(n + 1.0),
        "word_length": F.log((F.col("word_chars") + 1) / (n + 1)),
        "symbols": F.sqrt(F.col("n_symbols") / n),
        "dup_lines": F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        "repeats": F.sqrt(F.col("n_repeat_words") / n),
        "variety": F.log(F.col("n_distinct") / n),
        "capitals": F.sqrt(F.col("n_capitals") / F.greatest("word_chars", F.lit(1))),
    }


def chi2_quantile(p: int, q: float) -> float:
    """Wilson and Hilferty's approximation."""
    a = 2 / (9 * p)
    return p * (1 - a + NormalDist().inv_cdf(q) * math.sqrt(a)) ** 3


def chi2_probability(p: int, x: float) -> float:
    a = 2 / (9 * p)
    return NormalDist().cdf(((x / p) ** (1 / 3) - 1 + a) / math.sqrt(a))


def consistency(p: int, share: float) -> float:
    """Factor that makes the scatter of the innermost share right for normal data."""
    return share / chi2_probability(p + 2, chi2_quantile(p, share))


def _estimate(names: list[str], factor: float):
    """Centre and inverse scatter of each cell from its sums."""
    spread = np.array([SPREADS[n] for n in names]) ** 2

    def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in tables:
            centres, shapes = [], []
            for n, s, ss in zip(t["n"], t["s"], t["ss"]):
                s = np.asarray(s, float) / n
                square = np.zeros((len(names), len(names)))
                square[np.triu_indices(len(names))] = ss
                square = square + np.triu(square, 1).T
                scatter = (square / n - np.outer(s, s)) * factor
                scatter = (scatter + scatter.T) / 2 + np.diag(spread)
                centres.append(s.tolist())
                shapes.append(np.linalg.inv(scatter).reshape(-1).tolist())
            yield pd.DataFrame({"cell": t["cell"], "centre": centres, "shape": shapes})
    return run


def with_cells(rows: DataFrame, broad: str, narrow: str, least: int) -> DataFrame:
    """``rows`` once for each estimate they count in (``cell``), with the cell
    that judges them (``judge``): their own, or where that has fewer than
    ``least`` rows all rows of the broad value, or where these are fewer all rows."""
    def name(*columns):  # lengths keep (a, bc) and (ab, c) apart
        return F.concat_ws("|", *(F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in columns))

    counts = stored(rows.groupBy(broad, narrow).agg(F.count("*").alias("n")))
    of_broad = stored(counts.groupBy(F.col(broad).alias("of")).agg(F.sum("n").alias("m"), F.min("n").alias("smallest")))
    small = not of_broad.where(F.col("m") < least).isEmpty()
    own, pool, all_ = name(broad, narrow), F.concat(name(broad), F.lit("|*")), F.lit("*")
    wide = F.col("m") >= least
    plan = counts.join(of_broad, F.col(broad).eqNullSafe(F.col("of"))).select(
        F.col(broad).alias("b"), F.col(narrow).alias("s"),
        F.when(F.col("n") >= least, own).when(wide, pool).otherwise(all_).alias("judge"),
        F.array_compact(F.array(F.when(F.col("n") >= least, own), F.when(wide & (F.col("smallest") < least), pool),
                                F.when(F.lit(small), all_))).alias("cells"))
    plan = stored(plan)
    if plan.count() <= BROADCAST_CELLS:
        plan = F.broadcast(plan)
    placed = rows.join(plan, rows[broad].eqNullSafe(F.col("b")) & rows[narrow].eqNullSafe(F.col("s"))).drop("b", "s")
    return placed.withColumn("cell", F.explode("cells")).drop("cells")


def mcd_distances(rows: DataFrame, names: list[str], alpha: float = ALPHA, steps: int = STEPS, least: int = LEAST_ROWS) -> DataFrame:
    """``rows`` (``cell`` and the named doubles) with ``distance``: the squared
    Mahalanobis distance from the cell's estimate, null in cells of fewer than ``least`` rows."""
    p = len(names)
    upper = [(i, j) for i in range(p) for j in range(i, p)]

    def measured(params: DataFrame) -> DataFrame:
        if params.count() <= BROADCAST_CELLS:
            params = F.broadcast(params)
        joined = rows.join(params, "cell")
        off = [F.col(n) - F.col("centre")[i] for i, n in enumerate(names)]
        total = None
        for i, j in upper:
            term = off[i] * off[j] * F.col("shape")[i * p + j] * (1.0 if i == j else 2.0)
            total = term if total is None else total + term
        return joined.withColumn("distance", total).drop("centre", "shape")

    def moments(near: DataFrame, factor: float) -> DataFrame:
        sums = near.groupBy("cell").agg(
            F.count("*").alias("n"), F.array(*(F.sum(n) for n in names)).alias("s"),
            F.array(*(F.sum(F.col(names[i]) * F.col(names[j])) for i, j in upper)).alias("ss"))
        return stored(sums.mapInPandas(_estimate(names, factor), "cell string, centre array<double>, shape array<double>"))

    marks = rows.groupBy("cell").agg(F.count("*").alias("n"), *(F.percentile_approx(n, [0.25, 0.5, 0.75], 1000).alias(n) for n in names))
    diagonal = [F.lit(0.0)] * (p * p)
    for i, n in enumerate(names):
        wide = F.greatest((F.col(n)[2] - F.col(n)[0]) / 1.349, F.lit(SPREADS[n]))
        diagonal[i * (p + 1)] = 1.0 / (wide * wide)
    params = stored(marks.where(F.col("n") >= least).select(
        "cell", F.array(*(F.col(n)[1] for n in names)).alias("centre"), F.array(*diagonal).alias("shape")))
    for _ in range(steps):
        far = stored(measured(params).groupBy("cell").agg(F.percentile_approx("distance", alpha, 10000).alias("limit")))
        near = measured(params).join(F.broadcast(far) if far.count() <= BROADCAST_CELLS else far, "cell").where("distance <= limit")
        params = moments(near, consistency(p, alpha))
    params = moments(measured(params).where(F.col("distance") <= chi2_quantile(p, 0.975)), consistency(p, 0.975))
    return measured(params)


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                cut: float = CUT, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the statistics, base_failed, distance, kept of every row, and the
    columns ``keep``."""
    ship(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
                       F.col(source_col).cast("string").alias("source"), F.monotonically_increasing_id().alias("row"),
                       *(F.col(c) for c in keep), F.col(text_col).alias("text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in base.drop("text").dtypes) + ", " + ", ".join(f"{n} long" for n in _STATS.names)
    stats = base.mapInArrow(_measure(_STATS), schema).withColumn(
        "base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words")))
    stats = stored(stats)
    names = list(SPREADS)
    fit = with_cells(stats.where("not base_failed"), "lang", "source", LEAST_ROWS)
    fit = stored(fit.select("row", "judge", "cell", *(c.alias(n) for n, c in transformed().items())))
    far = mcd_distances(fit, names, least=1).where("cell = judge").select("row", "distance")
    return (stats.join(far, "row", "left")
            .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi2_quantile(len(names), cut), F.lit(False)))
            .drop("row"))
