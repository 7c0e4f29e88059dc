"""Quality by a regularised quadratic discriminant (operator 7).

Every document gets STATISTICS, transformed towards the normal; the labelled training documents give
each class a mean and a covariance, from sums over all of them; a class covariance is shrunk towards
the pooled one and both towards a diagonal.  The score is the posterior of label 1 from the difference
of the log densities, by Mahalanobis distances with the Cholesky factors that the model holds.  It is
tempered by one factor that is fitted on the training documents' own log density differences, grouped
in bins, since statistics that depend on each other make the raw difference overconfident.

Defined results: a null text is an empty one; a document without words has the statistics zero and a
score like any other; rows with a null label, or without a document, teach nothing; with one class or
none to learn from, every score is that class's share (0.5 without labels); an empty table gives no
rows; columns other than doc_id, text and quality are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.common import crc_mod, materialise, ship, table

STATISTICS = ("words", "word_length", "long_words", "symbols", "punctuation", "digits", "upper", "line_repeats", "word_repeats", "short_lines", "pipes", "bangs", "stop_like", "entropy")
FOLDS, HELD_OUT = 5, 0
BAR = 0.3
#: Shares of the pooled covariance in a class's, and of the diagonal in both.
TO_POOLED, TO_DIAGONAL, RIDGE = 0.3, 0.02, 1e-2
#: Log density differences beyond this count as this, for the tempering factor and the score.
SPAN = 30.0

_CLASS = np.zeros(256, np.uint8)  # 1 digit, 2 upper, 3 lower, 4 sentence mark, 5 other ASCII mark, 6 blank, 7 pipe, 8 bang
for _c in range(128):
    _ch = chr(_c)
    _CLASS[_c] = 1 if _ch.isdigit() else 2 if _ch.isupper() else 3 if _ch.islower() else 6 if _ch.isspace() else 4 if _ch in ".,;:?'\"()-" else 7 if _ch == "|" else 8 if _ch == "!" else 5
_CLASS[128:] = 3


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    count = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=9)
    size = len(data)
    distinct = set(words)
    shown = size - int(count[6])
    lines = data.split(b"\n")
    filled = [x for x in lines if x.strip()]
    mean = shown / n
    short = sum(map(len, distinct)) / len(distinct)
    root = lambda a, b: math.sqrt(a / b) if b else 0.0
    sizes = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = sizes[sizes > 0] / size
    return [
        math.log1p(n),
        math.log(mean),
        math.log(short) - math.log(mean),
        root(int(count[5]), shown),
        root(int(count[4]), shown),
        root(int(count[1]), shown),
        root(int(count[2]), shown),
        root(len(filled) - len(set(filled)), len(filled)),
        math.log(n / len(distinct)) / math.log1p(n),
        math.log1p(n / len(filled)),
        root(int(count[7]), shown),
        root(int(count[8]), shown),
        root(len(distinct), n),
        float(-(share * np.log(share)).sum()),
    ]


class Model:
    """Per class a share, a mean and the Cholesky factor of a covariance; temper and shift of the difference."""

    def __init__(self, n: np.ndarray, means: np.ndarray, factors: np.ndarray, temper: float = 1.0):
        self.n, self.means, self.factors, self.temper = n, means, factors, temper
        self.log_dets = np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(axis=1) if len(factors) else np.zeros(0)

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        logs = []
        for mean, factor, log_det in zip(self.means, self.factors, self.log_dets, strict=True):
            y = np.linalg.solve(factor, (x - mean).T)
            logs.append(-0.5 * (y * y).sum(axis=0) - log_det)
        return np.clip(logs[1] - logs[0], -SPAN, SPAN)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.factors):
            return np.full(len(x), self.n[1] / self.n.sum() if self.n.sum() else 0.5)
        prior = math.log(self.n[1] / self.n[0])
        return 1 / (1 + np.exp(-(prior + self.temper * self.difference(x))))


def model_of(n: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> Model:
    """From per-class counts, sums and sums of outer products."""
    d = sums.shape[1]
    if (n < 2).any():
        return Model(n, np.zeros((0, d)), np.zeros((0, d, d)))
    means = sums / n[:, None]
    own = squares / n[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = np.tensordot(n / n.sum(), own, 1)
    spread = np.diag(np.maximum(np.diag(pooled), 1e-6))
    factors = []
    for k in (0, 1):
        c = (1 - TO_POOLED) * own[k] + TO_POOLED * pooled
        c = (1 - TO_DIAGONAL) * c + TO_DIAGONAL * np.diag(np.diag(c)) + RIDGE * spread
        factors.append(np.linalg.cholesky(c))
    return Model(n, means, np.array(factors))


def temper(differences: np.ndarray, labels: np.ndarray, weights: np.ndarray, prior: float) -> float:
    """The factor on log density differences with the least log loss."""
    best, factor = math.inf, 1.0
    for t in np.geomspace(0.02, 2, 60):
        z = np.clip(prior + t * differences, -50, 50)
        loss = float((weights * np.log1p(np.exp(np.where(labels == 1, -z, z)))).sum())
        if loss < best:
            best, factor = loss, float(t)
    return factor


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, x (array of STATISTICS) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, x array<double>")


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(STATISTICS))


def fit(features: DataFrame, labels: DataFrame) -> Model:
    """features: doc_id, x; labels: doc_id, quality; all rows of both that meet teach.

    Each task sums its rows; what moves is a few hundred numbers a task, and as many reach the driver.
    """
    d = len(STATISTICS)
    taught = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id_"), F.col("quality").cast("int").alias("quality"))
    rows = materialise(features.join(taught, F.col("doc_id") == F.col("doc_id_")).select("quality", "x"), "taught")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            y, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        at = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], names=["at", "v"])

    found = rows.mapInArrow(add, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    total = np.zeros(2 * (1 + d + d * d))
    total[found["at"].to_numpy(int)] = found["v"].to_numpy(float)
    total = total.reshape(2, -1)
    model = model_of(total[:, 0], total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d))
    if not len(model.factors):
        return model
    sent = ship(rows.sparkSession, model)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent()
        for batch in batches:
            at = np.round(model.difference(_matrix(batch.column(1))) * 4).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(0)], names=["bin", "quality"])

    binned = rows.mapInArrow(bins, "bin long, quality int").groupBy("bin", "quality").count().toPandas()
    model.temper = temper(binned["bin"].to_numpy(float) / 4, binned["quality"].to_numpy(int), binned["count"].to_numpy(float), math.log(model.n[1] / model.n[0]))
    return model


def scored(features: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of features."""
    sent = ship(features.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent()
        for batch in batches:
            score = model.score(_matrix(batch.column(1))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return features.mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = materialise(with_statistics(table(spark, sf_dir, "documents")), "statistics")
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", FOLDS) != HELD_OUT)
    rows = scored(features, fit(features, labels))
    return rows.select("doc_id", (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= BAR).cast("int").alias("predicted"))


QUERIES = {"op7_quality": op7_quality}
ORACLES: dict[str, str] = {}
