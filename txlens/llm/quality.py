"""Quality classifier: regularised quadratic discriminant analysis.

Each class has a Gaussian over the transformed statistics of ``statistics``.
Its covariance is shrunk twice: by ``pooled`` towards the pooled covariance and
by ``ridge`` towards a multiple of the identity.  A document's raw score is the
difference of the two log densities (Mahalanobis distances through the cached
inverse Cholesky factors) plus the log prior ratio; the probability is a
logistic curve over ``asinh`` of that difference, which keeps the order of far
outliers.

Fitting is distributed and exact over all labelled rows.  Class moments are
sums, so one pass gathers them by fold and the leave-one-fold-out models are
differences of sums.  A second pass counts the out-of-fold scores of every
shrinkage setting in fixed bins; setting and curve are chosen from those
counts.  What reaches the driver has a fixed size.

Defined results: NULL and empty texts are scored like any text; labels that
are NULL, not 0/1 or contradict each other for one id are not used; without
two classes every score is the smoothed share of label 1 (0.5 for none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txlens.llm.common import bound_batches, col, fresh, sum_vectors, utf8
from txlens.llm.statistics import NAMES, describe, document_statistics
from txlens.session import materialize

FOLDS = 5
POOLED = (0.1, 0.3, 0.6, 0.9)
RIDGE = (0.001, 0.01, 0.1)
BIN, BINS = 0.05, 800          # asinh scores, clipped to +-20
THRESHOLD = 0.7


@dataclass
class Gaussian:
    mean: np.ndarray
    inverse: np.ndarray        # of the Cholesky factor
    constant: float            # log prior minus half the log determinant

    def log_density(self, z: np.ndarray) -> np.ndarray:
        return self.constant - 0.5 * np.square((z - self.mean) @ self.inverse.T).sum(axis=1)


@dataclass
class QualityModel:
    centre: np.ndarray
    scale: np.ndarray
    classes: tuple[Gaussian, Gaussian] | None
    slope: float
    offset: float
    pooled: float = 0.0
    ridge: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        return np.arcsinh(self.classes[1].log_density(z) - self.classes[0].log_density(z))

    def score(self, x: np.ndarray) -> np.ndarray:
        t = self.difference(x) if self.classes else np.zeros(len(x))
        return 1 / (1 + np.exp(-np.clip(self.slope * t + self.offset, -700, 700)))


class Moments:
    """Row count, sum and sum of products of each class."""

    def __init__(self, n: np.ndarray, s: np.ndarray, q: np.ndarray):
        self.n, self.s, self.q = n, s, q

    def __sub__(self, o: "Moments") -> "Moments":
        return Moments(self.n - o.n, self.s - o.s, self.q - o.q)

    def scaling(self) -> tuple[np.ndarray, np.ndarray]:
        n = max(1.0, self.n.sum())
        mean = self.s.sum(axis=0) / n
        var = np.diag(self.q.sum(axis=0)) / n - mean ** 2
        return mean, np.sqrt(np.where(var > 1e-9, var, 1.0))

    def gaussians(self, centre, scale, pooled: float, ridge: float) -> tuple[Gaussian, Gaussian] | None:
        if self.n.min() < 1:
            return None
        d = len(centre)
        means, spreads = [], []
        for k in (0, 1):
            m = self.s[k] / self.n[k]
            means.append((m - centre) / scale)
            spreads.append((self.q[k] / self.n[k] - np.outer(m, m)) / np.outer(scale, scale))
        shared = np.tensordot(self.n / self.n.sum(), np.array(spreads), 1)
        out = []
        for k in (0, 1):
            cov = (1 - pooled) * spreads[k] + pooled * shared
            cov = (1 - ridge) * cov + (ridge * max(np.trace(cov) / d, 1e-3) + 1e-9) * np.eye(d)
            factor = np.linalg.cholesky(cov)
            out.append(Gaussian(means[k], np.linalg.inv(factor),
                                float(np.log(self.n[k] / self.n.sum()) - np.log(np.diag(factor)).sum())))
        return out[0], out[1]


def _batch(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
    return x, b.column(1).to_numpy(), b.column(2).to_numpy()


def gather_moments(rows: DataFrame, folds: int = FOLDS) -> list[Moments]:
    """One Moments per fold from (x, label, fold) rows."""
    d = len(NAMES)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        total = np.zeros((folds * 2, 1 + d + d * d))
        for b in batches:
            if not b.num_rows:
                continue
            x, y, f = _batch(b)
            for k in np.unique(f * 2 + y):
                own = x[f * 2 + y == k]
                total[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield total.ravel()

    sums = sum_vectors(rows, partial, folds * 2 * (1 + d + d * d))
    sums = sums.reshape(folds, 2, -1)
    return [Moments(s[:, 0], s[:, 1:1 + d], s[:, 1 + d:].reshape(2, d, d)) for s in sums]


def out_of_fold_bins(rows: DataFrame, models: list[list[QualityModel]]) -> np.ndarray:
    """Counts (setting, label, bin) of each row's score by the model of its
    setting that did not see its fold."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        n = np.zeros((len(models), 2, BINS))
        for b in batches:
            if not b.num_rows:
                continue
            x, y, f = _batch(b)
            for fold in np.unique(f):
                at = f == fold
                for g, by_fold in enumerate(models):
                    t = by_fold[fold].difference(x[at])
                    bins = np.clip((t / BIN).astype("int64") + BINS // 2, 0, BINS - 1)
                    n[g] += np.bincount(y[at] * BINS + bins, minlength=2 * BINS).reshape(2, BINS)
        yield n.ravel()

    return sum_vectors(rows, partial, len(models) * 2 * BINS).reshape(len(models), 2, BINS)


def logistic_curve(counts: np.ndarray) -> tuple[float, float, float]:
    """(slope, offset, mean loss) of the logistic curve over binned scores, with
    smoothed targets so that separable classes have a finite slope."""
    t = (np.arange(BINS) - BINS // 2 + 0.5) * BIN
    n0, n1 = counts[0].sum(), counts[1].sum()
    weight = np.concatenate([counts[0], counts[1]])
    target = np.repeat([1 / (n0 + 2), (n1 + 1) / (n1 + 2)], BINS)
    x = np.stack([np.tile(t, 2), np.ones(2 * BINS)], 1)

    def loss(v: np.ndarray) -> float:
        m = x @ v
        return float((weight * (np.logaddexp(0, m) - target * m)).sum() / (n0 + n1))

    v = np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ v))
        grad = x.T @ (weight * (p - target))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2) * weight.sum()
        step, scale = np.linalg.solve(hess, grad), 1.0
        while scale > 1e-6 and loss(v - scale * step) > loss(v):
            scale /= 2
        v = v - scale * step
        if np.abs(scale * step).max() < 1e-8:
            break
    return float(v[0]), float(v[1]), loss(v)


def fit(rows: DataFrame, folds: int = FOLDS) -> QualityModel:
    """The model from (x array<double>, label 0/1, fold) rows."""
    rows = rows.select(F.col("x"), F.col("label").cast("int"), F.col("fold").cast("int"))
    by_fold = gather_moments(rows, folds)
    total = Moments(*(sum(getattr(m, k) for m in by_fold) for k in ("n", "s", "q")))
    centre, scale = total.scaling()
    n0, n1 = total.n
    constant = QualityModel(centre, scale, None, 0.0, float(np.log((n1 + 1) / (n0 + 1))))
    if total.n.min() < 1:
        return constant
    settings = [(p, r) for p in POOLED for r in RIDGE]
    models = [[QualityModel(centre, scale, (total - m).gaussians(centre, scale, p, r)
                            or total.gaussians(centre, scale, p, r), 1.0, 0.0) for m in by_fold]
              for p, r in settings]
    curves = [logistic_curve(c) for c in out_of_fold_bins(rows, models)]
    best = min(range(len(settings)), key=lambda g: (curves[g][2], g))
    p, r = settings[best]
    return QualityModel(centre, scale, total.gaussians(centre, scale, p, r), *curves[best][:2], p, r)


def crc(column: Column) -> Column:
    """crc32 of an id as text; 0 for NULL."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")), F.lit(0).cast("long"))


def training_rows(features: DataFrame, labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """(x, label, fold) of the labelled rows of ``features`` (doc_id, x)."""
    known = (labels.select(col("doc_id").alias("doc_id"), col(label_col).cast("int").alias("label"))
             .filter(F.col("label").isin(0, 1)).groupBy("doc_id")
             .agg(F.min("label").alias("label"), F.max("label").alias("top"))
             .filter(F.col("label") == F.col("top")).drop("top"))
    return features.join(known, "doc_id").select("x", "label", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).alias("fold"))


def scorer(model: QualityModel):
    """Probability from the statistics array."""
    @F.pandas_udf(T.DoubleType())
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x.to_numpy())) if len(x) else np.zeros(0))
    return score


def text_scorer(model: QualityModel):
    """Probability from the whole text, in one pass."""
    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(np.array([describe(bytes(t)) for t in texts]).reshape(len(texts), -1)))
    return score


def fit_documents(docs: DataFrame, labels: DataFrame, trainable: Column | None = None,
                  label_col: str = "quality") -> QualityModel:
    """Fit on the labelled documents for which ``trainable`` holds."""
    bound_batches(docs.sparkSession)
    own = docs.select(col("doc_id").alias("doc_id"), col("text").alias("text"))
    if trainable is not None:
        own = own.filter(trainable)
    features = own.select("doc_id", document_statistics(utf8()).alias("x"))
    return fit(materialize(training_rows(features, labels, label_col)))


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches ``threshold``, columns unchanged."""
    score = fresh(docs, "score")
    return docs.withColumn(score, text_scorer(model)(utf8())).filter(F.col(score) >= threshold).drop(score)
