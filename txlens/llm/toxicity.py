"""Toxicity by a classifier chain of logistic models.

Categories are predicted one after the other.  Every model sees the text's
features (presence of the ``TERMS`` words that say most about its category,
document statistics) and the probabilities that the earlier models of the chain
gave.  While training, those come from models that did not see the row: each
category is fitted once per fold left out and once on all folds, in the same
passes, and a model that leaves a fold out has its words chosen without that
fold's labels too.

The models are fitted on a documented, bounded sample: the ``MAX_TRAINING``
labelled ids with the smallest hashes.  Its ids and labels are broadcast (the
bound is the parameter), so no text is shuffled to find its label.  Word
selection counts and Newton steps are distributed sums over the sample's rows;
scores cover all documents and whole texts.

Defined results: NULL and empty texts are scored like any text; labels that
are NULL, not 0/1 or contradict each other for one id are not used; a category
with one class only gets its smoothed share everywhere; ties among terms are
ordered by the term; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txlens.llm.common import bound_batches, col, sum_vectors, utf8
from txlens.llm.decontaminate import FOLD
from txlens.llm.statistics import NAMES, describe
from txlens.session import materialize

MAX_TRAINING = 20_000
TERMS = 128
MIN_TEXTS = 3
FOLDS = 5
STEPS = 8
RIDGE = 1.0
FLUSH = 200_000
FLUSH_BYTES = 16 << 20


def terms_of(text: bytes) -> set[bytes]:
    return set(text.translate(FOLD).split())


@dataclass
class ToxicityModel:
    categories: list[str]
    index: dict[bytes, int]         # the words of all models
    centre: np.ndarray = field(default_factory=lambda: np.zeros(len(NAMES)))
    scale: np.ndarray = field(default_factory=lambda: np.ones(len(NAMES)))
    #: per category and model (fold left out ..., all): its words and its weights
    words: list[list[np.ndarray]] = field(default_factory=list)
    chain: list[list[np.ndarray]] = field(default_factory=list)

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Rows of (1, words, statistics), all texts as a matrix."""
        n, m = len(texts), len(self.index)
        x = np.zeros((n, 1 + m + len(NAMES)))
        x[:, 0] = 1
        get = self.index.get
        for i, t in enumerate(texts):
            hit = [k for k in map(get, terms_of(t)) if k is not None]
            x[i, [1 + k for k in hit]] = 1
            x[i, 1 + m:] = describe(t)
        x[:, 1 + m:] = np.clip((x[:, 1 + m:] - self.centre) / self.scale, -8, 8)
        return x

    def probabilities(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        """One column per fitted category; ``which`` names each row's model."""
        p = np.zeros((len(x), 0))
        for words, weights in zip(self.words, self.chain):
            odds = np.zeros(len(x))
            for k in np.unique(which):
                at = which == k
                odds[at] = inputs(x[at], words[k], p[at]) @ weights[k]
            p = np.column_stack([p, _sigmoid(odds)])
        return p


def inputs(x: np.ndarray, words: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """What one model sees: 1, its words, the statistics, the earlier probabilities."""
    return np.column_stack([x[:, :1], x[:, 1 + words], x[:, x.shape[1] - len(NAMES):], earlier])


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def labelled_sample(labels: DataFrame, categories: dict[str, Column], usable: Column | None,
                    limit: int = MAX_TRAINING) -> DataFrame:
    """(doc_id, fold, y array<int>) of at most ``limit`` ids."""
    known = labels.filter(col("doc_id").isNotNull())
    if usable is not None:
        known = known.filter(usable)
    y = F.array(*[c.cast("int") for c in categories.values()])
    ids = (known.select(col("doc_id").alias("doc_id"), y.alias("y"))
            .filter(F.forall("y", lambda v: F.coalesce(v.isin(0, 1), F.lit(False))))
            .groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).filter(F.col("y") == F.col("top"))
            .select("doc_id", "y", F.xxhash64("doc_id").alias("h")))
    # the hashes are uniform: only the head that can hold the sample is sorted
    share = min(1.0, (1.2 * limit + 1000) / max(1, ids.count()))
    return (ids.filter(F.col("h") <= int(min(share * 2.0 ** 64 - 2.0 ** 63, 2.0 ** 63 - 1025))
                       if share < 1 else F.lit(True)).orderBy("h", "doc_id").limit(limit)
            .select("doc_id", F.pmod("h", F.lit(FOLDS)).cast("int").alias("fold"), "y"))


def select_terms(rows: DataFrame, categories: int, terms: int = TERMS) -> list[list[list[bytes]]]:
    """Per category and model (each fold left out, then all): the words whose
    presence says most about the category (G^2 of the 2 x 2 table of texts) among
    the rows the model may see, at most ``terms``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        held = 0

        def out() -> pa.RecordBatch:
            keys = list(seen)
            got = pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.int32()),
                 pa.array([k[2] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())],
                names=["term", "fold", "y", "n"])
            seen.clear()
            return got

        for b in batches:
            for text, fold, y in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = terms_of(text.as_py())
                seen.update((w, fold, y) for w in words)
                held += sum(map(len, words))
                if len(seen) > FLUSH or held > FLUSH_BYTES:
                    yield out()
                    held = 0
        yield out()

    # labels as one number, a bit per category
    code = reduce(lambda a, b: a + b, [F.col("y")[c] * (1 << c) for c in range(categories)])
    coded = rows.select("text", "fold", code.cast("int").alias("y"))
    sizes = {(r.fold, r.y): r.n for r in coded.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    models = [(c, k) for c in range(categories) for k in range(FOLDS + 1)]

    def seen_by(c: int, k: int, label: int) -> Column:
        return (F.col("fold") != k) & (F.col("y").bitwiseAND(F.lit(1 << c)) == (label << c))

    def texts_of(c: int, k: int, label: int) -> float:
        return float(sum(n for (fold, y), n in sizes.items() if fold != k and (y >> c & 1) == label))

    counts = coded.mapInArrow(count, "term binary, fold int, y int, n long")
    table = counts.groupBy("term").agg(*[
        F.sum(F.when(seen_by(c, k, label), F.col("n")).otherwise(0)).cast("double").alias(f"{name}{c}_{k}")
        for c, k in models for name, label in (("a", 1), ("b", 0))])

    def gain(c: int, k: int) -> Column:
        a, b, pos, neg = F.col(f"a{c}_{k}"), F.col(f"b{c}_{k}"), texts_of(c, k, 1), texts_of(c, k, 0)
        total = F.lit(pos + neg)

        def part(seen: Column, row: Column, column: float) -> Column:
            return F.when(seen > 0, seen * F.log(seen * total / (row * F.lit(column)))).otherwise(0.0)

        g = (part(a, a + b, pos) + part(b, a + b, neg)
             + part(F.lit(pos) - a, total - a - b, pos) + part(F.lit(neg) - b, total - a - b, neg))
        return F.when((a + b >= MIN_TEXTS) & F.lit(pos > 0 and neg > 0), g)

    each = table.select("term", F.explode(F.array(*[F.struct(F.lit(i).alias("model"), gain(c, k).alias("gain"))
                                                    for i, (c, k) in enumerate(models)])).alias("m"))
    ranked = each.filter("m.gain IS NOT NULL").withColumn(
        "rank", F.row_number().over(Window.partitionBy("m.model").orderBy(F.desc("m.gain"), "term")))
    found: list[list[list[bytes]]] = [[[] for _ in range(FOLDS + 1)] for _ in range(categories)]
    best = ranked.filter(F.col("rank") <= terms).select("m.model", "rank", "term")
    for r in sorted(best.collect(), key=lambda r: (r.model, r["rank"])):          # at most ``terms`` per model
        c, k = models[r.model]
        found[c][k].append(bytes(r.term))
    return found


def fit(rows: DataFrame, categories: list[str], terms: int = TERMS) -> ToxicityModel:
    """The chain from (text binary, fold, y) rows."""
    chosen = select_terms(rows, len(categories), terms)
    every = sorted({w for by_model in chosen for words in by_model for w in words})
    model = ToxicityModel(categories, {w: i for i, w in enumerate(every)})
    m, s = len(every), len(NAMES)

    @F.pandas_udf(T.BinaryType())
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for i in range(0, len(texts), 512):
                x = model.features([bytes(t) for t in texts.iloc[i:i + 512]]).astype("float32")
                out += [r.tobytes() for r in x]
            yield pd.Series(out)

    stored = materialize(rows.select(packed("text").alias("x"), "fold", "y"))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                b = batch.slice(i, 1024)
                x = np.frombuffer(b"".join(b.column(0).to_pylist()), "float32").reshape(b.num_rows, -1).astype("float64")
                yield x, b.column(1).to_numpy(), np.array(b.column(2).to_pylist(), "float64").reshape(b.num_rows, -1)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for x, _, _ in tables(batches):
            x = x[:, 1 + m:]
            yield np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])

    got = sum_vectors(stored, spread, 1 + 2 * s)
    n = max(1.0, got[0])
    centre = got[1:1 + s] / n
    var = got[1 + s:] / n - centre ** 2
    scale = np.sqrt(np.where(var > 1e-6, var, 1.0))
    for c in range(len(categories)):
        words = [np.array([model.index[w] for w in chosen[c][k]], "int64") for k in range(FOLDS + 1)]
        sizes = [1 + len(own) + s + c for own in words]
        wide = max(sizes)
        w = [np.zeros(d) for d in sizes]
        for _ in range(STEPS):
            now, so_far = list(w), (list(model.words), list(model.chain))

            def newton(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
                total = np.zeros((FOLDS + 1, wide + wide * wide))
                earlier = ToxicityModel(categories, {}, words=so_far[0], chain=so_far[1])
                for x, fold, y in tables(batches):
                    x[:, 1 + m:] = np.clip((x[:, 1 + m:] - centre) / scale, -8, 8)
                    # earlier categories as seen by the models without this row's fold
                    p_earlier = earlier.probabilities(x, fold)
                    for k, d in enumerate(sizes):
                        at = fold != k
                        own = inputs(x[at], words[k], p_earlier[at])
                        p = _sigmoid(own @ now[k])
                        total[k, :d] += own.T @ (y[at, c] - p)
                        total[k, wide:wide + d * d] += ((own * (p * (1 - p))[:, None]).T @ own).ravel()
                yield total.ravel()

            sums = sum_vectors(stored, newton, (FOLDS + 1) * (wide + wide * wide)).reshape(FOLDS + 1, -1)
            steps = []
            for v, u, d in zip(sums, w, sizes):
                ridge = np.full(d, RIDGE)
                ridge[0] = 1e-3
                steps.append(np.linalg.solve(v[wide:wide + d * d].reshape(d, d) + np.diag(ridge), v[:d] - ridge * u))
            longest = max(np.abs(x).max() for x in steps)
            w = [u + x * min(1.0, 5.0 / max(longest, 1e-12)) for u, x in zip(w, steps)]
            if longest < 1e-3:
                break
        model.words, model.chain = [*model.words, words], [*model.chain, w]
    model.centre, model.scale = centre, scale
    return model


def fit_documents(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], usable: Column | None = None,
                  limit: int = MAX_TRAINING) -> ToxicityModel:
    """Fit on the sampled labelled documents of ``docs``."""
    bound_batches(docs.sparkSession)
    sample = materialize(labelled_sample(labels, categories, usable, limit))     # at most ``limit`` rows
    rows = (docs.select(col("doc_id").alias("doc_id"), utf8().alias("text"))
            .join(F.broadcast(sample), "doc_id").select("text", "fold", "y"))
    return fit(materialize(rows), list(categories))


def score_udf(model: ToxicityModel):
    """The chain's probabilities, in the order of the categories."""
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for i in range(0, len(texts), 512):
                x = model.features([bytes(t) for t in texts.iloc[i:i + 512]])
                out += list(model.probabilities(x, np.full(len(x), FOLDS)))
            yield pd.Series(out)
    return score
