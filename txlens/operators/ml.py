"""Model features, training, scoring and evaluation (ML6-ML10, SNK6).

* Features and scaling are column expressions over one-row statistics,
  fitted with one distributed aggregate and applied as constants.
* Training: a relu network by distributed gradient sums (class weights, Adam,
  early stopping) and Spark ML's class-weighted logistic regression.
* Scoring a dense network is expressed as plain column arithmetic (the
  5*16 + 16*8 + 8 multiply-adds stay inside whole-stage codegen).
* The exact ROC-AUC is a rank-sum over distinct scores with a distributed
  prefix sum, so ties count one half, with no single-task sort.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txlens import constants as K
from txlens.functions.scalars import with_scalars
from txlens.operators.filters import drop_non_finite
from txlens.operators.ordering import prefix_sums
from txlens.operators.risk import moments
from txlens.operators.vector_sums import block_rows, row_blocks, sum_vectors


class QualityGateError(RuntimeError):
    pass


# -- ML6 ---------------------------------------------------------------------

def card_features(raw: DataFrame) -> DataFrame:
    """Five model features + ``Class`` from a card dataset (Time, V1..V28, Amount, Class).

    amount = log1p(max(Amount, 0)); hour = (Time / 3600) mod 24 (fractional);
    device / location = min-max of |V14| / |V12| (with 1e-9 in the range);
    velocity = clip(2 |V10|, 0, 25); then rows with NaN/Inf/NULL are dropped.
    A missing column is an error (no random fill-in).
    """
    need = ["Time", "Amount", "V10", "V12", "V14", "Class"]
    missing = [c for c in need if c not in raw.columns]
    if missing:
        raise ValueError(f"card dataset lacks columns {missing}")
    base = raw.select(
        F.log1p(F.greatest(F.col("Amount").cast("double"), F.lit(0.0))).alias("amount"),
        F.pmod(F.col("Time").cast("double") / F.lit(3600.0), F.lit(24.0)).alias("hour"),
        F.abs(F.col("V14").cast("double")).alias("__d"),
        F.abs(F.col("V12").cast("double")).alias("__l"),
        F.least(F.greatest(F.abs(F.col("V10").cast("double")) * K.CARD_VELOCITY_FACTOR, F.lit(0.0)),
                F.lit(K.CARD_VELOCITY_MAX)).alias("txn_velocity"),
        F.col("Class").cast("int").alias("Class"),
    )
    stats = base.agg(F.min("__d").alias("__d0"), F.max("__d").alias("__d1"),
                     F.min("__l").alias("__l0"), F.max("__l").alias("__l1"))
    j = with_scalars(base, stats)
    eps = F.lit(K.CARD_MINMAX_EPS)
    feats = j.select(
        "amount", "hour",
        ((F.col("__d") - F.col("__d0")) / (F.col("__d1") - F.col("__d0") + eps)).alias("device_risk"),
        ((F.col("__l") - F.col("__l0")) / (F.col("__l1") - F.col("__l0") + eps)).alias("location_risk"),
        "txn_velocity", "Class")
    return drop_non_finite(feats, K.MODEL_FEATURES + ["Class"])


# -- scaling (sklearn-style: population std) --------------------------------

def fit_scaler(train: DataFrame, features=K.MODEL_FEATURES) -> DataFrame:
    """One-row scaler: ``feature_names``, ``mean``, ``scale`` (population std; 0 -> 1)."""
    m = moments(train, list(features))
    return m.select(
        F.array(*[F.lit(c) for c in features]).alias("feature_names"),
        F.array(*[F.col(f"{c}_mean") for c in features]).alias("mean"),
        F.array(*[F.when(F.coalesce(F.col(f"{c}_std_pop"), F.lit(0.0)) == 0, F.lit(1.0))
                  .otherwise(F.col(f"{c}_std_pop")) for c in features]).alias("scale"))


def apply_scaler(df: DataFrame, scaler: DataFrame, features=K.MODEL_FEATURES, suffix: str = "_s") -> DataFrame:
    """z-score with a stored scaler (one-row frame, applied as constants)."""
    j = with_scalars(df, scaler.select(F.col("mean").alias("__mean"), F.col("scale").alias("__scale")))
    for i, c in enumerate(features):
        sc = F.col("__scale")[i]
        j = j.withColumn(f"{c}{suffix}", (F.col(c) - F.col("__mean")[i]) / F.when(sc == 0, F.lit(1.0)).otherwise(sc))
    return j.drop("__mean", "__scale")


# -- ML8: dense network as column expressions --------------------------------

def _act(x: Column, kind: str) -> Column:
    if kind == "relu":
        return F.greatest(x, F.lit(0.0))
    if kind == "sigmoid":
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
    if kind == "linear":
        return x
    raise ValueError(kind)


def dense_network(inputs: list[Column], layers) -> Column:
    """Output of a dense network; ``layers`` = [(W[in][out], b[out], activation)].

    The last layer must have one output unit.
    """
    h = inputs
    for W, b, act in layers:
        outs = []
        for j in range(len(b)):
            z = F.lit(float(b[j]))
            for i, x in enumerate(h):
                z = z + F.lit(float(W[i][j])) * x
            outs.append(_act(z, act))
        h = outs
    if len(h) != 1:
        raise ValueError("the last layer must have one unit")
    return h[0]


def score_model(df: DataFrame, scaler: DataFrame | None = None, layers=None,
                out: str = "fraud_probability") -> DataFrame:
    """ML8: probability from log1p(amount) and the other four features, z-scored
    with the stored scaler, through the network, clamped to [0, 1].  Without
    a model or a scaler the heuristic score (RUL3) is used instead."""
    from txlens.functions.rules import heuristic_score

    if scaler is None or layers is None:
        return df.withColumn(out, heuristic_score())
    raw = df.withColumn("__amount_log", F.log1p(F.col("amount")))
    feats = ["__amount_log", "hour", "device_risk", "location_risk", "txn_velocity"]
    scaled = apply_scaler(raw, scaler, feats, "__z")
    # One nested expression: codegen's subexpression elimination computes each
    # hidden unit once, in small generated functions.  (One projection per layer
    # measured ~8x slower at sf0.1: a single huge generated method.)
    p = dense_network([F.col(f"{c}__z") for c in feats], layers)
    return (scaled.withColumn(out, F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))
            .drop("__amount_log", *[f"{c}__z" for c in feats]))


def layers_from_spark_mlp(model) -> list:
    """Weights of a fitted ``MultilayerPerceptronClassificationModel`` as layers.

    Spark's hidden layers use the sigmoid; its two-unit softmax output becomes
    one sigmoid unit on the difference of the two logits.
    """
    sizes = list(model.getLayers())
    w = list(model.weights.toArray())
    layers, pos = [], 0
    for li in range(len(sizes) - 1):
        n_in, n_out = sizes[li], sizes[li + 1]
        # Each layer: an (n_out x n_in) column-major matrix, then n_out biases.
        W = [[w[pos + i * n_out + j] for j in range(n_out)] for i in range(n_in)]
        pos += n_in * n_out
        b = w[pos:pos + n_out]
        pos += n_out
        last = li == len(sizes) - 2
        if last and n_out == 2:
            W = [[row[1] - row[0]] for row in W]
            b = [b[1] - b[0]]
            layers.append((W, b, "sigmoid"))
        else:
            layers.append((W, b, "sigmoid"))
    return layers


# -- ML7: training -------------------------------------------------------------

@dataclass
class NetworkModel:
    """A trained dense network; ``layers`` as :func:`dense_network` takes them."""
    layers: list
    #: validation AUC after each epoch (binned), the best one's weights are kept
    history: list[float] = field(default_factory=list)


def _shapes(sizes: list[int]) -> list[tuple[int, int]]:
    return list(zip(sizes[:-1], sizes[1:]))


def _unpack(theta: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for n_in, n_out in _shapes(sizes):
        out.append((theta[at:at + n_in * n_out].reshape(n_in, n_out), theta[at + n_in * n_out:at + (n_in + 1) * n_out]))
        at += (n_in + 1) * n_out
    return out


def _forward(x: np.ndarray, layers: list) -> list[np.ndarray]:
    """Inputs of every layer, and the last one's output (the logit)."""
    hs = [x]
    for i, (w, b) in enumerate(layers):
        z = hs[-1] @ w + b
        hs.append(np.maximum(z, 0.0) if i < len(layers) - 1 else z)
    return hs


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def network_gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray, theta: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Gradient of the weighted log-loss, summed over the rows, and the rows' weight."""
    layers = _unpack(theta, sizes)
    hs = _forward(x, layers)
    back = ((_sigmoid(hs[-1][:, 0]) - y) * w)[:, None]
    parts: list[np.ndarray] = []
    for i in range(len(layers) - 1, -1, -1):
        parts = [(hs[i].T @ back).ravel(), back.sum(axis=0), *parts]
        if i:
            back = (back @ layers[i][0].T) * (hs[i] > 0)
    return np.concatenate([*parts, [w.sum()]])


BINS = 4096


def _binned_auc(blocks: DataFrame, theta: np.ndarray, sizes: list[int]) -> float:
    """AUC with scores in ``BINS`` classes: one pass over blocks of inputs and label,
    for early stopping only."""
    d = sizes[0]

    def count(batches):
        total = np.zeros((2, BINS))
        for rows in block_rows(batches, d + 1):
            p = _sigmoid(_forward(rows[:, :d], _unpack(theta, sizes))[-1][:, 0])
            at = np.minimum((p * BINS).astype("int64"), BINS - 1)
            for c in (0, 1):
                total[c] += np.bincount(at[rows[:, d] == c], minlength=BINS)
        yield total.ravel()

    neg, pos = sum_vectors(blocks, count, 2 * BINS).reshape(2, BINS)
    pairs = pos.sum() * neg.sum()
    return float((pos * (np.cumsum(neg) - neg / 2)).sum() / pairs) if pairs else math.nan


def train_network(train: DataFrame, validation: DataFrame, inputs: list[str], label: str, weight: str,
                  hidden=K.HIDDEN_LAYERS, epochs: int = K.EPOCHS, patience: int = K.PATIENCE, slices: int = 8,
                  rate: float = 0.02, seed: int = K.MODEL_SEED, slice_by: list[str] | None = None) -> NetworkModel:
    """Relu network with a sigmoid output, weighted log-loss, Adam, early stopping on
    the validation AUC with the best epoch's weights kept.

    An epoch is one pass over the rows in ``slices`` parts, by the hash of the columns
    ``slice_by`` (default: the inputs; name raw ones where the inputs are scaled); a
    part's gradient is a sum over the executors, the step is taken on the driver (a
    few hundred parameters).  The rows stay in their partitions, packed once into
    blocks per part, so a step reads its own part only; the result does not depend on
    partitions.  NULL inputs are not allowed; rows of weight 0 count
    nothing.
    """
    sizes = [len(inputs), *hidden, 1]
    rng = np.random.default_rng(seed)
    theta = np.concatenate([np.r_[rng.uniform(-1, 1, n_in * n_out) * math.sqrt(6 / (n_in + n_out)), np.zeros(n_out)]
                            for n_in, n_out in _shapes(sizes)])
    cols = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(inputs)]
    d = len(inputs)
    part_of = F.pmod(F.xxhash64(*(slice_by or inputs)), F.lit(slices)).cast("int").alias("slice")
    y = F.col(label).cast("double").alias("y")
    rows = row_blocks(train.select(*cols, y, F.col(weight).cast("double").alias("w"), part_of),
                      d + 2, slices, required=(d, d + 1)).persist()
    held = row_blocks(validation.select(*cols, y), d + 1, required=(d,)).persist()
    first, second, step = np.zeros_like(theta), np.zeros_like(theta), 0
    best, best_theta, history, waited = -1.0, theta, [], 0
    try:
        for _ in range(epochs):
            for part in range(slices):
                now = theta

                def gradient(batches):
                    total = np.zeros(len(now) + 1)
                    for x in block_rows(batches, d + 2):
                        total += network_gradient(x[:, :d], x[:, d], x[:, d + 1], now, sizes)
                    yield total

                sums = sum_vectors(rows.filter(F.col("part") == part), gradient, len(theta) + 1)
                if not sums[-1]:
                    continue
                g, step = sums[:-1] / sums[-1], step + 1
                first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
                theta = theta - rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-7)
            auc = _binned_auc(held, theta, sizes)
            history.append(auc)
            if auc > best or math.isnan(auc):
                best, best_theta, waited = (best if math.isnan(auc) else auc), theta, 0
            elif (waited := waited + 1) >= patience:
                break
    finally:
        rows.unpersist()
        held.unpersist()
    acts = ["relu"] * len(hidden) + ["sigmoid"]
    return NetworkModel([(w.tolist(), b.tolist(), a) for (w, b), a in zip(_unpack(best_theta, sizes), acts)], history)


def train_classifier(train: DataFrame, features=K.MODEL_FEATURES, label: str = K.MODEL_LABEL,
                     kind: str = "network", weights: DataFrame | None = None, seed: int = K.MODEL_SEED,
                     max_iter: int = 100, validation: DataFrame | None = None):
    """Fit on z-scored features (scaler fitted on ``train``), rows weighted by the
    balanced class weights (AGG11).

    ``kind='network'``: :func:`train_network` with hidden layers 16 and 8;
    ``validation`` stops it early (default: the training rows).  ``kind='logistic'``:
    logistic regression with the weights as ``weightCol``.  Returns (model, scaler).
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    scaler = fit_scaler(train, features)
    if weights is None:
        from txlens.operators.sampling import class_weights
        weights = class_weights(train, label)
    by_class = {r[label]: float(r["weight"]) for r in weights.select(label, "weight").collect()}      # a row per class
    own = F.lit(0.0)
    for value, w in by_class.items():
        own = F.when(F.col(label) == value, F.lit(w)).otherwise(own)
    scaled = apply_scaler(train, scaler, features).withColumn("__w", own)
    inputs = [f"{c}_s" for c in features]
    if kind == "network":
        held = scaled if validation is None else apply_scaler(validation, scaler, features)
        return train_network(scaled, held, inputs, label, "__w", seed=seed, slice_by=[*features, label]), scaler
    if kind == "logistic":
        vec = VectorAssembler(inputCols=inputs, outputCol="__x").transform(scaled).withColumn("__y", F.col(label).cast("double"))
        return LogisticRegression(featuresCol="__x", labelCol="__y", weightCol="__w", maxIter=max_iter).fit(vec), scaler
    raise ValueError(kind)


def predict(model, df: DataFrame, scaler: DataFrame, features=K.MODEL_FEATURES, out: str = "score") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    scaled = apply_scaler(df, scaler, features)
    if isinstance(model, NetworkModel):
        p = dense_network([F.col(f"{c}_s") for c in features], model.layers)
        return scaled.withColumn(out, p).drop(*[f"{c}_s" for c in features])
    vec = VectorAssembler(inputCols=[f"{c}_s" for c in features], outputCol="__x").transform(scaled)
    model = model.copy()
    model.setFeaturesCol("__x")
    pred = model.transform(vec)
    return (pred.withColumn(out, vector_to_array("probability")[1])
            .drop("__x", "rawPrediction", "probability", "prediction", *[f"{c}_s" for c in features]))


def save_model(model, scaler: DataFrame, path: str) -> None:
    """The fitted model and its scaler under ``path``, for :func:`load_model`."""
    from txlens.sources.sinks import publish, write_scaler

    if isinstance(model, NetworkModel):
        layers = scaler.sparkSession.createDataFrame([(w, b, a) for w, b, a in model.layers], LAYER).withColumn(
            "layer", F.monotonically_increasing_id())
        publish(layers.coalesce(1), f"{path.rstrip('/')}/model", "json")
    else:
        model.write().overwrite().save(f"{path.rstrip('/')}/model")
    write_scaler(scaler, f"{path.rstrip('/')}/scaler")


LAYER = "weights array<array<double>>, bias array<double>, activation string"


def load_model(spark, path: str, kind: str = "network"):
    """(model, scaler) as :func:`predict` takes them."""
    from pyspark.ml.classification import LogisticRegressionModel

    from txlens.sources.feed import current_version

    path = path.rstrip("/")
    if kind == "network":
        rows = (spark.read.schema(f"{LAYER}, layer long").json(current_version(spark, f"{path}/model"))
                .orderBy("layer").collect())                                       # a row per layer
        model = NetworkModel([([list(w) for w in r.weights], list(r.bias), r.activation) for r in rows])
    else:
        model = LogisticRegressionModel.load(f"{path}/model")
    return model, read_scaler(spark, f"{path}/scaler")


def read_scaler(spark, path: str) -> DataFrame:
    """A scaler artifact (feature_names, mean, scale) that SNK6 wrote."""
    from txlens.sources.feed import read_published

    return read_published(spark, path, "json").select(
        "feature_names", F.col("mean").cast("array<double>"), F.col("scale").cast("array<double>"))


# -- ML9 / ML10 ----------------------------------------------------------------

def _per_score(pred: DataFrame, score: str, label: str) -> DataFrame:
    """Rows of each class per distinct score, and the negatives below it: one pass
    over the predictions, all metrics follow from it.  Rows without a score or
    label count nowhere."""
    per = (pred.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("score"))
           .agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("double").alias("pos"),
                F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).cast("double").alias("neg")))
    return prefix_sums(per, [F.col("score").asc()], ["neg"], inclusive=False)


def exact_auc(pred: DataFrame, score: str = "score", label: str = K.MODEL_LABEL) -> DataFrame:
    """ROC-AUC as P(score_pos > score_neg) + P(equal) / 2, exactly (one row, ``auc``).

    Positives and negatives are counted per distinct score (an aggregate), the
    negatives below each score come from a distributed prefix sum, and one
    final aggregate gives the area.
    """
    return _per_score(pred, score, label).agg(_area().alias("auc"))


def _area() -> F.Column:
    pairs = F.sum("pos") * F.sum("neg")
    return F.when(pairs > 0, F.sum(F.col("pos") * (F.col("neg_cum") + F.col("neg") / 2.0)) / pairs)


def evaluate(pred: DataFrame, score: str = "score", label: str = K.MODEL_LABEL,
             dataset_source: str = "synthetic") -> DataFrame:
    """ML9: one metrics row: ``val_loss`` (log-loss, p clipped to [1e-7, 1-1e-7]),
    ``val_accuracy`` (threshold 0.5), ``val_auc`` (exact) and ``dataset_source``.
    The predictions are computed once: everything comes from the counts per score."""
    eps = 1e-7
    p = F.least(F.greatest(F.col("score"), F.lit(eps)), F.lit(1 - eps))
    n = F.sum(F.col("pos") + F.col("neg"))
    loss = -(F.col("pos") * F.log(p) + F.col("neg") * F.log(1 - p))
    hits = F.when(F.col("score") >= 0.5, F.col("pos")).otherwise(F.col("neg"))
    return _per_score(pred, score, label).agg(
        (F.sum(loss) / n).alias("val_loss"), (F.sum(hits) / n).alias("val_accuracy"), _area().alias("val_auc")
    ).withColumn("dataset_source", F.lit(dataset_source))


def quality_gate(metrics: DataFrame, minimum: float = K.AUC_GATE) -> float:
    """ML10: read the one metrics row and reject the model when AUC < minimum."""
    auc = metrics.select("val_auc").first()[0]
    if auc is None or (isinstance(auc, float) and math.isnan(auc)) or auc < minimum:
        raise QualityGateError(f"validation AUC {auc} is below the required {minimum}")
    return float(auc)
