"""Catalog: model features, split, weights, network scoring, evaluation, training."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from txlens import constants as K
from txlens.functions.hashing import md5_bigint_sql
from txlens.functions.rules import heuristic_score
from txlens.functions.scalars import with_scalars
from txlens.operators import ml as M
from txlens.operators.sampling import class_weights, stratified_split
from txlens.plans import fixtures as fx
from txlens.plans.catalog import register
from txlens.session import checkpoint_dir, materialize

FEATS = K.MODEL_FEATURES

CARD_SQL = "WITH " + fx.sql_card() + """,
cb AS (SELECT ln(1 + greatest("Amount", 0.0)) AS amount, fmod("Time" / 3600.0, 24.0) AS hour,
              abs(V14) AS d, abs(V12) AS l,
              least(greatest(abs(V10) * 2.0, 0.0), 25.0) AS txn_velocity, "Class" FROM card),
cst AS (SELECT min(d) AS d0, max(d) AS d1, min(l) AS l0, max(l) AS l1 FROM cb),
cardf AS (SELECT amount, hour, (d - d0) / (d1 - d0 + 1e-9) AS device_risk,
                 (l - l0) / (l1 - l0 + 1e-9) AS location_risk, txn_velocity, "Class"
          FROM cb, cst)"""


@register("ml6_card_features", CARD_SQL + " SELECT * FROM cardf WHERE amount IS NOT NULL AND hour IS NOT NULL",
          FEATS)
def ml6(spark, sf):
    return M.card_features(fx.card_dataset(spark, sf))


_TRAIN_SQL = "WITH " + fx.sql_transactions() + """,
tr AS (SELECT transaction_id, amount / 10.0 AS amount, CAST(hour AS DOUBLE) AS hour, device_risk, location_risk,
              txn_velocity,
              CASE WHEN (0.00002 * (amount / 10.0) + 0.8 * (CASE WHEN hour <= 4 THEN 1.0 ELSE 0.0 END)
                         + 1.4 * device_risk + 1.2 * location_risk + 0.15 * txn_velocity) > 2.2
                   THEN 1 ELSE 0 END AS "Class" FROM txn)"""


@register("smp2_stratified_split", _TRAIN_SQL + f""",
          ranked AS (SELECT transaction_id, "Class",
                     row_number() OVER (PARTITION BY "Class" ORDER BY {md5_bigint_sql(str(K.MODEL_SEED), 'transaction_id')},
                                        transaction_id) AS r,
                     count(*) OVER (PARTITION BY "Class") AS n FROM tr)
          SELECT transaction_id, "Class", CASE WHEN r <= round(0.2 * n) THEN 1 ELSE 0 END AS is_validation
          FROM ranked""")
def smp2(spark, sf):
    """80/20 split inside each class, by md5 rank: exactly round(0.2 n_class) validation rows."""
    s = stratified_split(fx.training_set(spark, sf), "Class", "transaction_id")
    return s.select("transaction_id", "Class", F.col("is_validation").cast("int").alias("is_validation"))


@register("agg11_class_weights", _TRAIN_SQL + """ SELECT "Class", count(*) AS n_class,
          sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight FROM tr GROUP BY "Class" """,
          ["weight"])
def agg11(spark, sf):
    return class_weights(fx.training_set(spark, sf), "Class")


# Network weights for the scoring check, generated by a rule (5-16-8-1, relu, relu, sigmoid).
def rule_layers():
    sizes = [5, 16, 8, 1]
    acts = ["relu", "relu", "sigmoid"]
    layers = []
    for li in range(3):
        n_in, n_out = sizes[li], sizes[li + 1]
        W = [[round(math.sin(1.7 * (i + 1) + 0.9 * (j + 1) + 2.3 * li), 4) for j in range(n_out)]
             for i in range(n_in)]
        b = [round(0.1 * math.cos(0.7 * (j + 1) + li), 4) for j in range(n_out)]
        layers.append((W, b, acts[li]))
    return layers


def _network_sql() -> str:
    layers = rule_layers()
    names = ["x0", "x1", "x2", "x3", "x4"]
    ctes, src = [], "xs"
    for li, (W, b, act) in enumerate(layers):
        outs = []
        for j in range(len(b)):
            z = f"{b[j]!r}" + "".join(f" + {W[i][j]!r} * {names[i]}" for i in range(len(names)))
            if act == "relu":
                e = f"greatest({z}, 0.0)"
            else:
                e = f"1.0 / (1.0 + exp(-({z})))"
            outs.append(f"{e} AS h{li}_{j}")
        ctes.append(f"l{li} AS (SELECT transaction_id, {', '.join(outs)} FROM {src})")
        names = [f"h{li}_{j}" for j in range(len(b))]
        src = f"l{li}"
    return ",\n".join(ctes) + f"\nSELECT transaction_id, least(greatest({names[0]}, 0.0), 1.0) AS fraud_probability FROM {src}"


_SCORE_SQL = CARD_SQL + ", " + fx.sql_transactions() + """,
sc AS (SELECT avg(amount) AS m0, stddev_pop(amount) AS s0, avg(hour) AS m1, stddev_pop(hour) AS s1,
              avg(device_risk) AS m2, stddev_pop(device_risk) AS s2, avg(location_risk) AS m3,
              stddev_pop(location_risk) AS s3, avg(txn_velocity) AS m4, stddev_pop(txn_velocity) AS s4 FROM cardf),
xs AS (SELECT transaction_id,
              (ln(1 + amount) - m0) / CASE WHEN coalesce(s0, 0) = 0 THEN 1.0 ELSE s0 END AS x0,
              (hour - m1) / CASE WHEN coalesce(s1, 0) = 0 THEN 1.0 ELSE s1 END AS x1,
              (device_risk - m2) / CASE WHEN coalesce(s2, 0) = 0 THEN 1.0 ELSE s2 END AS x2,
              (location_risk - m3) / CASE WHEN coalesce(s3, 0) = 0 THEN 1.0 ELSE s3 END AS x3,
              (txn_velocity - m4) / CASE WHEN coalesce(s4, 0) = 0 THEN 1.0 ELSE s4 END AS x4
       FROM txn, sc),
""" + _network_sql()


@register("ml8_score_model", _SCORE_SQL, ["fraud_probability"])
def ml8(spark, sf):
    """Feed scored by a 5-16-8-1 network (rule weights) with a scaler fitted on the card features."""
    scaler = M.fit_scaler(M.card_features(fx.card_dataset(spark, sf)))
    t = fx.transactions(spark, sf)
    return M.score_model(t, scaler, rule_layers()).select("transaction_id", "fraud_probability")


@register("ml8_score_fallback", "WITH " + fx.sql_transactions() + """ SELECT transaction_id,
          least(greatest(1.0 / (1.0 + exp(-(0.00002 * amount + 0.8 * (CASE WHEN hour <= 4 THEN 1.0 ELSE 0.0 END)
          + 1.4 * device_risk + 1.2 * location_risk + 0.15 * txn_velocity) + 2.2)), 0.0), 1.0) AS fraud_probability
          FROM txn""", ["fraud_probability"])
def ml8_fallback(spark, sf):
    """Without model or scaler the heuristic score is used."""
    return M.score_model(fx.transactions(spark, sf), None, None).select("transaction_id", "fraud_probability")


_EVAL_SQL = "WITH " + fx.sql_transactions() + """,
pr AS (SELECT least(greatest(1.0 / (1.0 + exp(-(0.00002 * amount + 0.8 * (CASE WHEN hour <= 4 THEN 1.0 ELSE 0.0 END)
          + 1.4 * device_risk + 1.2 * location_risk + 0.15 * txn_velocity) + 2.2)), 0.0), 1.0) AS score,
          CASE WHEN k >= 80 THEN 1 ELSE 0 END AS "Class" FROM txn),
rk AS (SELECT score, "Class", rank() OVER (ORDER BY score) AS r, count(*) OVER (PARTITION BY score) AS t FROM pr),
auc AS (SELECT (sum(CASE WHEN "Class" = 1 THEN r + (t - 1) / 2.0 END)
               - count(*) FILTER (WHERE "Class" = 1) * (count(*) FILTER (WHERE "Class" = 1) + 1) / 2.0)
               / (CAST(count(*) FILTER (WHERE "Class" = 1) AS DOUBLE) * count(*) FILTER (WHERE "Class" = 0)) AS val_auc
        FROM rk),
base AS (SELECT avg(-("Class" * ln(least(greatest(score, 1e-7), 1 - 1e-7))
                    + (1 - "Class") * ln(1 - least(greatest(score, 1e-7), 1 - 1e-7)))) AS val_loss,
                avg(CASE WHEN CAST(score >= 0.5 AS INTEGER) = "Class" THEN 1.0 ELSE 0.0 END) AS val_accuracy FROM pr)
SELECT val_loss, val_accuracy, val_auc, 'synthetic' AS dataset_source FROM base, auc"""


@register("ml9_evaluate", _EVAL_SQL, ["val_loss", "val_accuracy", "val_auc"])
def ml9(spark, sf):
    """Log-loss, accuracy and exact AUC of the heuristic score against a k >= 80 label."""
    t = fx.transactions(spark, sf, extra=True)
    pred = t.select(heuristic_score().alias("score"), F.when(F.col("k") >= 80, 1).otherwise(0).alias("Class"))
    return M.evaluate(pred, "score", "Class")


def _train_and_evaluate(spark, sf, kind):
    data = fx.training_set(spark, sf)
    # read for the scaler, the weights, the fit, the scores and the count: split once
    split = materialize(stratified_split(data, "Class", "transaction_id"))
    train = split.filter("is_validation = 0")
    val = split.filter("is_validation = 1")
    path = f"{checkpoint_dir(spark).rstrip('/')}/txlens-io/model-{uuid.uuid4().hex}"
    M.save_model(*M.train_classifier(train, FEATS, "Class", kind=kind, validation=val), path)
    model, scaler = M.load_model(spark, path, kind)
    pred = M.predict(model, val, scaler, FEATS, "score")
    return split, materialize(M.evaluate(pred, "score", "Class"))


def _facts_sql(kind: str) -> str:
    return _TRAIN_SQL + f""" SELECT '{kind}' AS model, CAST(sum(round(0.2 * n)) AS BIGINT) AS validation_rows,
          1 AS auc_passes, 1 AS beats_chance_loss FROM (SELECT count(*) AS n FROM tr GROUP BY "Class")"""


def _facts(metrics, split, kind):
    """What must hold of any training run: the size of the validation part, the
    gate (AUC >= 0.85) and a loss below that of always answering one half."""
    rows = split.filter("is_validation = 1").agg(F.count(F.lit(1)).alias("validation_rows"))
    return with_scalars(rows, metrics).select(
        F.lit(kind).alias("model"), "validation_rows", (F.col("val_auc") >= K.AUC_GATE).cast("int").alias("auc_passes"),
        (F.col("val_loss") < math.log(2)).cast("int").alias("beats_chance_loss"))


@register("ml7_train_classifier", _facts_sql("mlp"))
def ml7(spark, sf):
    """Relu network 5-16-8-1 with class weights and early stopping on the 80 % split,
    saved and loaded with its scaler, evaluated on the 20 %."""
    split, metrics = _train_and_evaluate(spark, sf, "network")
    return _facts(metrics, split, "mlp")


@register("ml10_quality_gate", _facts_sql("logistic"))
def ml10(spark, sf):
    """Weighted logistic regression; the AUC gate (>= 0.85) must pass, else it raises."""
    split, metrics = _train_and_evaluate(spark, sf, "logistic")
    M.quality_gate(metrics)
    return _facts(metrics, split, "logistic")
