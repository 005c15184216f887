"""Exact AUC, metrics, quality gate, network scoring, global ordering helpers."""

import random

import pytest
from pyspark.sql import functions as F

from txlens.operators import ml as M
from txlens.operators.ordering import global_position, prefix_sums


def brute_auc(pairs):
    pos = [s for s, y in pairs if y == 1]
    neg = [s for s, y in pairs if y == 0]
    wins = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def test_exact_auc_with_ties(spark):
    rnd = random.Random(5)
    pairs = [(round(rnd.random(), 1), rnd.randint(0, 1)) for _ in range(300)]
    df = spark.createDataFrame(pairs, "score double, Class int")
    assert M.exact_auc(df).first().auc == pytest.approx(brute_auc(pairs), abs=1e-12)


def test_evaluate_and_gate(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.3, 0), (0.6, 0)], "score double, Class int")
    m = M.evaluate(df).first()
    assert m.val_auc == pytest.approx(1.0) and m.val_accuracy == pytest.approx(0.75)
    assert M.quality_gate(M.evaluate(df)) == pytest.approx(1.0)
    bad = spark.createDataFrame([(0.1, 1), (0.9, 0)], "score double, Class int")
    with pytest.raises(M.QualityGateError):
        M.quality_gate(M.evaluate(bad))


def test_score_model_fallback_and_network(spark):
    df = spark.createDataFrame([(100.0, 3.0, 0.2, 0.4, 1.0)],
                               "amount double, hour double, device_risk double, location_risk double, txn_velocity double")
    from txlens.functions.rules import heuristic_score
    assert M.score_model(df).first().fraud_probability == pytest.approx(
        df.select(heuristic_score().alias("h")).first().h)
    scaler = spark.createDataFrame([(["a"] * 5, [0.0] * 5, [1.0, 0.0, 1.0, 1.0, 1.0])],
                                   "feature_names array<string>, mean array<double>, scale array<double>")
    layers = [([[1.0]] * 5, [0.0], "sigmoid")]
    import math
    x = [math.log1p(100.0), 3.0, 0.2, 0.4, 1.0]
    expect = 1 / (1 + math.exp(-sum(x)))
    assert M.score_model(df, scaler, layers).first().fraud_probability == pytest.approx(expect)


def test_spark_mlp_weights_as_columns(spark):
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    rnd = random.Random(2)
    rows = [(rnd.random(), rnd.random(), 1 if rnd.random() > 0.5 else 0) for _ in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, y int").withColumn("y", F.col("y").cast("double"))
    vec = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(df)
    model = MultilayerPerceptronClassifier(layers=[2, 3, 2], seed=1, maxIter=20, featuresCol="x", labelCol="y").fit(vec)
    p_model = [r.p for r in model.transform(vec).select(vector_to_array("probability")[1].alias("p")).collect()]
    p_cols = [r.p for r in df.select(M.dense_network([F.col("a"), F.col("b")],
                                                     M.layers_from_spark_mlp(model)).alias("p")).collect()]
    assert p_cols == pytest.approx(p_model, abs=1e-9)


def test_card_features_requires_columns(spark):
    with pytest.raises(ValueError):
        M.card_features(spark.createDataFrame([(1.0,)], "Time double"))


def test_global_position_and_prefix_sums(spark):
    rnd = random.Random(9)
    rows = [(rnd.randint(0, 50), i, float(rnd.randint(0, 9))) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, id int, v double")
    pos = {r.id: r.pos for r in global_position(df, [F.col("k"), F.col("id")], "pos", partitions=7).collect()}
    ordered = sorted(rows, key=lambda r: (r[0], r[1]))
    assert pos == {r[1]: i + 1 for i, r in enumerate(ordered)}
    cum = {r.id: r.v_cum for r in prefix_sums(df, [F.col("k"), F.col("id")], ["v"], partitions=5).collect()}
    run, expect = 0.0, {}
    for r in ordered:
        run += r[2]
        expect[r[1]] = run
    assert cum == expect



def test_network_gradient_is_the_derivative():
    import numpy as np
    rng = np.random.default_rng(3)
    sizes, n = [3, 4, 2, 1], 30
    x, y, w = rng.normal(size=(n, 3)), rng.integers(0, 2, n).astype(float), rng.uniform(0.1, 9, n)
    theta = rng.normal(size=3 * 4 + 4 + 4 * 2 + 2 + 2 + 1)

    def loss(t):
        z = M._forward(x, M._unpack(t, sizes))[-1][:, 0]
        return (w * (np.logaddexp(0, z) - y * z)).sum()

    got = M.network_gradient(x, y, w, theta, sizes)
    want = [(loss(theta + e) - loss(theta - e)) / 2e-6 for e in np.eye(len(theta)) * 1e-6]
    assert got[:-1] == pytest.approx(want, rel=1e-4, abs=1e-5) and got[-1] == pytest.approx(w.sum())


def test_network_learns_a_rare_class_without_copies(spark, tmp_dir, monkeypatch):
    """One positive in 500: weights, not copies; early stop; any partitioning; the
    stored model scores through the column expressions."""
    import random
    rnd = random.Random(2)
    rows = []
    for i in range(6000):
        x = [rnd.gauss(0, 1) for _ in range(5)]
        y = 1 if i % 500 == 0 else 0
        rows.append((*([v + 2.5 * y * (j < 2) for j, v in enumerate(x)]), y))
    names = ["amount", "hour", "device_risk", "location_risk", "txn_velocity"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names) + ", Class int")
    seen = []
    fit = M.train_network

    def watched(train, *args, **kwargs):
        seen.append(train.count())
        return fit(train, *args, epochs=6, slices=4, **kwargs)

    monkeypatch.setattr(M, "train_network", watched)
    model, scaler = M.train_classifier(df)
    assert seen == [6000] and 1 <= len(model.history) <= 6
    other, _ = M.train_classifier(df.repartition(9))
    flat = lambda m: [v for w, b, _ in m.layers for v in [*sum(w, []), *b]]
    assert flat(other) == pytest.approx(flat(model), rel=1e-6, abs=1e-9)
    M.save_model(model, scaler, f"{tmp_dir}/m")
    loaded, stored = M.load_model(spark, f"{tmp_dir}/m")
    assert flat(loaded) == flat(model) and [a for _, _, a in loaded.layers] == ["relu", "relu", "sigmoid"]
    metrics = M.evaluate(M.predict(loaded, df, stored)).first()
    assert metrics.val_auc >= 0.85
    assert metrics.val_auc == pytest.approx(max(model.history), abs=2e-3)
    scored = M.score_model(df.withColumn("amount", F.lit(1.0)), stored, loaded.layers)
    assert scored.filter("fraud_probability BETWEEN 0 AND 1").count() == 6000


def test_network_stops_early(spark, monkeypatch):
    """No better AUC for three epochs ends the training; the best weights stay."""
    aucs = iter([0.6, 0.9, 0.7, 0.8, 0.85, 0.99])
    weights = []
    monkeypatch.setattr(M, "_binned_auc", lambda rows, theta, sizes: weights.append(theta) or next(aucs))
    df = spark.createDataFrame([(float(i % 7), float(i % 2), 1.0) for i in range(40)], "x double, y double, w double")
    model = M.train_network(df, df, ["x"], "y", "w", hidden=[2], slices=2)
    assert model.history == [0.6, 0.9, 0.7, 0.8, 0.85]
    assert [w for w, _, _ in model.layers][0] == M._unpack(weights[1], [1, 2, 1])[0][0].tolist()


def test_a_training_step_reads_its_own_part_only(spark, monkeypatch):
    """The rows are packed once into blocks by part: a step's Python gets its part's rows, no others,
    and the model is that of plain sums over the rows."""
    import numpy as np

    from txlens.operators import ml as M
    from txlens.operators.vector_sums import block_rows, row_blocks
    df = spark.range(5000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("y"),
                                  (F.col("id") % 4).cast("int").alias("slice")).repartition(3)
    blocks = row_blocks(df, 2, 4).persist()
    assert blocks.count() <= 3 * 4
    for part in range(4):
        rows = np.vstack(list(block_rows(blocks.filter(F.col("part") == part).toArrow().to_batches(), 2)))
        assert sorted(rows[:, 0].astype(int)) == list(range(part, 5000, 4))
        assert (rows[:, 0] % 3 == rows[:, 1]).all()
    blocks.unpersist()
    sent = []
    real = M.sum_vectors
    monkeypatch.setattr(M, "sum_vectors", lambda rows, *a: (sent.append(rows.columns), real(rows, *a))[1])
    train = spark.range(300).select((F.col("id") / 300).alias("x"), (F.col("id") > 150).cast("int").alias("y"), F.lit(1.0).alias("w"))
    one, more = (M.train_network(train.repartition(n), train, ["x"], "y", "w", hidden=[3], slices=2) for n in (1, 5))
    assert sent and all(c == ["part", "block"] for c in sent)
    for (w, b, _), (v, c, _) in zip(one.layers, more.layers):
        assert np.allclose(w, v) and np.allclose(b, c)
    with pytest.raises(Exception, match="NULL in a label"):
        M.train_network(train.withColumn("y", F.lit(None).cast("int")), train, ["x"], "y", "w", hidden=[2], slices=2)
