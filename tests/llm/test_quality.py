"""Quality classifier: discriminant against a direct computation, held-out accuracy."""

import numpy as np

from tests.conftest import SF01
from tests.llm import corpora
from txlens.llm import quality
from txlens.llm.statistics import NAMES, describe


def labelled(n=400, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        y = int(rng.random() < 0.7)
        words = [("w%d" % rng.integers(0, 500 if y else 8)) for _ in range(rng.integers(3, 120))]
        out.append((i, (" " if y else "*** ").join(words), y))
    return out


def test_describe_is_finite_for_any_text():
    for t in corpora.texts():
        x = describe((t or "").encode())
        assert len(x) == len(NAMES) and np.isfinite(x).all()


def test_gaussians_match_direct_densities(spark):
    data = labelled()
    x = np.array([describe(t.encode()) for _, t, _ in data])
    y = np.array([q for _, _, q in data])
    rows = spark.createDataFrame([(v.tolist(), int(q), i % 5) for i, (v, q) in enumerate(zip(x, y))],
                                 "x array<double>, label int, fold int").repartition(4)
    folds = quality.gather_moments(rows)
    assert sum(m.n.sum() for m in folds) == len(data)
    total = quality.Moments(*(sum(getattr(m, k) for m in folds) for k in ("n", "s", "q")))
    centre, scale = total.scaling()
    z = (x - centre) / scale
    pooled, ridge = 0.3, 0.01
    covs = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    shared = sum((y == k).mean() * covs[k] for k in (0, 1))
    for k, g in enumerate(total.gaussians(centre, scale, pooled, ridge)):
        cov = (1 - pooled) * covs[k] + pooled * shared
        cov = (1 - ridge) * cov + (ridge * max(np.trace(cov) / len(NAMES), 1e-3) + 1e-9) * np.eye(len(NAMES))
        d = z - z[y == k].mean(axis=0)
        want = (np.log((y == k).mean()) - 0.5 * np.linalg.slogdet(cov)[1]
                - 0.5 * np.einsum("ij,ij->i", d, np.linalg.solve(cov, d.T).T))
        np.testing.assert_allclose(g.log_density(z), want, rtol=1e-6, atol=1e-6)


def test_held_out_accuracy_on_the_table(spark):
    import __spark_entry__ as entry
    got = entry.queries()["op1_quality_classifier"](spark, SF01).toPandas()
    labels = spark.read.parquet(f"{SF01}/labels.parquet").toPandas().set_index("doc_id").quality
    assert len(got) == spark.read.parquet(f"{SF01}/documents.parquet").count()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    held = got[got.held_out & got.doc_id.isin(labels.index)]
    assert (held.predicted == held.doc_id.map(labels)).mean() > 0.95


def test_awkward_documents_and_labels(spark):
    docs = corpora.clashing(spark)
    good = [(1000 + i, t, "en", "s", 1, *[None] * 14) for i, t, q in labelled()]
    docs = docs.unionByName(spark.createDataFrame(good, corpora.CLASHING))
    labels = spark.createDataFrame([(1000 + i, q, 0) for i, _, q in labelled()]
                                   + [(1001, 0, 0), (1001, 1, 0), (None, 1, 0), (1002, None, 0), (5, 9, 0), (1003, labelled()[3][2], 1)],
                                   "doc_id long, quality int, toxic int")
    model = quality.fit_documents(docs, labels)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    truth = {1000 + i for i, _, q in labelled() if q}
    assert len(truth & ids) > 0.9 * len(truth) and not {1000 + i for i, _, q in labelled() if not q} & ids


def test_without_two_classes_and_empty(spark):
    docs = corpora.documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit_documents(docs, none)
    assert model.classes is None and model.score(np.zeros((2, len(NAMES)))).tolist() == [0.5, 0.5]
    one = quality.fit_documents(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int"))
    assert 0.7 < one.score(np.zeros((1, len(NAMES))))[0] < 1
    assert quality.keep_good(corpora.empty(spark), model).count() == 0
    assert quality.fit_documents(corpora.empty(spark), none).classes is None
