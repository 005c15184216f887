"""Toxicity chain: planted words, out-of-fold chain features, awkward input."""

import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm import corpora
from txlens.llm import toxicity

BAD, WORSE = ["grumblesnot", "Blatherskite"], ["vexnard!!"]


def corpus(n=500, seed=6):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = corpora.sentence(rng, rng.randint(5, 60)).split()
        toxic = rng.random() < 0.3
        severe = toxic and rng.random() < 0.4
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        if severe:
            words.insert(rng.randrange(len(words)), rng.choice(WORSE))
        docs.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, int(toxic), int(severe)))
    return docs, labels


def test_chain(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, corpora.SCHEMA).repartition(4)
    t = spark.createDataFrame(labels, "doc_id long, toxic int, severe int")
    model = toxicity.fit_documents(d, t, {"toxic": F.col("toxic"), "severe": F.col("severe")}, F.col("doc_id") % 4 != 2)
    assert b"vexnard" in model.index and [len(w) for w in model.chain] == [6, 6]
    for c in (0, 1):      # a weight for 1, the own words, the statistics and the earlier categories
        assert [len(w) for w in model.chain[c]] == [1 + len(own) + len(toxicity.NAMES) + c for own in model.words[c]]
    got = {r.doc_id: r.p for r in d.select("doc_id", toxicity.score_udf(model)(F.col("text").cast("binary")).alias("p")).collect()}
    held = [x for x in labels if x[0] % 4 == 2]
    assert np.mean([(got[i][0] >= 0.5) == y for i, y, _ in held]) > 0.97
    assert np.mean([(got[i][1] >= 0.5) == z for i, _, z in held]) > 0.97


def test_left_out_models_do_not_see_their_fold(spark):
    """A fold whose labels are flipped changes the other models, not its own: neither
    its words nor its weights."""
    docs, labels = corpus(200)
    rows = [(bytearray(t.encode()), i % 5, [y]) for (i, t, *_), (_, y, _) in zip(docs, labels)]
    flip = [(t, f, [1 - y[0]] if f == 3 else y) for t, f, y in rows]
    fits = []
    for data in (rows, flip):
        fits.append(toxicity.fit(spark.createDataFrame(data, "text binary, fold int, y array<int>").repartition(2), ["toxic"]))
    named = [{w: i for i, w in f.index.items()} for f in fits]
    words = [[[n[i] for i in own] for own in f.words[0]] for f, n in zip(fits, named)]
    assert words[0][3] == words[1][3] and words[0][0] != words[1][0]
    np.testing.assert_allclose(fits[0].chain[0][3], fits[1].chain[0][3], atol=1e-4)


def brute_chain(rows, categories, folds=toxicity.FOLDS):
    """The chain with plain lists: words by G^2, ridge logistic regression by many
    gradient-free Newton steps on whole matrices; probabilities of each row."""
    from math import log

    def g2(a, b, pos, neg):
        n = pos + neg
        cells = [(a, a + b, pos), (b, a + b, neg), (pos - a, n - a - b, pos), (neg - b, n - a - b, neg)]
        return sum(x * log(x * n / (r * c)) for x, r, c in cells if x > 0)

    sets = [toxicity.terms_of(bytes(t)) for t, _, _ in rows]
    stats = np.array([np.float32(toxicity.describe(bytes(t))) for t, _, _ in rows], "float64")
    var = (stats ** 2).mean(axis=0) - stats.mean(axis=0) ** 2
    z = np.clip((stats - stats.mean(axis=0)) / np.sqrt(np.where(var > 1e-6, var, 1.0)), -8, 8)
    fold = np.array([f for _, f, _ in rows])
    held, full = np.zeros((len(rows), 0)), np.zeros((len(rows), 0))
    for c in range(categories):
        y = np.array([v[c] for _, _, v in rows], float)
        out, own = np.zeros(len(rows)), None
        for k in range(folds + 1):
            at = fold != k
            pos, neg = y[at].sum(), (1 - y[at]).sum()
            gains = []
            for w in set().union(*sets):
                has = np.array([w in s for s in sets])
                a, b = (has & at & (y == 1)).sum(), (has & at & (y == 0)).sum()
                if a + b >= toxicity.MIN_TEXTS:
                    gains.append((-g2(a, b, pos, neg), w))
            terms = [w for _, w in sorted(gains, key=lambda g: (round(g[0], 9), g[1]))[:toxicity.TERMS]]
            base = np.column_stack([np.ones(len(rows)), *[[w in s for s in sets] for w in terms], z])
            x = np.column_stack([base, held])
            beta, ridge = np.zeros(x.shape[1]), np.r_[1e-3, np.ones(x.shape[1] - 1)]
            for _ in range(60):
                p = 1 / (1 + np.exp(-x[at] @ beta))
                step = np.linalg.solve((x[at] * (p * (1 - p))[:, None]).T @ x[at] + np.diag(ridge), x[at].T @ (y[at] - p) - ridge * beta)
                beta += step * min(1, 5 / max(np.abs(step).max(), 1e-12))
            if k < folds:
                out[fold == k] = 1 / (1 + np.exp(-x[fold == k] @ beta))
            else:
                own = 1 / (1 + np.exp(-np.column_stack([base, full]) @ beta))
        held, full = np.column_stack([held, out]), np.column_stack([full, own])
    return full


def test_chain_against_plain_matrices(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 40)
    monkeypatch.setattr(toxicity, "TERMS", 6)
    docs, labels = corpus(150, seed=9)
    rows = [(bytearray(t.encode()), (i * 7) % 5, [y, v]) for (i, t, *_), (_, y, v) in zip(docs, labels)]
    data = spark.createDataFrame(rows, "text binary, fold int, y array<int>").repartition(3)
    model = toxicity.fit(data, ["toxic", "severe"], terms=6)
    got = data.select("text", toxicity.score_udf(model)("text").alias("p")).collect()
    want = {bytes(t): p for (t, _, _), p in zip(rows, brute_chain(rows, 2))}
    for r in got:
        assert np.allclose(r.p, want[bytes(r.text)], atol=2e-3)


def test_sample_is_bounded_and_deterministic(spark):
    _, labels = corpus(300)
    extra = [(1, 0, 0), (1, 1, 0), (None, 1, 0), (2, None, 0), (3, 7, 0)]
    t = spark.createDataFrame(labels + extra, "doc_id long, toxic int, severe int")
    pick = lambda df: sorted(r.doc_id for r in toxicity.labelled_sample(df, {"t": F.col("toxic")}, None, 50).collect())
    assert len(pick(t)) == 50 and pick(t) == pick(t.repartition(7))
    assert len(toxicity.labelled_sample(t, {"t": F.col("toxic")}, None, 1000).filter("doc_id = 1").collect()) == 0


def test_awkward_and_empty(spark):
    docs, none = corpora.clashing(spark), spark.createDataFrame([], "doc_id long, toxic int")
    for labels in (none, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")):
        model = toxicity.fit_documents(docs, labels, {"toxic": F.col("toxic")})
        p = [r.p for r in docs.select(toxicity.score_udf(model)(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("p")).collect()]
        assert len(p) == docs.count() and all(0 <= x[0] <= 1 for x in p)
    model = toxicity.fit_documents(corpora.empty(spark), none, {"toxic": F.col("toxic")})
    assert corpora.empty(spark).select(toxicity.score_udf(model)(F.col("text").cast("binary"))).count() == 0
