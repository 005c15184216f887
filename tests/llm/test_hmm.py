"""HMM language model: forward recursion and Baum-Welch counts by enumeration,
unigram base by direct counting, probabilities that add up."""

import itertools
import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF01
from tests.llm import corpora
from txlens.llm import hmm


def tiny_chain(k=3, classes=hmm.CLASSES, seed=5):
    rng = np.random.default_rng(seed)
    norm = lambda a, ax: a / a.sum(axis=ax, keepdims=True)
    return hmm.Chain(norm(rng.random(k), 0), norm(rng.random((k, k)), 1),
                     norm(rng.random((classes, k)), 0))


def paths(seq, chain, start):
    """Probability of each state path."""
    for path in itertools.product(range(len(chain.start)), repeat=len(seq)):
        p = start[path[0]] * chain.emit[seq[0], path[0]]
        for t in range(1, len(seq)):
            p *= chain.move[path[t - 1], path[t]] * chain.emit[seq[t], path[t]]
        yield path, p


def test_forward_is_the_sum_over_paths():
    chain = tiny_chain()
    seqs = [np.array(s, "<i2") for s in ([3, 7, 9, hmm.END], [hmm.END], [1, 1, hmm.END], [5, 2, 8, 8, 1, hmm.END])]
    want = [math.log10(sum(p for _, p in paths(s, chain, chain.start))) for s in seqs]
    np.testing.assert_allclose(hmm.forward_log10(seqs, chain), want, rtol=1e-10)
    assert len(hmm.forward_log10([], chain)) == 0


def test_forward_survives_long_texts():
    chain = tiny_chain()
    long = np.append(np.tile(np.arange(50), 1000), hmm.END).astype("<i2")
    assert np.isfinite(hmm.forward_log10([long, long[-3:]], chain)).all()


def test_expected_counts_match_enumeration():
    chain = tiny_chain()
    k = len(chain.start)
    texts = [np.array(x, "<i2") for x in ([4, 6, hmm.END], [hmm.END], [9, 4, 2, 4, hmm.END], [1, hmm.END])]
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros_like(chain.emit)
    for seq in texts:
        all_paths = list(paths(seq, chain, chain.start))
        z = sum(p for _, p in all_paths)
        for path, p in all_paths:
            start[path[0]] += p / z
            for t, s in enumerate(path):
                emit[seq[t], s] += p / z
                if t:
                    move[path[t - 1], s] += p / z
    for group in (1 << 20, 4, 1):            # forward values of all steps, or of few at a time
        got = hmm.expected_counts(texts, chain, group)
        np.testing.assert_allclose(got, np.concatenate([start, move.ravel(), emit.ravel()]), atol=1e-10)
    assert not hmm.expected_counts([], chain).any()


def test_training_raises_the_likelihood(spark):
    rng = np.random.default_rng(0)
    texts = [np.append(rng.integers(0, 20, 60) + 20 * (i % 2), hmm.END).astype("<i2") for i in range(80)]
    rows = spark.createDataFrame([(bytearray(t.tobytes()),) for t in texts], "classes binary").repartition(3)
    share = np.bincount(np.concatenate(texts), minlength=hmm.CLASSES) + 1.0
    share /= share.sum()
    got = [hmm.forward_log10(texts, hmm.train_chain(rows, share, states=2, rounds=r)).sum() for r in (0, 2, 6)]
    assert got[0] < got[1] < got[2]
    chain = hmm.train_chain(rows, share, states=2, rounds=2)
    for total in (chain.start.sum(), *chain.move.sum(axis=1), *chain.emit.sum(axis=0)):
        assert total == pytest.approx(1)


def brute_base(rows, trained):
    count, n = Counter(), 0
    split = lambda t: [*(t or "").encode().lower().split(), None]
    for doc_id, text in rows:
        if trained(doc_id):
            count.update(split(text))
    n, v = sum(count.values()), len(count)
    return n, {(i, t): (len(split(t)), sum(count[w] > 0 for w in split(t)),
                        sum(math.log10((count[w] + 1) / (n + v + 1)) for w in split(t))) for i, t in rows}


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(hmm, "HEAVY", 40)          # most words are rare here
    monkeypatch.setattr(hmm, "FLUSH", 100)
    rows = [(r[0], r[1]) for r in corpora.rows()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    held = lambda i: i is not None and crc32(str(i).encode()) % 7 == 2
    trainable = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2, F.lit(True))
    got = hmm.score_documents(docs, trainable, rounds=2).collect()
    n, want = brute_base(rows, lambda i: not held(i))
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {n}
    by_id = {}
    for (i, t), w in want.items():
        by_id.setdefault(i, set()).add((w[0], w[1], round(w[2], 6)))
    for r in got:
        assert (r.n_tokens, r.n_known, round(r.base_score, 6)) in by_id[r.doc_id]
        assert r.score < 0 and r.trained != held(r.doc_id)


def test_scores_do_not_depend_on_partitions_and_follow_the_model(spark, monkeypatch):
    """The same scores for 1, 3 and 7 partitions; each is the chain's forward
    probability of the classes times each word's share of its class."""
    monkeypatch.setattr(hmm, "HEAVY", 60)
    monkeypatch.setattr(hmm, "GROUP", 3000)
    monkeypatch.setattr(hmm, "TOGETHER", 9000)
    rows = [(i, t) for i, (_, t, *_) in enumerate(corpora.rows(n=40))]
    trained = {i for i, _ in rows if i % 5}
    chains, train = [], hmm.train_chain
    monkeypatch.setattr(hmm, "train_chain", lambda *a, **k: chains.append(train(*a, **k)) or chains[-1])
    runs = []
    for n in (1, 3, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        runs.append({r.doc_id: r.score for r in hmm.score_documents(docs, F.col("doc_id") % 5 != 0, rounds=3).collect()})
    for other in runs[1:]:
        assert all(abs(other[i] - runs[0][i]) <= 1e-9 * abs(runs[0][i]) for i in runs[0])
    chain, split = chains[0], lambda t: (t or "").encode().lower().split()
    count = Counter(w for i, t in rows if i in trained for w in split(t))
    counts = spark.createDataFrame([(bytearray(w), c) for w, c in count.items()], "word binary, c long")
    own = {bytes(r.word): i for i, r in enumerate(hmm.heavy_words(counts, 60))}
    inside = {}
    for w, c in count.items():
        if w not in own:
            inside.setdefault(hmm.shape_class(w), []).append(c)
    for i, t in rows:
        kinds, log = [], 0.0
        for w in split(t):
            kinds.append(own.get(w, hmm.shape_class(w)))
            if w not in own:
                c = inside.get(kinds[-1], [])
                log += math.log10((count[w] + 1) / (sum(c) + len(c) + 1))
        a = chain.start
        for j, o in enumerate([*kinds, hmm.END]):
            a = (a if j == 0 else a @ chain.move) * chain.emit[o]
            log += math.log10(a.sum())
            a = a / a.sum()
        assert runs[0][i] == pytest.approx(log, rel=1e-9)


def test_long_words_are_not_broadcast(spark):
    rows = spark.createDataFrame([("w" * 500 + " w",)] * 9, "t string").select(F.col("t").cast("binary").alias("text"))
    assert [bytes(r.word) for r in hmm.heavy_words(hmm.word_counts(rows))] == [b"w"]


def test_word_probabilities_add_up(spark, monkeypatch):
    """In a state the classes add up to 1, and in a class its known words and one unknown type do."""
    rows = spark.createDataFrame([("a a b c d d d e",), ("b c f",)], "t string").select(F.col("t").cast("binary").alias("text"))
    monkeypatch.setattr(hmm, "HEAVY", 2)
    counts = hmm.word_counts(rows)
    voc = hmm.build_vocabulary(counts, 2)
    assert set(voc.index) == {b"d"}            # b and c, equally frequent, would exceed the bound
    assert voc.tokens == 13 and voc.types == 7 and voc.class_share.sum() == pytest.approx(1)
    shape = {}
    for r in counts.collect():
        if bytes(r.word) not in voc.index:
            shape.setdefault(hmm.shape_class(bytes(r.word)), []).append(r.c)
    assert sum(map(len, shape.values())) == 5
    for k, c in shape.items():
        assert sum(x + 1 for x in c) + 1 == pytest.approx(10 ** voc.log_class[k])


def test_shape_class_is_the_same_in_both_engines(spark):
    words = [b"a", b"abcd", b"abcdefg", "där".encode(), b"***", b"x!"]
    got = spark.createDataFrame([(bytearray(w),) for w in words], "w binary").select(hmm.shape_class_column(F.col("w")).alias("k")).collect()
    assert [r.k for r in got] == [hmm.shape_class(w) for w in words]


def test_better_than_the_unigram_base_on_held_out_texts(spark):
    import __spark_entry__ as entry
    got = entry.queries()["op5_hmm_language_model"](spark, SF01).filter("held_out").toPandas()
    assert got.score.sum() > got.base_score.sum() + 0.2 * got.n_tokens.sum()


def test_empty_and_untrained(spark):
    assert hmm.score_documents(corpora.empty(spark), F.lit(True), rounds=1).count() == 0
    got = hmm.score_documents(corpora.documents(spark, n=4), F.lit(False), rounds=1).collect()
    assert all(np.isfinite([r.score, r.base_score]).all() and r.train_tokens == 0 and r.n_known == 0 for r in got)
