"""Importance resampling against zlib and a direct computation."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF001
from tests.llm import corpora
from txlens.llm import importance
from txlens.llm.importance import SpanCrc

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


@settings(deadline=None, max_examples=150)
@given(st.binary(min_size=1, max_size=3000), st.lists(st.tuples(st.integers(0, 2999), st.integers(1, 3000)), max_size=30),
       st.sampled_from([1, 3, 64]))
def test_span_crc_is_crc32(data, spans, reach):
    spans = [(a % len(data), min(n, len(data) - a % len(data))) for a, n in spans]
    got = SpanCrc(reach)(np.frombuffer(data, "u1"), np.array([a for a, _ in spans], "int64"),
                         np.array([n for _, n in spans], "int64"))
    assert got.tolist() == [zlib.crc32(data[a:a + n]) for a, n in spans]


def features(text, n=2):
    w = WORD.findall((text or "").translate(FOLD))
    return len(w), [" ".join(w[i:i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize("piece", [1 << 20, 50, 1])
@pytest.mark.parametrize("n", [1, 2, 3])
def test_buckets_of_texts(monkeypatch, piece, n):
    monkeypatch.setattr(importance, "PIECE", piece)
    monkeypatch.setattr(importance.pieces, "__defaults__", (piece,))
    texts = [t or "" for t in corpora.texts(n=20) if len(t or "") < 5000] + ["a" * 300 + " b " + "ß" * 200, "  .. ", "One-word"]
    got = list(importance.bucket_numbers([t.encode() for t in texts], n, 997, SpanCrc(16)))
    for t, (words, buckets) in zip(texts, got):
        count, runs = features(t, n)
        assert words == count and sorted(buckets.tolist()) == sorted(zlib.crc32(f.encode()) % 997 for f in runs)


def brute(docs, target, n_buckets=10_000, min_words=20, percent=25, seed=7):
    def counts(texts):
        out = np.zeros(n_buckets, "int64")
        for t in texts:
            for f in features(t)[1]:
                out[zlib.crc32(f.encode()) % n_buckets] += 1
        return out

    s, t = counts(x[1] for x in docs), counts(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + n_buckets) / ((s[b] + 1) * (t.sum() + n_buckets))))
            for b in range(n_buckets)]
    rows = []
    for doc_id, text, *_ in docs:
        words, runs = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % n_buckets] for f in runs) // len(runs) if runs else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(runs), weight, score, None, words])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[:len(able) * percent // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def scored(spark, rows, target, **options):
    docs = spark.createDataFrame(rows, corpora.SCHEMA).repartition(3)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.score_documents(docs, goal, **options)
    return sorted((tuple(r) for r in got.select("doc_id", "draw.n_features", "draw.weight", "draw.score", "draw.rank").collect()),
                  key=repr)


def test_scores_and_ranks(spark):
    # rows of one id get one Gumbel number; here they never tie across different texts
    rows = [(i, *r[1:]) for i, r in enumerate(corpora.rows(n=120))] + [(None, "no id at all", None, None, 0)]
    target = [corpora.texts()[3], None, "", corpora.texts()[9]]
    assert scored(spark, rows, target) == brute(rows, target)
    assert scored(spark, rows, [], percent=100, min_words=0) == brute(rows, [], percent=100, min_words=0)


def test_repeated_rows_are_drawn_one_by_one(spark):
    rows = [(1, "same words " * 20, "en", "s", 1)] * 8
    got = scored(spark, rows, ["same"], percent=50)
    assert sorted(r[4] for r in got if r[4]) == [1, 2, 3, 4] and len(got) == 8


def test_resample_keeps_columns(spark):
    docs = corpora.clashing(spark).withColumnsRenamed({"leak": "draw", "digest": "__x", "state": "__row", "fp": "__position"})
    goal = spark.createDataFrame([(corpora.texts()[1],)], "text string")
    got = importance.resample(docs, goal, percent=50)
    able = docs.filter("size(split(coalesce(text, ''), ' ')) >= 20").count()
    assert got.columns == docs.columns and able // 3 <= got.count() <= able
    assert importance.resample(corpora.empty(spark), goal).count() == 0
    with_struct = importance.score_documents(docs, goal, keep=docs.columns, into="draw")
    assert with_struct.count() == docs.count() and with_struct.select("draw.rank").schema


def test_query(spark):
    import __spark_entry__ as entry
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    target = [r.text for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    got = entry.queries()["op13_importance_resampling"](spark, SF001)
    assert sorted(map(tuple, got.collect()), key=repr) == brute([tuple(r) for r in docs], target)
