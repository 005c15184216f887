"""Histogram sort: exact boundaries, gapless slots, hot keys."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import corpora
from txlens.llm import sharding


def check_shards(rows, n_shards, spread):
    size, slots = [0] * n_shards, [[] for _ in range(n_shards)]
    for r in rows:
        size[r["shard"]] += len((r["text"] or "").encode()) + 16
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(size) - min(size) <= spread
    return size


def test_bytes_near_equal(spark):
    rows = [(i * i, "x" * (i % 37), "en", "s", 1) for i in range(4000)]
    docs = spark.createDataFrame(rows, corpora.SCHEMA)
    got = sharding.shard_documents(docs, 8).collect()
    assert len(got) == 4000
    check_shards(got, 8, 2 * (36 + 16) + 8)
    by_key = sorted(got, key=lambda r: r.doc_id)
    assert [(r.shard, r.slot) for r in by_key] == sorted((r.shard, r.slot) for r in got)


def test_one_key_holds_a_third(spark):
    rows = [(7, f"copy {i}", "en", "s", 1) for i in range(1000)] + [(i, "y" * 20, "en", "s", 1) for i in range(2000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, corpora.SCHEMA), 6).collect()
    check_shards(got, 6, 2 * 40)


def test_sub_buckets_keep_slots_gapless(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("z"), 50).alias("text"))
    got = sharding.shard_documents(docs, 4, bucket_bytes=3000).collect()
    check_shards(got, 4, 200)
    assert len({(r.shard, r.slot) for r in got}) == 3000


def test_buckets_grow_with_the_input(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MAX_BUCKETS", 8, raising=False)
    docs = spark.range(3000).select((F.col("id") % 2000).alias("doc_id"), F.repeat(F.lit("z"), 50).alias("text"))
    asked, split = [], sharding.splitters
    monkeypatch.setattr(sharding, "splitters", lambda rows, n, tol: asked.append((n, split(rows, n, tol))) or asked[-1][1])
    one = {(r.doc_id, r.shard, r.slot) for r in sharding.shard_documents(docs, 4, bucket_bytes=9000).collect()}
    monkeypatch.setattr(sharding, "GROUP", 6, raising=False)
    got = sharding.shard_documents(docs, 4, bucket_bytes=9000).collect()
    check_shards(got, 4, 400)
    assert [n for n, _ in asked] == [24, 24] and {(r.doc_id, r.shard, r.slot) for r in got} == one
    assert asked[0][1][1] == asked[1][1][1] and asked[1][1][0] == sorted(asked[1][1][0])


def test_awkward_rows_and_clashing_columns(spark):
    docs = corpora.clashing(spark)
    got = sharding.shard_documents(docs, 5)
    rows = got.collect()
    assert set(got.columns) == set(docs.columns) and len(rows) == docs.count()
    assert all(0 <= r.shard < 5 for r in rows)
    for s in range(5):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))


def test_empty_and_single(spark):
    assert sharding.shard_documents(corpora.empty(spark), 40).count() == 0
    one = spark.createDataFrame([(None, None, None, None, None)], corpora.SCHEMA)
    assert [(r.slot,) for r in sharding.shard_documents(one, 40).collect()] == [(0,)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 5), st.integers(-(1 << 63), (1 << 63) - 1)), max_size=40),
       st.lists(st.tuples(st.integers(-5, 5), st.integers(-(1 << 63), (1 << 63) - 1)), max_size=12))
def test_locate_is_lexicographic(rows, probes):
    probes = sorted(set(probes))
    got = sharding.locate(np.array([r[0] for r in rows], "int64"), np.array([r[1] for r in rows], "int64"),
                          np.array([p[0] for p in probes], "int64"), np.array([p[1] for p in probes], "int64"))
    assert got.tolist() == [sum(p <= r for p in probes) for r in rows]


@pytest.mark.parametrize("n", [2, 7])
def test_splitters_are_exact(spark, n):
    keys = [(i * 977) % 10_007 for i in range(3000)]
    table = spark.createDataFrame([(k, zlib.crc32(str(k).encode()), 17 + k % 50) for k in keys], "key long, tie long, size long")
    cut, below, rounds = sharding.splitters(table, n, 0.01)
    total = sum(17 + k % 50 for k in keys)
    places = [sharding._pack(k, zlib.crc32(str(k).encode())) for k in keys]
    for i, (c, rows) in enumerate(zip(cut, below)):
        under = [k for k, p in zip(keys, places) if p < c]
        assert len(under) == rows
        assert abs(sum(17 + k % 50 for k in under) - total * (i + 1) / n) <= max(0.01 * total / n, 70)
    assert 1 <= rounds <= 4


def test_equal_rows_keep_the_law(spark):
    """A third of all rows equal in every column: shards stay near equal in bytes."""
    rows = [(7, "the very same row", "en", "s", 3)] * 1000 + [(i * 3, "another row " + "x" * (i % 9), "en", "s", 1) for i in range(2000)]
    docs = spark.createDataFrame(rows, corpora.SCHEMA).repartition(3)
    got = sharding.shard_documents(docs, 6)
    assert got.columns == docs.columns + ["shard", "slot"]
    out = got.withColumn("size", sharding.row_size()).collect()
    size = [sum(r["size"] for r in out if r.shard == k) for k in range(6)]
    assert max(size) - min(size) <= 2 * 45 and len(out) == 3000          # a row is at most 37 bytes
    for k in range(6):
        assert sorted(r.slot for r in out if r.shard == k) == list(range(sum(r.shard == k for r in out)))


def test_nested_maps(spark):
    from pyspark.sql import functions as F

    from txlens.llm import exact_dedup, simhash
    docs = corpora.documents(spark, n=10).withColumn("m", F.struct(F.create_map(F.lit("a"), F.col("doc_id")).alias("in"))).withColumn(
        "n", F.array(F.create_map(F.lit(1), F.lit("x"))))
    assert sharding.shard_documents(docs, 3).count() == docs.count()
    assert exact_dedup.deduplicate(docs).columns == docs.columns
    assert simhash.keep_one(docs, shingle=4, max_distance=4).columns == docs.columns
