"""Merge table: equals the plain upsert, rewrites touched buckets only, survives crashes."""

import random
import shutil

import pytest

from tests.test_snapshots import Crash, crashing
from txlens.operators.ledger import update_rows, upsert
from txlens.sources.merge_table import MergeTable, create_merge_table
from txlens.sources.snapshots import ConcurrentCommitError, SnapshotLog

SCHEMA = "k long, v string, w int"
DEFAULTS = {"v": "new", "w": 0}


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def commits(spark, path):
    return dict(SnapshotLog(spark, path).state().partitions)


def test_merges_equal_upserts(spark, tmp_dir):
    rnd = random.Random(5)
    want = frame(spark, [(k, f"v{k}", k) for k in range(60)] + [(None, "none", 1)])
    create_merge_table(want, f"{tmp_dir}/t", "k", buckets=8)
    for step in range(4):
        keys = rnd.sample(range(100), 25) + ([None] if step == 1 else [])
        batch = frame(spark, [(k, rnd.choice([None, f"s{step}"])) for k in keys], "k int, v string")   # narrower key type
        want = frame(spark, upsert(want, batch.selectExpr("cast(k AS long) AS k", "v"), "k", DEFAULTS).collect())
        MergeTable(spark, f"{tmp_dir}/t", compact_every=2).merge(batch.selectExpr("v", "k", "1 AS other"), DEFAULTS)
        assert rows_of(MergeTable(spark, f"{tmp_dir}/t").read()) == rows_of(want)
    assert MergeTable(spark, f"{tmp_dir}/t").read().columns == ["k", "v", "w"]
    assert MergeTable(spark, f"{tmp_dir}/t").merge(frame(spark, [])) == []


def test_empty_table_takes_rows(spark, tmp_dir):
    create_merge_table(frame(spark, []), f"{tmp_dir}/t", "k", buckets=4)
    MergeTable(spark, f"{tmp_dir}/t").merge(frame(spark, [(1, None, None)]), DEFAULTS)
    assert rows_of(MergeTable(spark, f"{tmp_dir}/t").read()) == [(1, "new", 0)]
    with pytest.raises(ValueError, match="holds a table"):
        create_merge_table(frame(spark, []), f"{tmp_dir}/t", "k")


def test_only_touched_buckets_are_rewritten(spark, tmp_dir):
    create_merge_table(frame(spark, [(k, "old", k) for k in range(2000)]), f"{tmp_dir}/t", "k", buckets=64)
    before = commits(spark, f"{tmp_dir}/t")
    written = MergeTable(spark, f"{tmp_dir}/t").merge(frame(spark, [(k, "x", None) for k in range(0, 2000, 400)]))
    after = commits(spark, f"{tmp_dir}/t")
    assert len(before) == 64 and 1 <= len(written) <= 5
    assert {p for p in after if after[p] != before[p]} == set(written)
    got = {r.k: (r.v, r.w) for r in MergeTable(spark, f"{tmp_dir}/t").read().collect()}
    assert got == {k: ("old" if k % 400 else "x", k) for k in range(2000)}


def test_small_batch_does_not_shuffle_the_rows(spark, tmp_dir):
    create_merge_table(frame(spark, [(k, "old", k) for k in range(200)]), f"{tmp_dir}/t", "k", buckets=4)
    frame(spark, [(1, "x", 1)]).write.parquet(f"{tmp_dir}/batch")
    joined = update_rows(MergeTable(spark, f"{tmp_dir}/t").read(), spark.read.parquet(f"{tmp_dir}/batch"), "k")
    plan = joined._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_replay_crash_and_repeated_key(spark, tmp_dir, monkeypatch):
    start = [(k, "old", k) for k in range(20)]
    create_merge_table(frame(spark, start), f"{tmp_dir}/start", "k", buckets=4)
    MergeTable(spark, f"{tmp_dir}/start").merge(frame(spark, [(1, "one", None)]), stream="s", batch_id=0)
    MergeTable(spark, f"{tmp_dir}/start").merge(frame(spark, [(1, "again", None)]), stream="s", batch_id=0)  # replay
    old = rows_of(MergeTable(spark, f"{tmp_dir}/start").read())
    assert (1, "one", 1) in old
    with pytest.raises(Exception, match="k repeated in the batch: 3"):
        MergeTable(spark, f"{tmp_dir}/start").merge(frame(spark, [(3, "a", 1), (3, "b", 1)]))
    assert rows_of(MergeTable(spark, f"{tmp_dir}/start").read()) == old
    batch = frame(spark, [(2, "two", None), (30, None, None)])
    new = rows_of(upsert(frame(spark, old), batch, "k", DEFAULTS))
    at = 0
    while True:
        path = f"{tmp_dir}/{at}"
        shutil.copytree(f"{tmp_dir}/start", path)
        with monkeypatch.context() as m:
            crashing(m, at)
            try:
                MergeTable(spark, path).merge(batch, DEFAULTS, "s", 1)
                crashed = False
            except Crash:
                crashed = True
        assert rows_of(MergeTable(spark, path).read()) in (old, new)
        MergeTable(spark, path).merge(batch, DEFAULTS, "s", 1)
        assert rows_of(MergeTable(spark, path).read()) == new
        if not crashed:
            assert at >= 3
            return
        at += 1


def test_two_writers(spark, tmp_dir):
    create_merge_table(frame(spark, [(1, "a", 1)]), f"{tmp_dir}/t", "k", buckets=2)
    slow = MergeTable(spark, f"{tmp_dir}/t")
    commit = slow.log.begin("slow", 0)
    written = slow.log.write(slow._rows(slow.log.paths(slow.log.state())), commit, ["key_bucket"])
    MergeTable(spark, f"{tmp_dir}/t").merge(frame(spark, [(1, "b", 2)]), stream="fast")
    with pytest.raises(ConcurrentCommitError):
        slow.log.commit(commit, "slow", 0, written, [])
    assert rows_of(MergeTable(spark, f"{tmp_dir}/t").read()) == [(1, "b", 2)]
