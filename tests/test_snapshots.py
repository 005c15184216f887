"""Snapshot table and id index: crashes at every file step, readers beside a writer,
lookups that do not grow with the history."""

import shutil

import pandas as pd
import pytest

from tests.test_streaming import _close, batch_frames, hostile_batches, row, table_rows
from txlens.constants import REQUIRED_COLUMNS
from txlens.plans.features import feature_job
from txlens.sources.feed import RAW_SCHEMA, read_features
from txlens.sources.snapshots import ConcurrentCommitError, SnapshotLog
from txlens.streaming import feature_stream as ST
from txlens.streaming.id_index import IdIndex


class Crash(RuntimeError):
    pass


STEPS = ["create", "rename", "delete", "write"]


def crashing(monkeypatch, at):
    """Raise at the at-th file step, before it is done; returns the list of steps."""
    done = []

    def wrap(cls, name):
        real = getattr(cls, name)

        def step(self, *args, **kwargs):
            done.append(name)
            if len(done) - 1 == at:
                raise Crash(name)
            return real(self, *args, **kwargs)
        monkeypatch.setattr(cls, name, step)

    for name in STEPS:
        wrap(SnapshotLog, name)
    wrap(IdIndex, "write")
    return done


def small_batches():
    a = hostile_batches(0)
    return [a[0][:5], a[1][:3], a[2][:3] + [row("q", "b", 41_000)], a[3][:3], a[4][:1]]


def updater(folder):
    return ST.FeatureStreamUpdater(f"{folder}/out", buckets=2, compact_every=2, index_fanout=2, strategy="window")


def wanted(spark, batches):
    rows = [r for b in batches for r in b]
    return table_rows(feature_job(spark.createDataFrame(pd.DataFrame(rows, columns=REQUIRED_COLUMNS), RAW_SCHEMA)))


def test_crash_at_every_step_and_replay(spark, tmp_dir, monkeypatch):
    """The crash hits the fourth batch, which replaces and drops partitions, merges
    index runs, writes a checkpoint and deletes old files."""
    batches = small_batches()[:4]
    frames = dict(batch_frames(spark, batches))
    want_before, want = wanted(spark, batches[:3]), wanted(spark, batches)
    up = updater(f"{tmp_dir}/start")
    for i in range(3):
        up(frames[i], i)
    at = 0
    while True:
        folder = f"{tmp_dir}/{at}"
        shutil.copytree(f"{tmp_dir}/start", folder)
        with monkeypatch.context() as m:
            done = crashing(m, at)
            try:
                updater(folder)(frames[3], 3)
                crashed = False
            except Crash:
                crashed = True
        # a reader sees the batch as a whole or not at all
        committed = SnapshotLog(spark, f"{folder}/out").state().version == 3
        _close(table_rows(ST.current_features(spark, f"{folder}/out")), want if committed else want_before)
        if crashed:
            updater(folder)(frames[3], 3)    # the process starts anew and the batch comes again
            _close(table_rows(ST.current_features(spark, f"{folder}/out")), want)
        else:
            assert committed and {"create", "rename", "delete", "write"} <= set(done) and at >= 6
            return
        at += 1


def test_reader_keeps_its_version(spark, tmp_dir):
    batches = small_batches()
    frames = dict(batch_frames(spark, batches))
    up = updater(tmp_dir)
    up(frames[0], 0)
    before = ST.current_features(spark, f"{tmp_dir}/out")        # opened, not yet read
    up(frames[1], 1)
    assert table_rows(before) == wanted(spark, batches[:1])
    assert read_features(spark, f"{tmp_dir}/out").count() == len(wanted(spark, batches[:2]))


def test_old_files_go(spark, tmp_dir):
    import os
    up = updater(tmp_dir)
    for i in range(6):       # every batch rewrites the same day
        up(next(batch_frames(spark, [[row(f"t{i}", "a", 1000 + i), row(f"u{i}", "b", 2000 + i)]]))[1], i)
    live = SnapshotLog(spark, f"{tmp_dir}/out").state()
    files = [f for d, _, fs in os.walk(f"{tmp_dir}/out/data") for f in fs if f.startswith("part-")]
    assert len(live.partitions) <= 2 and len(files) <= 2 * 3 * 2         # this version and two before it
    assert len(os.listdir(f"{tmp_dir}/out/data")) <= 5
    assert len([f for f in os.listdir(f"{tmp_dir}/out/_log") if f.endswith(".json") and f[0] != "."]) <= 6
    _close(table_rows(ST.current_features(spark, f"{tmp_dir}/out")),
           wanted(spark, [[row(f"t{i}", "a", 1000 + i), row(f"u{i}", "b", 2000 + i)] for i in range(6)]))


def test_two_writers_cannot_commit_one_version(spark, tmp_dir):
    a, b = SnapshotLog(spark, f"{tmp_dir}/t"), SnapshotLog(spark, f"{tmp_dir}/t")
    one, two = a.begin("s1", 0), b.begin("s2", 0)
    df = spark.createDataFrame([(1, "x")], "k int, v string")
    assert a.write(df, one, ["k"]) == ["k=1"] and b.write(df, two, ["k"]) == ["k=1"]
    a.commit(one, "s1", 0, ["k=1"], [])
    with pytest.raises(ConcurrentCommitError):
        b.commit(two, "s2", 0, ["k=1"], [])
    assert SnapshotLog(spark, f"{tmp_dir}/t").state().partitions == {"k=1": one}


def test_index_lookup_does_not_grow_with_the_history(spark, tmp_dir):
    """Ids in time order, some sent again soon after: what a batch opens stays the
    same while the history grows tenfold."""
    log = SnapshotLog(spark, f"{tmp_dir}/t")
    index = IdIndex(log, file_rows=100, fanout=3)
    for batch in range(24):
        commit = log.begin("s", batch)
        ids = [f"t{i:07d}" for i in [*range(batch * 100, batch * 100 + 100), *range(max(0, batch * 100 - 20), batch * 100)]]
        entries = spark.createDataFrame([(i, f"u{batch}", batch) for i in ids], "transaction_id string, user_id string, event_unix long")
        state = log.state()
        found = index.lookup(state, entries.select("transaction_id"), len(ids)).collect()
        assert {(r.transaction_id, r.event_unix) for r in found} >= {(i, batch - 1) for i in ids[100:]}
        assert {r.transaction_id for r in found} <= set(ids)
        runs = index.write(entries, f"{commit}~level0", len(ids), 0)
        merged = type(state)(state.version, state.partitions, {**state.runs, **runs}, state.batches)
        more, dropped = index.merged(merged, commit)
        log.commit(commit, "s", batch, [], [], {k: v for k, v in {**runs, **more}.items() if k not in dropped},
                   [r for r in dropped if r in state.runs])
    opened = index.bytes_opened
    assert max(opened[18:]) <= 1.5 * max(opened[1:5]) and opened[23] > 0
    assert len(log.state().runs) <= 3 * 4


@pytest.mark.parametrize("pushed", [256, 0])
def test_index_finds_every_copy(spark, tmp_dir, monkeypatch, pushed):
    """Equal ids over file borders, ids in no order, pushed into the scan or joined."""
    from txlens.streaming import id_index
    monkeypatch.setattr(id_index, "PUSHED", pushed)
    log = SnapshotLog(spark, f"{tmp_dir}/t")
    index = IdIndex(log, file_rows=3, fanout=99)
    every = []
    for batch in range(3):
        entries = [(f"é{(i * 7 + batch) % 11}", f"u{i % 3}", i) for i in range(20)]
        every += entries
        commit = log.begin("s", batch)
        log.commit(commit, "s", batch, [], [], index.write(
            spark.createDataFrame(entries, "transaction_id string, user_id string, event_unix long"), f"{commit}~0", 20, 0))
    ids = spark.createDataFrame([("é3",), ("é10",), ("zz",)], "transaction_id string")
    got = index.lookup(log.state(), ids, 3).select("transaction_id", "user_id", "event_unix").collect()
    assert sorted(map(tuple, got)) == sorted(e for e in every if e[0] in ("é3", "é10"))


def test_lookup_at_the_pushed_bound(spark, tmp_dir):
    from txlens.streaming import id_index
    log = SnapshotLog(spark, f"{tmp_dir}/t")
    index = IdIndex(log)
    n = id_index.PUSHED
    entries = spark.range(5 * n).selectExpr("concat('t', id) AS transaction_id", "'u' AS user_id", "id AS event_unix")
    commit = log.begin("s", 0)
    log.commit(commit, "s", 0, [], [], index.write(entries, f"{commit}~0", 5 * n, 0))
    for size in (n, n + 1):
        ids = spark.range(size).selectExpr("concat('t', id * 3) AS transaction_id")
        assert index.lookup(log.state(), ids, size).count() == size


def test_query_identity(spark, tmp_dir):
    """Restarted from its checkpoint a query keeps its name; with a new one, batch
    numbers start again and its batches are not taken for committed."""
    import os
    from tests.test_streaming import feed_rows
    rows = feed_rows(30)
    os.makedirs(f"{tmp_dir}/in")

    def run(part, checkpoint):
        pd.DataFrame(part, columns=REQUIRED_COLUMNS).to_csv(f"{tmp_dir}/in/{len(os.listdir(f'{tmp_dir}/in'))}.csv", index=False)
        ST.start_feature_stream(spark, f"{tmp_dir}/in", f"{tmp_dir}/out", f"{tmp_dir}/{checkpoint}", trigger=None,
                                buckets=2).awaitTermination()
        return SnapshotLog(spark, f"{tmp_dir}/out").state().batches

    assert "direct" not in run(rows[:10], "a")
    assert len(run(rows[10:20], "a")) == 1
    assert len(run(rows[20:], "b")) == 2
    _close(table_rows(ST.current_features(spark, f"{tmp_dir}/out")), wanted(spark, [rows]))
