"""Stream = batch parity of the feature stream; first-seen dedupe; decision stream."""

import datetime as dt
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from txlens.constants import REQUIRED_COLUMNS
from txlens.plans.features import FEATURE_COLUMNS, feature_job
from txlens.sources.feed import RAW_SCHEMA
from txlens.streaming import feature_stream as ST

T0 = dt.datetime(2024, 1, 1)


def feed_rows(n=240, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        t = T0 + dt.timedelta(seconds=rnd.randint(0, 3 * 86400))
        rows.append({"transaction_id": f"t{i}", "user_id": rnd.choice(["u1", "u1", "u2", "u3"]),
                     "amount": str(rnd.randint(1, 400000)), "event_time": t.strftime("%Y-%m-%dT%H:%M:%S.000Z"),
                     "hour": str(t.hour), "device_risk": "0.5", "location_risk": "0.3", "txn_velocity": "1",
                     "edge_fraud_probability": str(round(rnd.random(), 2)),
                     "status": rnd.choice(["approved", "approved", "blocked"])})
    # Re-sent copies one second later (must win the keep-latest) and a bad time.
    for i in range(0, n, 15):
        r = dict(rows[i])
        t = dt.datetime.strptime(r["event_time"], "%Y-%m-%dT%H:%M:%S.000Z") + dt.timedelta(seconds=1)
        r["event_time"], r["status"] = t.strftime("%Y-%m-%dT%H:%M:%S.000Z"), "blocked"
        rows.append(r)
    rows.append(dict(rows[3], transaction_id="tbad", event_time="not-a-time"))
    return rows


def write_files(rows, folder, n_files, order):
    os.makedirs(folder, exist_ok=True)
    chunks = [rows[i::n_files] for i in range(n_files)]
    for k, idx in enumerate(order):
        pd.DataFrame(chunks[idx], columns=REQUIRED_COLUMNS).to_csv(f"{folder}/part-{k:03d}.csv", index=False)


def stream_result(spark, tmp_dir, rows, n_files, order):
    write_files(rows, f"{tmp_dir}/in", n_files, order)
    q = ST.start_feature_stream(spark, f"{tmp_dir}/in", f"{tmp_dir}/out", f"{tmp_dir}/chk",
                                trigger=None, max_files_per_trigger=1, buckets=4)
    q.awaitTermination()
    cols = [c for c in FEATURE_COLUMNS if c != "event_ts"]
    return sorted(tuple(r) for r in ST.current_features(spark, f"{tmp_dir}/out").select(*cols).collect())


def batch_result(spark, rows):
    df = spark.createDataFrame(pd.DataFrame(rows, columns=REQUIRED_COLUMNS), RAW_SCHEMA)
    cols = [c for c in FEATURE_COLUMNS if c != "event_ts"]
    return sorted(tuple(r) for r in feature_job(df).select(*cols).collect())


def _close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:1] == y[:1]
        for u, v in zip(x, y):
            if isinstance(u, float) and isinstance(v, float):
                assert u == pytest.approx(v, rel=1e-12)
            else:
                assert u == v


@pytest.mark.parametrize("order", [[0, 1, 2, 3, 4], [3, 0, 4, 2, 1]])
def test_stream_equals_batch(spark, tmp_dir, order):
    rows = feed_rows()
    _close(stream_result(spark, tmp_dir, rows, 5, order), batch_result(spark, rows))


def test_stream_repeated_file_and_late_row(spark, tmp_dir):
    rows = feed_rows(seed=4)
    late = dict(rows[10], transaction_id="tlate",
                event_time=(T0 + dt.timedelta(hours=1)).strftime("%Y-%m-%dT%H:%M:%S.000Z"))
    write_files(rows, f"{tmp_dir}/in", 4, [0, 1, 2, 3])
    pd.DataFrame([late], columns=REQUIRED_COLUMNS).to_csv(f"{tmp_dir}/in/part-100.csv", index=False)  # 23 h+ late
    pd.read_csv(f"{tmp_dir}/in/part-001.csv", dtype=str).to_csv(f"{tmp_dir}/in/part-101.csv", index=False)  # resent file
    q = ST.start_feature_stream(spark, f"{tmp_dir}/in", f"{tmp_dir}/out", f"{tmp_dir}/chk",
                                trigger=None, max_files_per_trigger=1, buckets=4)
    q.awaitTermination()
    cols = [c for c in FEATURE_COLUMNS if c != "event_ts"]
    got = sorted(tuple(r) for r in ST.current_features(spark, f"{tmp_dir}/out").select(*cols).collect())
    _close(got, batch_result(spark, rows + [late]))


def test_first_seen(spark, tmp_dir):
    rows = feed_rows(60)
    write_files(rows, f"{tmp_dir}/in", 1, [0])
    s = spark.readStream.schema(RAW_SCHEMA).option("header", True).csv(f"{tmp_dir}/in")
    typed = s.select("transaction_id", F.try_to_timestamp("event_time").alias("event_ts"))
    q = (ST.first_seen(typed).writeStream.format("memory").queryName("first_seen_t")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.sql("SELECT * FROM first_seen_t")
    assert out.count() == out.select("transaction_id").distinct().count() == len({r["transaction_id"] for r in rows})


def iso(seconds):
    return (T0 + dt.timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%S.000Z")


def row(tid, user, seconds, amount="10", status="approved"):
    return {"transaction_id": tid, "user_id": user, "amount": amount,
            "event_time": iso(seconds) if seconds is not None else "no time", "hour": "1", "device_risk": "0.5",
            "location_risk": "0.3", "txn_velocity": "1", "edge_fraud_probability": "0.2", "status": status}


def hostile_batches(seed=0):
    """Ids sent again hours apart and in later batches, with rows between; ids that
    change their user; rows without a user, a time or both; a very late row."""
    rnd = random.Random(seed)
    batches = [[row("X", "a", 1000), row("Y", "a", 1100), row("n1", None, 500), row("n2", None, None), row("m", "a", 2000)],
               [row("X", "a", 1200), row("n3", None, 700), row("n2", None, None, "20")],
               [row("X", "a", 40_000), row("m", "b", 2100), row("Y", "a", None)],     # Y without a time loses
               [row("late", "a", 5), row("n2", None, 900), row("m", "b", 50)],
               [row("X", "b", 90_000, "7", "blocked")]]
    for k in range(5):
        batches[k] += [row(f"r{rnd.randrange(30)}", rnd.choice(["a", "b", None]), rnd.choice([None, *range(0, 200_000, 9973)]),
                           str(rnd.randrange(1, 99))) for _ in range(12)]
    return batches


def batch_frames(spark, batches):
    for i, b in enumerate(batches):
        yield i, spark.createDataFrame(pd.DataFrame(b, columns=REQUIRED_COLUMNS), RAW_SCHEMA)


def table_rows(df):
    cols = [c for c in FEATURE_COLUMNS if c != "event_ts"]
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_feature_table_equals_batch_on_hostile_rows(spark, tmp_dir, seed):
    batches = hostile_batches(seed)
    up = ST.FeatureStreamUpdater(f"{tmp_dir}/out", buckets=3, compact_every=2)
    for i, df in batch_frames(spark, batches):
        up(df, i)
        if i in (1, 3):
            up(df, i)                       # a replay changes nothing
    rows = [r for b in batches for r in b]
    want = spark.createDataFrame(pd.DataFrame(rows, columns=REQUIRED_COLUMNS), RAW_SCHEMA)
    _close(table_rows(ST.current_features(spark, f"{tmp_dir}/out")), table_rows(feature_job(want)))


def test_a_batch_reads_its_own_days_only(spark, tmp_dir):
    """What a batch reads does not grow with the history."""
    up = ST.FeatureStreamUpdater(f"{tmp_dir}/out", buckets=2, compact_every=3)
    for day in range(9):
        rows = [row(f"d{day}-{i}", f"u{i % 4}", day * 86_400 + 3600 * i) for i in range(8)]
        up(next(batch_frames(spark, [rows]))[1], day)
    assert len(up.partitions_read) == 9 and max(up.partitions_read) <= 2 * 2


def test_decisions_over_batches_and_replay(spark, tmp_dir):
    from decimal import Decimal

    from txlens.operators.ledger import process_transactions
    batches = [[row(f"b{b}-{i}", ["u", "v", None][i % 3], b * 1000 + i, str(10 * i + 5)) for i in range(9)] for b in range(5)]
    batches[2].append(row("huge", "u", 2500, "1e13"))
    batches[3].append(row(None, "u", 3500, "1"))
    profiles = spark.createDataFrame([("u", Decimal("300.00")), ("v", Decimal("90.00"))], "user_id string, account_balance decimal(14,2)")
    profiles.write.parquet(f"{tmp_dir}/opening")
    up = ST.DecisionStreamUpdater(f"{tmp_dir}/none", f"{tmp_dir}/opening", f"{tmp_dir}/dec", f"{tmp_dir}/feed",
                                  compact_every=2)
    for i, df in batch_frames(spark, batches):
        up(df, i)
        up(df, i)
    rows = [r for b in batches for r in b]
    want = process_transactions(spark.createDataFrame(pd.DataFrame(rows, columns=REQUIRED_COLUMNS), RAW_SCHEMA),
                                spark.createDataFrame([], "user_id string"), profiles)
    pick = lambda df: sorted((r.transaction_id or "", r.user_id or "", r.code, r.message) for r in df.collect())
    assert pick(ST.read_decisions(spark, f"{tmp_dir}/dec")) == pick(want)
    fed = spark.read.option("header", True).csv(f"{tmp_dir}/feed")
    assert sorted(r.transaction_id or "" for r in fed.collect()) == sorted(t for t, _, c, _ in pick(want) if c == 200)


def test_a_batch_is_decided_once(spark, tmp_dir, monkeypatch):
    """Crashes around the commit; a replay with another blacklist and other partitions
    leaves the decisions and the feed files of the first commit."""
    from decimal import Decimal

    from txlens.sources.snapshots import SnapshotLog
    profiles = spark.createDataFrame([("u", Decimal("50.00"))], "user_id string, account_balance decimal(14,2)")
    profiles.write.parquet(f"{tmp_dir}/opening")
    one = spark.createDataFrame(pd.DataFrame([row(f"a{i}", "u", i, "10") for i in range(8)], columns=REQUIRED_COLUMNS), RAW_SCHEMA)
    two = spark.createDataFrame(pd.DataFrame([row("b", "u", 99, "1"), row("c", "v", 99, "1")], columns=REQUIRED_COLUMNS), RAW_SCHEMA)

    def updater():
        return ST.DecisionStreamUpdater(f"{tmp_dir}/black", f"{tmp_dir}/opening", f"{tmp_dir}/dec", f"{tmp_dir}/feed")

    for step in ("write", "write_run", "rename", "copy_out"):
        with monkeypatch.context() as m:
            real = getattr(SnapshotLog, step)
            m.setattr(SnapshotLog, step, lambda *a, **k: (_ for _ in ()).throw(InterruptedError(step)))
            with pytest.raises(InterruptedError):
                updater()(one.repartition(5), 0)
            assert real is not None
    first = sorted(map(tuple, ST.read_decisions(spark, f"{tmp_dir}/dec").collect()))     # committed by the last attempt
    assert len(first) == 8 and sum(r[2] == 200 for r in first) == 5
    spark.createDataFrame([("u",)], "user_id string").write.parquet(f"{tmp_dir}/black")
    updater()(one.coalesce(1), 0)
    updater()(one.coalesce(1), 0)
    assert sorted(map(tuple, ST.read_decisions(spark, f"{tmp_dir}/dec").collect())) == first
    fed = spark.read.option("header", True).csv(f"{tmp_dir}/feed")
    assert sorted(r.transaction_id for r in fed.collect()) == sorted(r[0] for r in first if r[2] == 200)
    updater()(two, 1)
    got = {r.transaction_id: r.code for r in ST.read_decisions(spark, f"{tmp_dir}/dec").collect()}
    assert got["b"] == 403 and got["c"] == 400 and len(got) == 10


def test_stream_reads_columns_by_header(spark, tmp_dir):
    rows = feed_rows(40)
    os.makedirs(f"{tmp_dir}/in")
    pd.DataFrame(rows, columns=REQUIRED_COLUMNS)[REQUIRED_COLUMNS[::-1]].to_csv(f"{tmp_dir}/in/a.csv", index=False)
    q = ST.start_feature_stream(spark, f"{tmp_dir}/in", f"{tmp_dir}/out", f"{tmp_dir}/chk", trigger=None, buckets=2)
    q.awaitTermination()
    assert {r.user_id for r in ST.current_features(spark, f"{tmp_dir}/out").collect()} == {"u1", "u2", "u3"}


def run_state_stream(spark, tmp_dir, lateness):
    from txlens.operators.normalize import event_unix, normalize
    from txlens.streaming.rolling_state import rolling_state_stream
    raw = spark.readStream.schema(RAW_SCHEMA).option("header", True).option("maxFilesPerTrigger", 1).csv(f"{tmp_dir}/in")
    typed = (normalize(raw).withColumn("event_unix", event_unix("event_ts"))
             .withColumn("event_ms", F.unix_millis("event_ts")))
    q = (rolling_state_stream(typed, lateness_seconds=lateness).writeStream.format("parquet")
         .option("path", f"{tmp_dir}/out").option("checkpointLocation", f"{tmp_dir}/chk")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{tmp_dir}/out")


def test_rolling_state_equals_batch(spark, tmp_dir):
    from txlens.streaming.rolling_state import latest_emitted
    rows = feed_rows(seed=8)                      # with a row without a time
    write_files(rows, f"{tmp_dir}/in", 4, [1, 0, 3, 2])  # out of order, within the lateness
    emitted = run_state_stream(spark, tmp_dir, 5 * 86400)
    cols = [c for c in FEATURE_COLUMNS if c != "event_ts"]
    got = sorted(tuple(r) for r in latest_emitted(emitted).select(*cols).collect())
    _close(got, batch_result(spark, rows))


def test_rolling_state_follows_ids_sent_again(spark, tmp_dir):
    """Copies hours apart in later batches: the rows between stop counting the old one."""
    from txlens.streaming.rolling_state import latest_emitted
    batches = [[row("X", "a", 1000), row("Y", "a", 1100), row("Z", "a", 80_000)], [row("X", "a", 1200)],
               [row("X", "a", 40_000), row("Y", "a", None)], [row("X", "a", 30_000), row("W", "a", None)],
               [row("W", "a", 1150), row("V", "a", 126_401)]]
    os.makedirs(f"{tmp_dir}/in")
    for i, b in enumerate(batches):
        pd.DataFrame(b, columns=REQUIRED_COLUMNS).to_csv(f"{tmp_dir}/in/{i}.csv", index=False)
        os.utime(f"{tmp_dir}/in/{i}.csv", (1_700_000_000 + i, 1_700_000_000 + i))
    got = {r.transaction_id: (r.rolling_txn_count_24h, r.rolling_total_spend_24h)
           for r in latest_emitted(run_state_stream(spark, tmp_dir, 5 * 86400)).collect()}
    want = spark.createDataFrame(pd.DataFrame([r for b in batches for r in b], columns=REQUIRED_COLUMNS), RAW_SCHEMA)
    assert got == {r.transaction_id: (r.rolling_txn_count_24h, r.rolling_total_spend_24h) for r in feature_job(want).collect()}
    assert got["Y"] == (1, 10.0) or got["Y"] == (2, 20.0)


def test_rolling_state_hands_out_late_rows(spark, tmp_dir):
    from txlens.streaming.rolling_state import late_rows, latest_emitted
    os.makedirs(f"{tmp_dir}/in")
    for i, b in enumerate([[row("a", "u", 500_000)], [row("b", "u", 100), row("c", "u", 499_000)]]):
        pd.DataFrame(b, columns=REQUIRED_COLUMNS).to_csv(f"{tmp_dir}/in/{i}.csv", index=False)
        os.utime(f"{tmp_dir}/in/{i}.csv", (1_700_000_000 + i, 1_700_000_000 + i))
    emitted = run_state_stream(spark, tmp_dir, 3600)
    assert [r.transaction_id for r in late_rows(emitted).collect()] == ["b"]
    assert sorted(r.transaction_id for r in latest_emitted(emitted).collect()) == ["a", "c"]


def test_refresh_query_clusters_with_all_starts(spark, monkeypatch):
    from txlens import constants as K
    from txlens.plans import catalog_streaming
    seen = {}

    def run(spark, sf, files_per_batch=10, newest_first=False, **updater_args):
        seen.update(updater_args)
        raise InterruptedError

    monkeypatch.setattr(catalog_streaming, "run_feature_stream", run)
    with pytest.raises(InterruptedError):
        catalog_streaming.str5(spark, "")
    assert ST.FeatureStreamUpdater("out", **seen).cluster_starts == K.CLUSTER_STARTS


def test_rolling_state_calls_follow_hours_not_rows():
    """One user's batches of many rows: the calls to the state store (each a round trip)
    follow hours and buckets of ids, and the features are those of plain counting."""
    import numpy as np

    from txlens.streaming.rolling_state import PLACE_BUCKETS, RollingStateProcessor
    calls = []

    class Map(dict):
        def containsKey(self, k):
            calls.append("has")
            return k in self

        def getValue(self, k):
            calls.append("get")
            return self[k]

        def updateValue(self, k, v):
            calls.append("put")
            self[k] = v

        def removeKey(self, k):
            calls.append("del")
            self.pop(k, None)

    class Value:
        v = None

        def exists(self):
            return self.v is not None

        def get(self):
            return self.v

        def update(self, v):
            self.v = v

    class Handle:
        maps: dict = {}

        def getMapState(self, name, *a):
            return self.maps.setdefault(name, Map())

        def getValueState(self, *a):
            return Value()

    p = RollingStateProcessor(86_400)
    p.init(Handle())
    rnd = np.random.default_rng(1)

    def batch(first, n, low, high):
        t = rnd.integers(low, high, n)
        return pd.DataFrame({"transaction_id": [f"t{first + i}" for i in range(n)], "user_id": "u", "amount": 1.0,
                             "event_time": "x", "hour": 1, "device_risk": 0.1, "location_risk": 0.1, "txn_velocity": 1.0,
                             "edge_fraud_probability": 0.1, "status": "approved", "event_unix": t, "event_ms": t * 1000})

    day, n = 86_400, 20_000
    one, two = batch(0, n, 0, 3 * day), batch(n - 500, n, 3 * day, 6 * day)     # 500 ids come again, later
    emitted = []
    for frame in (one, two):
        calls.clear()
        emitted += list(p.handleInputRows(("u",), iter([frame.iloc[:7000], frame.iloc[7000:]]), None))
        assert len(calls) < 4 * PLACE_BUCKETS + 10 * 24 * 6, len(calls)
    out = pd.concat(emitted).sort_values("emit_seq").drop_duplicates("transaction_id", keep="last").set_index("transaction_id")
    current = pd.concat([one, two]).sort_values("event_ms").drop_duplicates("transaction_id", keep="last")
    t = np.sort(current["event_unix"].to_numpy())
    own = current.set_index("transaction_id")["event_unix"]
    want = np.searchsorted(t, own, side="right") - np.searchsorted(t, own - day, side="left")
    got = out.loc[own.index, "rolling_txn_count_24h"].to_numpy()
    recent = (own >= 2 * day).to_numpy()           # older rows that stood beside a replaced copy are past recall
    assert len(out) == len(current) and (got[recent] == want[recent]).all()
    assert min(k for (k,) in Handle.maps["cells"]) >= (t[-1] - 2 * day) // 3600
