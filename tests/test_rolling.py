"""Trailing-frame features: both strategies against a brute-force reference."""

import random

import pytest
from pyspark.sql import functions as F

from txlens.operators.rolling import FEATURE_SPECS, RollingSpec, rolling_features

SCHEMA = "transaction_id string, user_id string, event_unix long, amount double, is_blocked int"


def brute(rows, specs):
    out = {}
    for r in rows:
        tid, u, t, a, b = r
        res = {}
        for s in specs:
            if t is None:
                frame = [x for x in rows if x[1] == u and x[2] is None]
            else:
                frame = [x for x in rows if x[1] == u and x[2] is not None and t - s.seconds <= x[2] <= t]
            col = {"amount": 3, "is_blocked": 4, "transaction_id": 0}[s.column]
            vals = [x[col] for x in frame if x[col] is not None]
            if s.fn == "count":
                res[s.name] = len(vals)
            elif s.fn == "sum":
                res[s.name] = sum(vals) if vals else None
            else:
                res[s.name] = sum(vals) / len(vals) if vals else None
        out[tid] = res
    return out


def check(spark, rows, specs=FEATURE_SPECS, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    expect = brute(rows, specs)
    for strategy in ("window", "sweep"):
        got = {r["transaction_id"]: r.asDict() for r in rolling_features(df, specs, strategy=strategy, **kw).collect()}
        assert set(got) == set(expect)
        for tid, res in expect.items():
            for k, v in res.items():
                g = got[tid][k]
                if v is None:
                    assert g is None, (strategy, tid, k)
                else:
                    assert g == pytest.approx(v, rel=1e-12, abs=1e-9), (strategy, tid, k, g, v)


def test_frame_boundaries(spark):
    t0 = 1_700_000_000
    rows = [
        ("a", "u1", t0, 10.0, 0),
        ("b", "u1", t0 + 600, 20.0, 1),     # exactly 10 min later: inside
        ("c", "u1", t0 + 1201, 30.0, 0),    # 601 s after b: b outside its 10-min frame
        ("d", "u1", t0 + 86400, 40.0, 0),   # exactly 24 h after a: inside
        ("e", "u1", t0 + 86401 + 600, 50.0, 1),
        ("f", "u1", t0 + 86401 + 600, 60.0, 0),  # same second as e: peers see each other
        ("g", "u2", t0, 70.0, 0),
    ]
    check(spark, rows)


def test_nulls(spark):
    rows = [
        ("a", "u1", None, 5.0, 0), ("b", "u1", None, None, 1), ("c", "u1", 100, None, 0),
        ("d", "u1", 200, 7.0, 1), ("e", None, 300, 1.0, 0), ("f", None, 310, 2.0, 0),
    ]
    check(spark, rows)


@pytest.mark.parametrize("cell", [1, 60, 3600, 86400 * 10])
def test_random_against_brute_force(spark, cell):
    rnd = random.Random(cell)
    rows = []
    for i in range(300):
        u = rnd.choice(["u1", "u1", "u1", "u2", "u3"])  # u1 is hot
        t = 1_700_000_000 + rnd.randint(0, 4 * 86400) if rnd.random() > 0.03 else None
        a = round(rnd.uniform(0.01, 1000.0), 2) if rnd.random() > 0.05 else None
        rows.append((f"t{i}", u, t, a, rnd.randint(0, 1)))
    specs = FEATURE_SPECS + [RollingSpec("avg_1h", "avg", "amount", 3600)]
    check(spark, rows, specs, cell_seconds=cell)


def test_partition_count_independence(spark):
    rnd = random.Random(7)
    rows = [(f"t{i}", f"u{rnd.randint(0, 3)}", 1_700_000_000 + rnd.randint(0, 3 * 86400),
             float(rnd.randint(1, 100)), rnd.randint(0, 1)) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    a = rolling_features(df.repartition(1)).orderBy("transaction_id").collect()
    b = rolling_features(df.repartition(13)).orderBy("transaction_id").collect()
    assert a == b


def test_counts_grow_with_frame_length(spark):
    rnd = random.Random(3)
    rows = [(f"t{i}", "u", 1_700_000_000 + rnd.randint(0, 86400 * 2), 1.0, 0) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    specs = [RollingSpec("c1", "count", "transaction_id", 60), RollingSpec("c2", "count", "transaction_id", 600),
             RollingSpec("c3", "count", "transaction_id", 86400)]
    out = rolling_features(df, specs).collect()
    assert all(1 <= r.c1 <= r.c2 <= r.c3 for r in out)


def test_unknown_function_rejected(spark):
    df = spark.createDataFrame([("a", "u", 1, 1.0, 0)], SCHEMA)
    with pytest.raises(ValueError):
        rolling_features(df, [RollingSpec("x", "max", "amount", 10)])


def test_non_finite_and_large_values(spark):
    """NaN and infinities give what a plain window sum gives; large values
    next to small fractions keep their precision (exact integer parts)."""
    import math
    t0 = 1_700_000_000
    rows = [
        ("a", "u1", t0, 1e15 + 0.25, 0),
        ("b", "u1", t0 + 10, 0.125, 0),
        ("c", "u1", t0 + 700, -1e15, 0),      # a and b still inside 24 h, outside 10 min
        ("d", "u2", t0, float("inf"), 0),
        ("e", "u2", t0 + 5, 1.5, 0),
        ("f", "u2", t0 + 86401 + 5, 2.5, 0),  # d and e expired
        ("g", "u3", t0, float("nan"), 0),
        ("h", "u3", t0 + 86401, 4.0, 0),      # g expired
        ("i", "u4", t0, float("inf"), 0),
        ("j", "u4", t0 + 1, float("-inf"), 0),
        ("k", "u5", t0, 2.0 ** 60, 0),        # beyond the exact split: carried whole
        ("l", "u5", t0 + 1, 1.0, 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    specs = [RollingSpec("s", "sum", "amount", 86400), RollingSpec("m", "avg", "amount", 86400)]
    expect = brute(rows, specs)
    for strategy in ("window", "sweep"):
        got = {r["transaction_id"]: r.asDict() for r in rolling_features(df, specs, strategy=strategy).collect()}
        for tid, res in expect.items():
            for k, v in res.items():
                g = got[tid][k]
                if isinstance(v, float) and math.isnan(v):
                    assert g is not None and math.isnan(g), (strategy, tid, k, g)
                else:
                    assert g == pytest.approx(v, rel=1e-12, abs=1e-9), (strategy, tid, k, g, v)


def test_one_user_with_200k_rows_in_a_day(spark):
    """The default strategy is linear in a hot user's rows (a sliding range frame is not)."""
    import time
    n = 200_000
    df = spark.range(n).select(
        F.concat(F.lit("t"), "id").alias("transaction_id"), F.lit("hot").alias("user_id"),
        (F.lit(1_700_000_000) + F.floor(F.col("id") * 86_000 / n)).cast("long").alias("event_unix"),
        F.lit(1.0).alias("amount"), F.lit(0).alias("is_blocked"))
    began = time.time()
    out = rolling_features(df).agg(F.max("rolling_txn_count_24h"), F.sum("rolling_txn_count_24h")).first()
    assert out[0] == n and out[1] >= n * (n + 1) // 2
    assert time.time() - began < 60


def test_rows_without_a_time_see_each_other_only(spark):
    rows = [("a", "u1", None, 2.0, 1), ("b", "u1", None, 3.0, 0), ("c", "u1", 100, 7.0, 0), ("d", None, None, 1.0, 0),
            ("e", None, None, None, 1), ("f", None, 100, 4.0, 0), ("g", "u2", None, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for strategy in ("window", "sweep"):
        got = {r.transaction_id: (r.rolling_total_spend_24h, r.rolling_txn_count_24h, r.rolling_blocked_count_24h)
               for r in rolling_features(df, strategy=strategy).collect()}
        assert got == {"a": (5.0, 2, 1), "b": (5.0, 2, 1), "c": (7.0, 1, 0), "d": (1.0, 2, 1), "e": (1.0, 2, 1),
                       "f": (4.0, 1, 0), "g": (None, 1, 0)}, strategy


def test_no_job_runs_while_the_feature_plan_is_built(spark):
    from txlens.plans.features import feature_job
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan-only", "plan")
    try:
        feed = spark.createDataFrame([("t", "u", "1", "2024-01-01T00:00:00Z", "1", "0", "0", "1", "0", "approved")],
                                     "transaction_id string, user_id string, amount string, event_time string, hour string, "
                                     "device_risk string, location_risk string, txn_velocity string, "
                                     "edge_fraud_probability string, status string")
        feature_job(feed)
        assert not tracker.getJobIdsForGroup("plan-only")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_window_strategy_is_linear_in_a_hot_user(spark):
    """100 000 rows of a user in a day: the sliding frame added up 5e9 values, the running total does not."""
    import time
    n = 100_000
    df = spark.range(n).select(
        F.concat(F.lit("t"), "id").alias("transaction_id"), F.lit("hot").alias("user_id"),
        (F.lit(1_700_000_000) + F.floor(F.col("id") * 86_000 / n)).cast("long").alias("event_unix"),
        F.lit(1.0).alias("amount"), F.lit(0).alias("is_blocked"))
    out = rolling_features(df, strategy="window")
    plan = out._jdf.queryExecution().toString()
    assert "RangeFrame, -86400" not in plan and "RangeFrame, -600" not in plan and "Join" not in plan
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    began = time.time()
    got = out.agg(F.max("rolling_txn_count_24h"), F.sum("rolling_txn_count_24h")).first()
    assert got[0] == n and got[1] >= n * (n + 1) // 2
    assert time.time() - began < 60


def test_window_strategy_at_cell_borders_and_before_the_epoch(spark):
    rows, i = [], 0
    for base in (-3 * 86400, 0, 86400 * 19_700):
        for off in (-86401, -86400, -601, -600, -1, 0, 0, 1, 599, 600, 86399, 86400, 86401, 2 * 86400, 2 * 86400 + 1):
            rows.append((f"t{i}", "u", base + off, float(i % 7), i % 2))
            i += 1
    check(spark, rows, FEATURE_SPECS + [RollingSpec("now", "sum", "amount", 0), RollingSpec("d3", "count", "transaction_id", 3 * 86400)])


def test_window_strategy_keeps_decimals(spark):
    from decimal import Decimal

    from pyspark.sql import Window
    df = spark.createDataFrame([("a", "u", 0, Decimal("1.10"), 0), ("b", "u", 50, Decimal("2.25"), 0),
                                ("c", "u", 101, None, 0), ("d", "v", 5, None, 0)],
                               "transaction_id string, user_id string, event_unix long, amount decimal(9,2), is_blocked int")
    w = Window.partitionBy("user_id").orderBy("event_unix").rangeBetween(-100, 0)
    plain = df.withColumn("s", F.sum("amount").over(w)).withColumn("m", F.avg("amount").over(w))
    got = rolling_features(df, [RollingSpec("s", "sum", "amount", 100), RollingSpec("m", "avg", "amount", 100)], strategy="window")
    assert got.schema.simpleString() == plain.schema.simpleString()
    assert sorted(got.collect()) == sorted(plain.collect())
