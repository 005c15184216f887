"""Keep-latest dedupe, normalisation and payload validation."""

import pytest
from pyspark.sql import functions as F

from txlens.operators.dedupe import dedupe_latest
from txlens.operators.normalize import MissingColumnsError, normalize, require_columns
from txlens.operators.validate import split_valid, validate_profiles, validate_transactions

RAW = ("transaction_id string, user_id string, amount string, event_time string, hour string, device_risk string, "
       "location_risk string, txn_velocity string, edge_fraud_probability string, status string")


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW)


def row(tid="t1", amount="10", time="2024-01-01T00:00:00.000Z", hour="3", status="approved", **kw):
    d = dict(device_risk="0.5", location_risk="0.5", txn_velocity="1", edge_fraud_probability="0.2")
    d.update(kw)
    return (tid, "u1", amount, time, hour, d["device_risk"], d["location_risk"], d["txn_velocity"],
            d["edge_fraud_probability"], status)


def test_require_columns(spark):
    df = spark.createDataFrame([("a",)], "transaction_id string")
    with pytest.raises(MissingColumnsError) as e:
        require_columns(df)
    assert "user_id" in e.value.missing


def test_normalize_casts_and_drops_null_ids(spark):
    df = raw(spark, [row(amount="n/a", hour="12.5"), row(tid=None), row(tid="t2", time="bad")])
    out = {r.transaction_id: r for r in normalize(df).collect()}
    assert set(out) == {"t1", "t2"}
    assert out["t1"].amount is None and out["t1"].hour == 12
    assert out["t2"].event_ts is None
    assert normalize(df, drop_null_ts=True).count() == 1


def test_dedupe_later_copy_wins_and_nulls_last(spark):
    df = normalize(raw(spark, [
        row("t1", time="2024-01-01T00:00:00.000Z", status="approved"),
        row("t1", time="2024-01-01T00:00:01.000Z", status="blocked"),
        row("t2", time="bad", status="approved"),
        row("t2", time="2024-01-01T00:00:00.000Z", status="blocked"),
        row("t3", amount="1"), row("t3", amount="2"),  # full tie on time: tie-break on the rest
    ]))
    d = {r.transaction_id: r for r in dedupe_latest(df).collect()}
    assert d["t1"].status == "blocked"
    assert d["t2"].status == "blocked"
    assert d["t3"].amount == 2.0
    again = dedupe_latest(dedupe_latest(df)).orderBy("transaction_id").collect()
    assert again == dedupe_latest(df).orderBy("transaction_id").collect()


def test_dedupe_plan_limits_before_exchange(spark):
    df = normalize(raw(spark, [row("t1"), row("t1", amount="3")]))
    plan = dedupe_latest(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan or "AdaptiveSparkPlan" in plan


def test_validate_rules(spark):
    rows = [row("ok"), row("neg", amount="-1"), row("hour", hour="24"), row("frac", hour="12.5"),
            row("p", edge_fraud_probability="1.5"), row("st", status="pending"),
            row("tz", time="2024-01-01 00:00:00"), row("vel", txn_velocity="10001"),
            row("nan", amount="NaN"), row("inf", amount="Infinity")]
    v = validate_transactions(raw(spark, rows))
    got = {r.transaction_id: set(r.failed_rules) for r in v.collect()}
    assert got["ok"] == set()
    assert got["neg"] == {"amount_positive"}
    assert got["hour"] == {"hour_int_0_23"} and got["frac"] == {"hour_int_0_23"}
    assert got["p"] == {"probability_0_1"} and got["st"] == {"status_enum"}
    assert got["tz"] == {"event_time_iso"} and got["vel"] == {"txn_velocity_0_10000"}
    assert got["nan"] == {"amount_positive"} and got["inf"] == {"amount_positive"}
    good, bad = split_valid(v)
    assert good.count() == 1 and bad.count() == len(rows) - 1


def test_validate_reason_length(spark):
    df = raw(spark, [row("a"), row("b")]).withColumn(
        "reason", F.when(F.col("transaction_id") == "a", F.lit("x" * 241)).otherwise(F.lit(None).cast("string")))
    got = {r.transaction_id: r.is_valid for r in validate_transactions(df).collect()}
    assert got == {"a": False, "b": True}


def test_validate_profiles(spark):
    df = spark.createDataFrame([("ab", 0.0, 999999999.0, "balanced"), ("a", -1.0, None, "wild"), (None, None, None, None)],
                               "name string, account_balance double, monthly_income double, risk_appetite string")
    got = [sorted(r.failed_rules) for r in validate_profiles(df).collect()]
    assert got == [[], ["account_balance_range", "name_2_80", "risk_appetite_enum"], []]
