"""Rule flag, scoring, decision and percentage expressions at their boundaries."""

import math

import pytest
from pyspark.sql import functions as F

from txlens.functions import rules as R


def test_cloud_rule_boundaries(spark):
    rows = [
        (0.8, 0, 1.0, 12, 1),        # probability exactly 0.8
        (0.7999, 3, 1.0, 12, 0),
        (0.1, 4, 1.0, 12, 1),        # burst exactly 4
        (0.1, 0, 250000.0, 4, 0),    # amount exactly 250000 is not above
        (0.1, 0, 250000.01, 4, 1),
        (0.1, 0, 300000.0, 5, 0),    # hour 5 is not night
        (None, None, None, None, 0),  # NULLs fall through
        (None, 5, None, None, 1),
    ]
    df = spark.createDataFrame(rows, "p double, c long, a double, h int, expect int")
    out = df.select(R.cloud_rule_risk("p", "c", "a", "h").alias("f"), "expect").collect()
    assert [r.f for r in out] == [r.expect for r in out]


def test_rule_hits_first_rule(spark):
    df = spark.createDataFrame([(0.9, 5, 300000.0, 2), (0.1, 5, 300000.0, 2), (0.1, 0, 300000.0, 2),
                                (0.1, 0, 1.0, 2)], "p double, c long, a double, h int")
    hits = R.rule_hits("p", "c", "a", "h")
    out = df.select(hits["first_rule"].alias("r"), hits["hit_burst_10m"].alias("b")).collect()
    assert [r.r for r in out] == ["high_probability", "burst_10m", "night_high_value", None]
    assert [r.b for r in out] == [1, 1, 0, 0]


def test_heuristic_score_and_label(spark):
    df = spark.createDataFrame([(100000.0, 3, 0.5, 0.5, 2.0), (10.0, 12, 0.0, 0.0, 0.0)],
                               "amount double, hour int, device_risk double, location_risk double, txn_velocity double")
    out = df.select(R.heuristic_score().alias("s"), R.heuristic_label().alias("l")).collect()
    z0 = 0.00002 * 100000 + 0.8 + 1.4 * 0.5 + 1.2 * 0.5 + 0.15 * 2
    assert out[0].s == pytest.approx(1 / (1 + math.exp(-z0 + 2.2)))
    assert out[0].l == 1 and out[1].l == 0
    assert 0 <= out[1].s <= 1


def test_edge_decision_threshold(spark):
    df = spark.createDataFrame([(0.95,), (0.9499,), (0.82,)], "edge_fraud_probability double")
    out = df.select(R.edge_status().alias("s"), R.edge_status(threshold=0.82).alias("s82"),
                    R.edge_reason().alias("r")).collect()
    assert [r.s for r in out] == ["blocked", "approved", "approved"]
    assert [r.s82 for r in out] == ["blocked", "blocked", "blocked"]
    assert out[0].r == "Edge anomaly threshold exceeded"


def test_risk_band_location_pct(spark):
    df = spark.createDataFrame([("blocked", 0.1, "Europe/Paris", 0.125), ("approved", 0.65, "Asia/Dubai", 0.005),
                                ("approved", 0.64, "Asia/Kolkata", 0.994)],
                               "status string, edge_fraud_probability double, timezone string, x double")
    out = df.select(R.risk_band().alias("b"), R.location_risk_from_zone().alias("l"), R.pct("x").alias("p")).collect()
    assert [r.b for r in out] == ["block", "flag", "safe"]
    assert [r.l for r in out] == [0.85, 0.35, 0.08]
    assert [r.p for r in out] == [13, 1, 99]  # halves round up


def test_velocity_from_spend(spark):
    df = spark.createDataFrame([(0.0,), (500.0,), (4500.0,), (None,)], "velocity_24h double")
    assert [r.v for r in df.select(R.velocity_from_spend().alias("v")).collect()] == [1.0, 1.0, 4.5, 1.0]
