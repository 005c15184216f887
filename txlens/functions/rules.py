"""Rule and scoring expressions (RUL1-RUL10).  All but RUL7 are plain column
expressions: they stay inside whole-stage codegen and need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txlens import constants as K


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- RUL1 / RUL2 -------------------------------------------------------------

def rule_probability(prob="edge_fraud_probability") -> Column:
    return _c(prob) >= K.RULE_PROBABILITY_MIN


def rule_burst(count_10m="rolling_txn_count_10m") -> Column:
    return _c(count_10m) >= K.RULE_BURST_COUNT_MIN


def rule_night_high_value(amount="amount", hour="hour") -> Column:
    return (_c(amount) > K.RULE_NIGHT_AMOUNT_ABOVE) & (_c(hour) <= K.RULE_NIGHT_HOUR_MAX)


def cloud_rule_risk(prob="edge_fraud_probability", count_10m="rolling_txn_count_10m",
                    amount="amount", hour="hour") -> Column:
    """RUL1: 1 when any rule fires (first match wins; NULL comparisons fall through)."""
    return (F.when(rule_probability(prob), F.lit(1))
            .when(rule_burst(count_10m), F.lit(1))
            .when(rule_night_high_value(amount, hour), F.lit(1))
            .otherwise(F.lit(0)))


RULE_NAMES = ["high_probability", "burst_10m", "night_high_value"]


def rule_hits(prob="edge_fraud_probability", count_10m="rolling_txn_count_10m",
              amount="amount", hour="hour") -> dict[str, Column]:
    """RUL2: one 0/1 column per rule (NULL counts as not fired) plus the first hit."""
    conds = [rule_probability(prob), rule_burst(count_10m), rule_night_high_value(amount, hour)]
    hits = {f"hit_{n}": F.when(c, F.lit(1)).otherwise(F.lit(0)) for n, c in zip(RULE_NAMES, conds)}
    first = F.when(conds[0], F.lit(RULE_NAMES[0]))
    for n, c in zip(RULE_NAMES[1:], conds[1:]):
        first = first.when(c, F.lit(n))
    hits["first_rule"] = first
    return hits


# -- RUL3 / RUL4 -------------------------------------------------------------

def heuristic_linear(amount="amount", hour="hour", device="device_risk",
                     location="location_risk", velocity="txn_velocity") -> Column:
    night = F.when(_c(hour) <= K.HEURISTIC_NIGHT_HOUR_MAX, F.lit(1.0)).otherwise(F.lit(0.0))
    return (F.lit(K.HEURISTIC_AMOUNT_WEIGHT) * _c(amount)
            + F.lit(K.HEURISTIC_NIGHT_WEIGHT) * night
            + F.lit(K.HEURISTIC_DEVICE_WEIGHT) * _c(device)
            + F.lit(K.HEURISTIC_LOCATION_WEIGHT) * _c(location)
            + F.lit(K.HEURISTIC_VELOCITY_WEIGHT) * _c(velocity))


def heuristic_score(amount="amount", hour="hour", device="device_risk",
                    location="location_risk", velocity="txn_velocity") -> Column:
    """RUL3: sigmoid(linear - 2.2), clamped to [0, 1]."""
    z = heuristic_linear(amount, hour, device, location, velocity)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z + F.lit(K.HEURISTIC_OFFSET)))
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))


def heuristic_label(amount="amount", hour="hour", device="device_risk",
                    location="location_risk", velocity="txn_velocity") -> Column:
    """RUL4: training label, linear score > 2.2."""
    z = heuristic_linear(amount, hour, device, location, velocity)
    return F.when(z > K.HEURISTIC_OFFSET, F.lit(1)).otherwise(F.lit(0))


# -- RUL5 / RUL6 -------------------------------------------------------------

def edge_status(prob="edge_fraud_probability", threshold: float = K.BLOCK_THRESHOLD) -> Column:
    """RUL5: 'blocked' at or above the threshold, else 'approved'."""
    return F.when(_c(prob) >= threshold, F.lit("blocked")).otherwise(F.lit("approved"))


def edge_reason(prob="edge_fraud_probability", threshold: float = K.BLOCK_THRESHOLD) -> Column:
    return F.when(_c(prob) >= threshold, F.lit(K.BLOCK_REASON)).otherwise(F.lit(K.APPROVE_REASON))


def risk_band(status="status", prob="edge_fraud_probability") -> Column:
    """RUL6: 'block' for blocked rows, 'flag' at probability >= 0.65, else 'safe'."""
    return (F.when(_c(status) == "blocked", F.lit("block"))
            .when(_c(prob) >= K.FLAG_PROBABILITY_MIN, F.lit("flag"))
            .otherwise(F.lit("safe")))


# -- RUL7 --------------------------------------------------------------------

def device_risk(df: DataFrame, user: str = "user_id", device: str = "device_id", ts: str = "event_ts",
                key: str = "transaction_id", out: str = "device_signal") -> DataFrame:
    """RUL7: adds ``out``: 0.78 on the first sighting of a (user, device) pair,
    0.12 on later ones.

    The first sighting is the smallest (time, key) of the pair; NULL users and
    devices are values like any other.  Of several rows with that same time and
    key (repeated rows) exactly one is the first.  The pair's first row comes
    from a partially aggregated minimum, joined back, so no task holds a whole
    pair; only rows equal in pair, time and key are numbered.
    """
    first = df.groupBy(F.col(user).alias("__u"), F.col(device).alias("__d")).agg(
        F.min(F.struct(F.col(ts).alias("t"), F.col(key).alias("k"))).alias("__first"))
    is_first = F.struct(F.col(ts).alias("t"), F.col(key).alias("k")).eqNullSafe(F.col("__first"))
    joined = df.join(first, F.col(user).eqNullSafe(F.col("__u")) & F.col(device).eqNullSafe(F.col("__d")), "left")
    again = Window.partitionBy(user, device, ts, key).orderBy(F.lit(1))
    return (joined.withColumn("__candidate", is_first).withColumn("__nth", F.row_number().over(again))
            .withColumn(out, F.when(F.col("__candidate") & (F.col("__nth") == 1), F.lit(K.NEW_DEVICE_RISK))
                        .otherwise(F.lit(K.KNOWN_DEVICE_RISK)))
            .drop("__u", "__d", "__first", "__candidate", "__nth"))


# -- RUL8 / RUL9 / RUL10 -----------------------------------------------------

def location_risk_from_zone(zone="timezone") -> Column:
    """RUL8: outside the region 0.85, other zone in region 0.35, home zone 0.08."""
    z = _c(zone)
    return (F.when(~z.startswith(K.REGION_PREFIX), F.lit(K.OUTSIDE_REGION_RISK))
            .when(z != K.HOME_ZONE, F.lit(K.IN_REGION_OTHER_RISK))
            .otherwise(F.lit(K.HOME_ZONE_RISK)))


def velocity_from_spend(spend="velocity_24h") -> Column:
    """RUL9: max(1, approved spend of the last 24 h / 1000)."""
    return F.greatest(F.lit(1.0), F.coalesce(_c(spend).cast("double"), F.lit(0.0)) / F.lit(1000.0))


def pct(x) -> Column:
    """RUL10: whole percent, rounding halves up (floor(x * 100 + 0.5))."""
    return F.floor(_c(x) * F.lit(100.0) + F.lit(0.5)).cast("long")
