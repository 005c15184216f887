"""Payload validation (FLT2, FLT3): one boolean per rule, the names of the
failed rules as an array, and a split into valid and rejected rows.  Pure
column expressions; no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txlens import constants as K

ISO_UTC_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"


def _num(c: str) -> Column:
    return F.col(c).cast("string").try_cast("double")


def _between(x: Column, lo, hi) -> Column:
    """x in [lo, hi] for finite bounds.  Spark orders NaN above +Inf, so the two
    comparisons also reject NaN and +-Inf; NULL counts as failing.  Each value
    is referenced twice only: Catalyst inlines it into the pushed-down filter."""
    return F.coalesce((x >= lo) & (x <= hi), F.lit(False))


def transaction_rules(df: DataFrame) -> dict[str, Column]:
    """Rule name -> column that is true when the row passes the rule."""
    amount = _num("amount")
    hour = _num("hour")
    text = F.col("event_time").cast("string")
    rules = {
        "amount_positive": F.coalesce((amount > 0) & (amount < F.lit(float("inf"))), F.lit(False)),
        "event_time_iso": F.coalesce(text.rlike(ISO_UTC_PATTERN), F.lit(False))
        & F.try_to_timestamp(text).isNotNull(),
        "hour_int_0_23": _between(hour, K.TXN_HOUR_MIN, K.TXN_HOUR_MAX) & (hour == F.floor(hour)),
        "device_risk_0_1": _between(_num("device_risk"), K.TXN_RISK_MIN, K.TXN_RISK_MAX),
        "location_risk_0_1": _between(_num("location_risk"), K.TXN_RISK_MIN, K.TXN_RISK_MAX),
        "txn_velocity_0_10000": _between(_num("txn_velocity"), K.TXN_VELOCITY_MIN, K.TXN_VELOCITY_MAX),
        "probability_0_1": _between(_num("edge_fraud_probability"), K.TXN_RISK_MIN, K.TXN_RISK_MAX),
        "status_enum": F.coalesce(F.col("status").isin(*K.TXN_STATUSES), F.lit(False)),
    }
    if "reason" in df.columns:
        rules["reason_max_240"] = F.col("reason").isNull() | (F.length("reason") <= K.TXN_REASON_MAX_CHARS)
    return rules


def _annotate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``failed_rules`` (names, for the report) and ``is_valid`` (the AND of the
    rules, so a filter on validity never builds the name array)."""
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))
    valid = F.lit(True)
    for ok in rules.values():
        valid = valid & ok
    return df.withColumn("failed_rules", failed).withColumn("is_valid", valid)


def validate_transactions(df: DataFrame) -> DataFrame:
    """FLT2: adds ``failed_rules`` (array of rule names) and ``is_valid``."""
    return _annotate(df, transaction_rules(df))


def split_valid(annotated: DataFrame) -> tuple[DataFrame, DataFrame]:
    return annotated.filter("is_valid"), annotated.filter(~F.col("is_valid"))


def profile_rules(df: DataFrame) -> dict[str, Column]:
    """FLT3: every field is optional; present values must be in bounds."""
    rules = {}
    if "name" in df.columns:
        n = F.length("name")
        rules["name_2_80"] = F.col("name").isNull() | ((n >= K.PROFILE_NAME_MIN_CHARS) & (n <= K.PROFILE_NAME_MAX_CHARS))
    for c in ("account_balance", "monthly_income"):
        if c in df.columns:
            x = _num(c)
            rules[f"{c}_range"] = F.col(c).isNull() | _between(x, K.PROFILE_MONEY_MIN, K.PROFILE_MONEY_MAX)
    if "risk_appetite" in df.columns:
        rules["risk_appetite_enum"] = F.col("risk_appetite").isNull() | F.coalesce(
            F.col("risk_appetite").isin(*K.RISK_APPETITES), F.lit(False))
    return rules


def validate_profiles(df: DataFrame) -> DataFrame:
    return _annotate(df, profile_rules(df))
