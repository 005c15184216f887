"""Projections and light filters of the transaction feed (PRJ1-PRJ6, FLT1, SRC2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txlens.constants import DEFAULT_REASON, REQUIRED_COLUMNS

DOUBLE_COLUMNS = ["amount", "device_risk", "location_risk", "txn_velocity", "edge_fraud_probability"]
INT_MIN, INT_MAX = -(2 ** 31), 2 ** 31 - 1


class MissingColumnsError(ValueError):
    """Raised at plan time when a feed lacks required columns."""

    def __init__(self, missing):
        super().__init__(f"missing required columns: {missing}")
        self.missing = list(missing)


def require_columns(df: DataFrame, cols=REQUIRED_COLUMNS) -> DataFrame:
    """SRC2: every required name must be present (checked on the schema, no job)."""
    present = set(df.columns)
    missing = [c for c in cols if c not in present]
    if missing:
        raise MissingColumnsError(missing)
    return df


def to_double(c) -> Column:
    """Bad numeric text becomes NULL (ANSI stays on for everything else)."""
    return F.col(c).try_cast("double") if isinstance(c, str) else c.try_cast("double")


def to_int_truncating(c) -> Column:
    """Integer from text the way a non-ANSI cast does it: '12.5' -> 12, 'x' -> NULL."""
    d = to_double(c)
    return F.when((d >= INT_MIN) & (d <= INT_MAX), d.cast("int"))


def parse_event_ts(c="event_time") -> Column:
    """PRJ2: ISO-8601 text to timestamp; unparseable text becomes NULL."""
    col = F.col(c) if isinstance(c, str) else c
    return F.try_to_timestamp(col.cast("string"))


def event_unix(c="event_ts") -> Column:
    """PRJ3: whole epoch seconds (floor) of a timestamp."""
    col = F.col(c) if isinstance(c, str) else c
    return F.unix_seconds(col.cast("timestamp"))


def is_blocked(c="status") -> Column:
    """PRJ4: 1 for status 'blocked', else 0 (NULL status gives 0)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col == "blocked", F.lit(1)).otherwise(F.lit(0))


def normalize(df: DataFrame, drop_null_ts: bool = False) -> DataFrame:
    """PRJ1 + PRJ2 + FLT1: typed feed with ``event_ts``.

    Keeps the ten feed columns, casts numerics (bad text -> NULL), parses
    ``event_time`` and drops rows without a ``transaction_id``.  Rows whose
    time does not parse are kept unless ``drop_null_ts``.
    """
    require_columns(df)
    out = df.select(
        F.col("transaction_id").cast("string").alias("transaction_id"),
        F.col("user_id").cast("string").alias("user_id"),
        to_double("amount").alias("amount"),
        F.col("event_time").cast("string").alias("event_time"),
        to_int_truncating("hour").alias("hour"),
        to_double("device_risk").alias("device_risk"),
        to_double("location_risk").alias("location_risk"),
        to_double("txn_velocity").alias("txn_velocity"),
        to_double("edge_fraud_probability").alias("edge_fraud_probability"),
        F.col("status").cast("string").alias("status"),
    ).withColumn("event_ts", parse_event_ts("event_time"))
    out = out.filter(F.col("transaction_id").isNotNull())
    if drop_null_ts:
        out = out.filter(F.col("event_ts").isNotNull())
    return out


def default_reason(c="reason") -> Column:
    """PRJ6: missing reason text becomes the standard one."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(col, F.lit(DEFAULT_REASON))


# Ledger record (camelCase) to feed record (snake_case); fixed names.
LEDGER_TO_FEED = [
    ("publicId", "transaction_id"),
    ("userId", "user_id"),
    ("amount", "amount"),
    ("eventTime", "event_time"),
    ("hour", "hour"),
    ("deviceRisk", "device_risk"),
    ("locationRisk", "location_risk"),
    ("txnVelocity", "txn_velocity"),
    ("edgeFraudProbability", "edge_fraud_probability"),
    ("status", "status"),
    ("reason", "reason"),
]


def ledger_to_feed(ledger: DataFrame) -> DataFrame:
    """PRJ5: rename a camelCase ledger into the feed's column names.

    ``amount`` becomes a double and ``event_time`` ISO-8601 text with ``Z``.
    """
    cols = []
    for src, dst in LEDGER_TO_FEED:
        c = F.col(src)
        if dst == "amount":
            c = c.cast("double")
        elif dst == "event_time":
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        cols.append(c.alias(dst))
    return ledger.select(*cols)
