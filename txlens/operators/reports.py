"""Per-user and global report aggregates (AGG3-AGG8, AGG12, WIN6).

All are single ``groupBy`` aggregations with map-side partial aggregation, so
a user with a huge share of the rows costs one partial row per input
partition, not one task holding all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txlens.functions.rules import pct
from txlens.functions.scalars import with_scalars
from txlens.operators.filters import filter_status


def summary(df: DataFrame, user_col: str = "user_id") -> DataFrame:
    """AGG3: total count, blocked count and approved volume (0 when none) per user."""
    return df.groupBy(user_col).agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count_if(F.col("status") == "blocked").alias("total_blocked"),
        F.coalesce(F.sum(F.when(F.col("status") == "approved", F.col("amount"))),
                   F.lit(0).cast("double")).alias("approved_volume"),
    )


def status_counts(df: DataFrame, user_col: str = "user_id") -> DataFrame:
    """AGG4: approved and blocked counts per user (one pass, no pivot shuffle)."""
    return df.groupBy(user_col).agg(
        F.count_if(F.col("status") == "approved").alias("approved_count"),
        F.count_if(F.col("status") == "blocked").alias("blocked_count"),
    )


def block_rate(counts: DataFrame) -> DataFrame:
    """AGG5: whole-percent blocked share (half up), 0 when a user has no rows."""
    total = F.col("approved_count") + F.col("blocked_count")
    return counts.withColumn(
        "block_rate", F.when(total > 0, pct(F.col("blocked_count") / total)).otherwise(F.lit(0).cast("long")))


def status_ratio(df: DataFrame) -> DataFrame:
    """AGG7: transactions per status and their share.

    The total is one partially aggregated row, applied as a constant: a free-text
    status never brings all its values into one task.
    """
    counts = df.groupBy("status").agg(F.count("transaction_id").alias("transactions"))
    total = counts.agg(F.sum("transactions").alias("__total"))
    return with_scalars(counts, total).select("status", "transactions", (F.col("transactions") / F.col("__total")).alias("share"))


def trend(df: DataFrame, every: str = "1 hour", ts_col: str = "event_ts") -> DataFrame:
    """AGG8: amount and rolling 24 h spend summed per tumbling time bucket; rows
    without a time form the bucket NULL (``window`` itself would drop them)."""
    aggs = [F.count(F.lit(1)).alias("transactions"), F.sum("amount").alias("amount"),
            F.sum("rolling_total_spend_24h").alias("rolling_total_spend_24h")]
    timed = (df.groupBy(F.window(ts_col, every).alias("bucket")).agg(*aggs)
             .select(F.unix_seconds(F.col("bucket.start")).alias("bucket_start"),
                     "transactions", "amount", "rolling_total_spend_24h"))
    untimed = (df.filter(F.col(ts_col).isNull()).agg(*aggs).filter(F.col("transactions") > 0)
               .select(F.lit(None).cast("long").alias("bucket_start"), "transactions", "amount", "rolling_total_spend_24h"))
    return timed.unionByName(untimed)


def filtered_count(df: DataFrame, status: str | None = None, user_col: str = "user_id") -> DataFrame:
    """AGG12: exact number of rows per user matching the status filter."""
    return filter_status(df, status).groupBy(user_col).agg(F.count(F.lit(1)).alias("matching"))


def velocity_24h(df: DataFrame, as_of=None, user_col: str = "user_id", ts_col: str = "event_ts") -> DataFrame:
    """WIN6: per user, the approved amount with ``as_of - event_ts <= 24 h``.

    ``as_of`` is a timestamp literal/column; by default the latest event time
    in the data (a one-row aggregate, applied as a constant).
    The original has no lower bound either; with the default ``as_of`` nothing
    lies in the future.  Users without approved rows in the frame get 0.
    """
    if as_of is None:
        base = with_scalars(df, df.agg(F.max(F.col(ts_col).cast("timestamp")).alias("__as_of")))
    else:
        base = df.withColumn("__as_of", F.lit(as_of).cast("timestamp") if not hasattr(as_of, "_jc") else as_of)
    age = F.unix_millis(F.col("__as_of")) - F.unix_millis(F.col(ts_col).cast("timestamp"))
    inside = (F.col("status") == "approved") & (age <= 24 * 3600 * 1000)
    return base.groupBy(user_col).agg(
        F.coalesce(F.sum(F.when(inside, F.col("amount"))), F.lit(0.0)).alias("velocity_24h"))
