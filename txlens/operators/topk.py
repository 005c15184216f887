"""Latest-N pages and top-k (LIM1-LIM3, SRT2, AGG6).

Per-user top-N is ``row_number() <= n`` over the user; Catalyst plans it as a
``WindowGroupLimit`` that also runs before the exchange, so each map task
forwards at most n rows per user however many rows the user has.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txlens import constants as K
from txlens.operators.filters import filter_status


def clamp_limit(limit) -> int:
    """LIM1 page size: truncated, clamped to 1..200, 20 when not a finite number."""
    try:
        x = float(limit)
    except (TypeError, ValueError):
        return K.LATEST_DEFAULT_LIMIT
    if not math.isfinite(x):
        return K.LATEST_DEFAULT_LIMIT
    return min(max(int(math.trunc(x)), K.LATEST_MIN_LIMIT), K.LATEST_MAX_LIMIT)


def latest(df: DataFrame, limit=K.LATEST_DEFAULT_LIMIT, status: str | None = None,
           user_col: str = "user_id", ts_col: str = "event_ts") -> DataFrame:
    """LIM1: each user's newest rows (event time desc, id desc), at most ``limit``.

    Adds ``rank_in_user`` (1 = newest).
    """
    n = clamp_limit(limit)
    w = Window.partitionBy(user_col).orderBy(F.col(ts_col).desc_nulls_last(),
                                             F.col("transaction_id").desc_nulls_last())
    return (filter_status(df, status)
            .withColumn("rank_in_user", F.row_number().over(w))
            .filter(F.col("rank_in_user") <= n))


def top_risk(df: DataFrame, k: int = K.TOP_RISK_ROWS, window_rows: int = 25,
             user_col: str = "user_id", ts_col: str = "event_ts") -> DataFrame:
    """LIM2: the k highest probabilities among each user's latest ``window_rows``.

    Ties keep the newer row first (the stable sort of the original over a list
    that is already newest-first).
    """
    page = latest(df, window_rows, user_col=user_col, ts_col=ts_col)
    w = Window.partitionBy(user_col).orderBy(F.col("edge_fraud_probability").desc_nulls_last(),
                                             F.col("rank_in_user").asc())
    return (page.withColumn("risk_rank", F.row_number().over(w))
            .filter(F.col("risk_rank") <= k))


def feed(df: DataFrame, n: int = K.FEED_ROWS, user_col: str = "user_id", ts_col: str = "event_ts") -> DataFrame:
    """LIM3: the first n rows of each user's latest list."""
    return latest(df, n, user_col=user_col, ts_col=ts_col)


def page_summary(df: DataFrame, limit=120, status: str | None = None,
                 user_col: str = "user_id", ts_col: str = "event_ts") -> DataFrame:
    """AGG6: approved count, blocked count and approved amount over each user's latest page."""
    page = latest(df, limit, status=status, user_col=user_col, ts_col=ts_col)
    return page.groupBy(user_col).agg(
        F.count_if(F.col("status") == "approved").alias("approved_count"),
        F.count_if(F.col("status") == "blocked").alias("blocked_count"),
        F.coalesce(F.sum(F.when(F.col("status") == "approved", F.col("amount"))),
                   F.lit(0.0)).alias("approved_amount"),
    )


def scores_order() -> list:
    """SRT2: descending score, ties by user."""
    return [F.col("risk_score").desc(), F.col("user_id").asc()]


def scores_desc(user_risk: DataFrame) -> DataFrame:
    """SRT2: user scores ordered by descending score (range-partitioned sort)."""
    return user_risk.orderBy(*scores_order())
