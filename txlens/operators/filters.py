"""Row filters (FLT4-FLT7).  Plain predicates: Catalyst pushes them into the
parquet scan where the column comes straight from the file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txlens import constants as K


def filter_status(df: DataFrame, status: str | None) -> DataFrame:
    """FLT4: keep one status; any value other than approved/blocked means no filter."""
    if status in K.TXN_STATUSES:
        return df.filter(F.col("status") == status)
    return df


def split_by_flag(df: DataFrame, flag: str = "cloud_rule_risk") -> tuple[DataFrame, DataFrame]:
    """FLT5: (flagged rows, normal rows); rows with a NULL flag are in neither."""
    return df.filter(F.col(flag) == 1), df.filter(F.col(flag) == 0)


def drop_non_finite(df: DataFrame, cols: list[str]) -> DataFrame:
    """FLT6: rows with NULL, NaN or +-Inf in any of ``cols`` are dropped.

    One comparison per column: Spark orders NaN above +Inf, so ``abs(x) < +Inf``
    is false for NaN and both infinities, and a NULL fails the filter.  Each
    column is referenced once, so the predicate Catalyst pushes below the
    projections that compute the columns stays small (one copy of each
    expression, one compact generated method).
    """
    types = dict(df.dtypes)
    cond = None
    for c in cols:
        if types[c] in ("double", "float"):
            ok = F.abs(F.col(c)) < F.lit(float("inf"))
        else:
            ok = F.col(c).isNotNull()
        cond = ok if cond is None else cond & ok
    return df if cond is None else df.filter(cond)


def high_risk_users(user_risk: DataFrame, threshold: float = K.BLACKLIST_SCORE_ABOVE) -> DataFrame:
    """FLT7: users whose score is strictly above the threshold."""
    return user_risk.filter(F.col("risk_score") > threshold)
