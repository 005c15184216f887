"""WIN7: keep-latest deduplication.

One row per key: the greatest ``event_ts`` (NULL last), ties broken on all
remaining columns in descending order so the result is deterministic.

Plan: ``row_number() = 1`` over the key.  Catalyst turns this into a
``WindowGroupLimit`` that runs on the map side before the exchange, so a key
with very many copies is cut to one row per input partition before anything
is shuffled (the same effect as a partial aggregate).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedupe_latest(df: DataFrame, key: str = "transaction_id", order: str = "event_ts",
                  tie_break: list[str] | None = None) -> DataFrame:
    if tie_break is None:
        tie_break = [c for c in df.columns if c not in (key, order)]
    ordering = [F.col(order).desc_nulls_last()] + [F.col(c).desc_nulls_last() for c in tie_break]
    w = Window.partitionBy(key).orderBy(*ordering)
    return (df.withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") == 1)
            .drop("_rn"))
