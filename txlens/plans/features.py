"""The feature job: feed -> normalize -> keep-latest -> rolling features -> rule flag.

Output: the ten feed columns plus ``event_ts, event_unix, is_blocked``, the
five rolling columns and ``cloud_rule_risk`` (19 columns).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txlens.constants import REQUIRED_COLUMNS
from txlens.functions.rules import cloud_rule_risk
from txlens.operators.dedupe import dedupe_latest
from txlens.operators.normalize import event_unix, is_blocked, normalize
from txlens.operators.rolling import FEATURE_SPECS, rolling_features

FEATURE_COLUMNS = REQUIRED_COLUMNS + [
    "event_ts", "event_unix", "is_blocked",
    "rolling_total_spend_24h", "rolling_txn_count_24h", "rolling_avg_amount_24h",
    "rolling_blocked_count_24h", "rolling_txn_count_10m", "cloud_rule_risk",
]


def compute_features(txns: DataFrame, strategy: str = "sweep", cell_seconds: int = 3600) -> DataFrame:
    """Features of an already typed and deduplicated feed (with ``event_ts``)."""
    enriched = (txns.withColumn("event_unix", event_unix("event_ts"))
                .withColumn("is_blocked", is_blocked("status")))
    feats = rolling_features(enriched, FEATURE_SPECS, key="user_id", order="event_unix",
                             strategy=strategy, cell_seconds=cell_seconds)
    return feats.withColumn("cloud_rule_risk", cloud_rule_risk()).select(*FEATURE_COLUMNS)


def feature_job(feed: DataFrame, strategy: str = "sweep", drop_null_ts: bool = False,
                sort_output: bool = False, cell_seconds: int = 3600) -> DataFrame:
    """Whole job on a raw (string) or typed feed.

    ``strategy``: see :mod:`txlens.operators.rolling`.  ``sort_output`` adds the
    global ``event_ts`` order of the published table (SRT1); leave it off
    when the consumer does not need row order.
    """
    typed = normalize(feed, drop_null_ts=drop_null_ts)
    latest = dedupe_latest(typed, key="transaction_id", order="event_ts")
    out = compute_features(latest, strategy=strategy, cell_seconds=cell_seconds)
    if sort_output:
        out = out.orderBy(F.col("event_ts").asc())
    return out
