"""The risk analysis run over the feature table.

features -> city per row -> rebalancing copies -> z-scored clustering ->
min-max weighted score -> per-user mean, hourly hotspots, blacklist.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txlens import constants as K
from txlens.operators.joins import assign_city
from txlens.operators.risk import blacklist, hotspots, kmeans, risk_score, user_risk, zscore
from txlens.operators.sampling import oversample_weights, with_oversample
from txlens.session import materialize


def scored_rows(features: DataFrame, seed: int = K.RISK_SEED, balanced: bool = True,
                cluster: bool = True, cluster_starts: int = K.CLUSTER_STARTS) -> DataFrame:
    # The feature table is read several times below (counts, numbering of the
    # flagged rows, the union, the statistics): materialise it once.
    geo = materialize(assign_city(features, "transaction_id", seed))
    smote = with_oversample(geo, "cloud_rule_risk", "transaction_id", seed, balanced=balanced)
    if cluster:
        z = zscore(smote, K.CLUSTER_FEATURES, ddof=1)
        zcols = [f"{c}_z" for c in K.CLUSTER_FEATURES]
        smote, _, _ = kmeans(z, zcols, K.CLUSTER_K, cluster_starts, seed)
        smote = smote.drop(*zcols)
    # Drawn copies repeat stored rows: min/max come from the stored rows alone.
    return risk_score(smote, stats_from=geo)


def weighted_scores(features: DataFrame, seed: int = K.RISK_SEED, balanced: bool = True) -> DataFrame:
    """What the aggregates of the risk run need: user_id, hour, flag, risk_score and
    ``weight``, how often the row is in the rebalanced set.

    Only the columns of the score are stored, and the drawn copies are counted,
    not made."""
    narrow = materialize(features.select("transaction_id", "user_id", "hour", "cloud_rule_risk",
                                         *[c for c, _ in K.RISK_WEIGHTS]))
    rows = (oversample_weights(narrow, "cloud_rule_risk", "transaction_id", seed) if balanced
            else narrow.withColumn("weight", F.lit(1).cast("long")))
    return risk_score(rows, stats_from=narrow).select("user_id", "hour", "cloud_rule_risk", "risk_score", "weight")


def risk_job(features: DataFrame, flagged_at, seed: int = K.RISK_SEED, balanced: bool = True,
             cluster: bool = True, cluster_starts: int = K.CLUSTER_STARTS) -> dict[str, DataFrame]:
    features = materialize(features)
    scores = weighted_scores(features, seed, balanced)
    ur = materialize(user_risk(scores, weight="weight"))
    return {
        "enriched": scored_rows(features, seed, balanced, cluster, cluster_starts),
        "user_risk": ur,
        "hotspots": hotspots(scores, weight="weight"),
        "blacklist": blacklist(ur, flagged_at),
    }
