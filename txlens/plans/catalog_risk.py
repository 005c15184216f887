"""Catalog: the risk analysis (cities, rebalancing, scaling, clustering, scores, blacklist)."""

from __future__ import annotations

from pyspark.sql import functions as F

from txlens import constants as K
from txlens.functions.hashing import md5_bigint_sql
from txlens.functions.scalars import one_row
from txlens.operators import risk as RK
from txlens.operators.filters import high_risk_users
from txlens.operators.joins import assign_city, flag_blacklisted
from txlens.operators.ordering import global_position
from txlens.operators.sampling import oversample, with_oversample
from txlens.operators.topk import scores_order
from txlens.plans import fixtures as fx
from txlens.plans.catalog import register
from txlens.plans.catalog_features import features
from txlens.plans.risk_job import scored_rows, weighted_scores
from txlens.session import materialize

SEED = K.RISK_SEED
FLAGGED_AT = "2024-02-01 00:00:00"
CF = K.CLUSTER_FEATURES

_CITIES = ", ".join(f"({i}, '{n}', {lat}, {lon})" for i, (n, lat, lon) in enumerate(K.CITIES))

RISK_SQL = "WITH " + fx.sql_features() + f""",
cities(idx, city, latitude, longitude) AS (VALUES {_CITIES}),
geo AS (
  SELECT f.*, c.city, c.latitude, c.longitude FROM featr f
  JOIN cities c ON c.idx = {md5_bigint_sql(str(SEED), 'f.transaction_id')} % 5
),
cnt AS (SELECT count(*) FILTER (WHERE cloud_rule_risk = 1) AS nf,
               count(*) FILTER (WHERE cloud_rule_risk = 0) AS nn FROM geo),
fr AS (SELECT *, row_number() OVER (ORDER BY transaction_id) AS pos FROM geo WHERE cloud_rule_risk = 1),
draws AS (
  SELECT j, {md5_bigint_sql(str(SEED), "'draw'", 'j')} % nf + 1 AS pos
  FROM (SELECT unnest(range(CASE WHEN nf > 0 THEN least(nn, 2 * nf) ELSE 0 END)) AS j, nf FROM cnt)
),
extra AS (SELECT fr.* EXCLUDE (pos), draws.j AS oversample_draw FROM fr JOIN draws ON fr.pos = draws.pos),
smote AS (
  SELECT *, CAST(NULL AS BIGINT) AS oversample_draw FROM geo
  UNION ALL BY NAME SELECT * FROM extra
),
mm AS (SELECT min(amount) AS a0, max(amount) AS a1,
              min(rolling_total_spend_24h) AS s0, max(rolling_total_spend_24h) AS s1,
              min(location_risk) AS l0, max(location_risk) AS l1,
              min(device_risk) AS d0, max(device_risk) AS d1 FROM smote),
scored AS (
  SELECT smote.*, 100.0 * (
      0.30 * CASE WHEN a1 = a0 THEN 0.0 ELSE (amount - a0) / (a1 - a0) END
    + 0.25 * CASE WHEN s1 = s0 THEN 0.0 ELSE (rolling_total_spend_24h - s0) / (s1 - s0) END
    + 0.20 * CASE WHEN l1 = l0 THEN 0.0 ELSE (location_risk - l0) / (l1 - l0) END
    + 0.20 * CASE WHEN d1 = d0 THEN 0.0 ELSE (device_risk - d0) / (d1 - d0) END
    + 0.05 * cloud_rule_risk) AS risk_score
  FROM smote, mm
),
urisk AS (SELECT user_id, avg(risk_score) AS risk_score FROM scored
          WHERE user_id IS NOT NULL AND risk_score IS NOT NULL GROUP BY user_id)"""


def _smote(spark, sf):
    return with_oversample(materialize(assign_city(features(spark, sf), "transaction_id", SEED)))


def _user_risk(spark, sf):
    return RK.user_risk(weighted_scores(features(spark, sf), SEED), weight="weight")


def _scored(spark, sf):
    return scored_rows(features(spark, sf), SEED, balanced=True, cluster=False)


@register("jon4_assign_city", RISK_SQL + " SELECT transaction_id, city, latitude, longitude FROM geo",
          ["latitude", "longitude"])
def jon4(spark, sf):
    """Each row's city from md5(seed:id) mod 5, joined to the broadcast five-row table."""
    return assign_city(features(spark, sf), "transaction_id", SEED).select(
        "transaction_id", "city", "latitude", "longitude")


@register("smp1_oversample", RISK_SQL + " SELECT oversample_draw, transaction_id, user_id FROM extra")
def smp1(spark, sf):
    """The drawn copies: min(n_normal, 2 n_flagged) flagged rows with replacement."""
    return oversample(assign_city(features(spark, sf), "transaction_id", SEED)).select(
        "oversample_draw", "transaction_id", "user_id")


@register("set1_union_oversampled", RISK_SQL + """ SELECT transaction_id, oversample_draw,
          cloud_rule_risk FROM smote""")
def set1(spark, sf):
    return _smote(spark, sf).select("transaction_id", "oversample_draw", "cloud_rule_risk")


@register("agg9_minmax", RISK_SQL + """ SELECT min(amount) AS amount_min, max(amount) AS amount_max,
          min(device_risk) AS device_risk_min, max(device_risk) AS device_risk_max,
          min(location_risk) AS location_risk_min, max(location_risk) AS location_risk_max,
          min(rolling_total_spend_24h) AS rolling_total_spend_24h_min,
          max(rolling_total_spend_24h) AS rolling_total_spend_24h_max FROM smote""",
          [f"{c}_{n}" for c in CF for n in ("min", "max")])
def agg9(spark, sf):
    return RK.minmax_stats(_smote(spark, sf), CF)


@register("agg10_moments", RISK_SQL + " SELECT " + ", ".join(
    f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std_samp, stddev_pop({c}) AS {c}_std_pop" for c in CF)
    + " FROM smote", [f"{c}_{n}" for c in CF for n in ("mean", "std_samp", "std_pop")])
def agg10(spark, sf):
    """Mean, sample std and population std of the clustering features (rebalanced set)."""
    return RK.moments(_smote(spark, sf), CF)


_Z = ", ".join(
    f"CASE WHEN stddev_samp({c}) OVER () = 0 THEN 0.0 ELSE ({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () END AS {c}_z"
    for c in CF)


@register("ml1_zscore", RISK_SQL + f" SELECT transaction_id, oversample_draw, {_Z} FROM smote",
          [f"{c}_z" for c in CF])
def ml1(spark, sf):
    """z-scores (sample std) of the clustering features over the rebalanced set."""
    z = RK.zscore(_smote(spark, sf), CF, ddof=1)
    return z.select("transaction_id", "oversample_draw", *[f"{c}_z" for c in CF])


@register("ml3_minmax", RISK_SQL + """ SELECT transaction_id, oversample_draw,
          CASE WHEN a1 = a0 THEN 0.0 ELSE (amount - a0) / (a1 - a0) END AS amount_mm,
          CASE WHEN s1 = s0 THEN 0.0 ELSE (rolling_total_spend_24h - s0) / (s1 - s0) END AS rolling_total_spend_24h_mm,
          CASE WHEN l1 = l0 THEN 0.0 ELSE (location_risk - l0) / (l1 - l0) END AS location_risk_mm,
          CASE WHEN d1 = d0 THEN 0.0 ELSE (device_risk - d0) / (d1 - d0) END AS device_risk_mm
          FROM smote, mm""",
          ["amount_mm", "rolling_total_spend_24h_mm", "location_risk_mm", "device_risk_mm"])
def ml3(spark, sf):
    cols = ["amount", "rolling_total_spend_24h", "location_risk", "device_risk"]
    m = RK.minmax(_smote(spark, sf), cols)
    return m.select("transaction_id", "oversample_draw", *[f"{c}_mm" for c in cols])


@register("ml4_risk_score", RISK_SQL + " SELECT transaction_id, oversample_draw, risk_score FROM scored",
          ["risk_score"])
def ml4(spark, sf):
    return _scored(spark, sf).select("transaction_id", "oversample_draw", "risk_score")


@register("agg1_user_risk", RISK_SQL + " SELECT user_id, risk_score FROM urisk", ["risk_score"])
def agg1(spark, sf):
    """Mean risk score per user over the rebalanced rows."""
    return _user_risk(spark, sf)


@register("agg2_hotspots", RISK_SQL + """ SELECT hour, CAST(sum(cloud_rule_risk) AS BIGINT) AS fraud_events
          FROM scored WHERE hour IS NOT NULL GROUP BY hour""")
def agg2(spark, sf):
    return RK.hotspots(weighted_scores(features(spark, sf), SEED), weight="weight")


@register("flt7_high_risk_users", RISK_SQL + """ SELECT 75 AS threshold, user_id, risk_score FROM urisk
          WHERE risk_score > 75 UNION ALL
          SELECT 40 AS threshold, user_id, risk_score FROM urisk WHERE risk_score > 40""", ["risk_score"])
def flt7(spark, sf):
    """Users strictly above 75 (the blacklist rule) and above 40."""
    ur = _user_risk(spark, sf)
    return (high_risk_users(ur, 75).select(F.lit(75).alias("threshold"), "user_id", "risk_score")
            .unionByName(high_risk_users(ur, 40).select(F.lit(40).alias("threshold"), "user_id", "risk_score")))


@register("ml5_blacklist", RISK_SQL + f""" SELECT user_id,
          CAST(epoch(TIMESTAMP '{FLAGGED_AT}') AS BIGINT) AS flagged_at,
          'Cluster anomaly detected by R' AS reason FROM urisk WHERE risk_score > 40""")
def ml5(spark, sf):
    """Blacklist rows (threshold 40 so the fixture yields some; the default is 75)."""
    ur = _user_risk(spark, sf)
    bl = RK.blacklist(ur, FLAGGED_AT, threshold=40)
    return bl.select("user_id", F.unix_seconds("flagged_at").alias("flagged_at"), "reason")


@register("srt2_user_scores_desc", RISK_SQL + """ SELECT user_id, risk_score,
          CAST(row_number() OVER (ORDER BY risk_score DESC, user_id) AS BIGINT) AS pos FROM urisk""",
          ["risk_score"])
def srt2(spark, sf):
    ur = _user_risk(spark, sf)
    return global_position(ur, scores_order(), "pos")


@register("jon1_block_blacklisted", RISK_SQL + """,
          bl AS (SELECT user_id FROM urisk WHERE risk_score > 40),
          sess AS (SELECT * FROM txn_base)
          SELECT transaction_id, user_id,
                 CASE WHEN user_id IN (SELECT user_id FROM bl) THEN 'denied' ELSE 'allowed' END AS decision
          FROM sess""")
def jon1(spark, sf):
    """New transactions checked against the blacklist the risk run produced."""
    ur = _user_risk(spark, sf)
    bl = RK.blacklist(ur, FLAGGED_AT, threshold=40)
    flagged = flag_blacklisted(fx.transactions(spark, sf), bl)
    return flagged.select("transaction_id", "user_id",
                          F.when(F.col("denied"), "denied").otherwise("allowed").alias("decision"))


@register("ml2_kmeans", RISK_SQL + """ SELECT transaction_id, oversample_draw,
          CASE WHEN amount IS NULL OR device_risk IS NULL OR location_risk IS NULL
                    OR rolling_total_spend_24h IS NULL THEN 0 ELSE 1 END AS has_cluster,
          1 AS in_nearest, 1 AS labels_used, 1 AS best_of_starts FROM smote""")
def ml2(spark, sf):
    """Best of 10 k-means starts (k=3) on z-scored features; the cluster ids themselves depend on the algorithm, so the
    query returns what must hold of them.

    Per row: it has a cluster unless a feature is NULL, and that cluster's
    centroid is the nearest one.  In all: the labels are 1..3, and the cost is
    no higher than that of the first start alone.
    """
    z = RK.zscore(_smote(spark, sf), CF, ddof=1)
    zc = [f"{c}_z" for c in CF]
    out, centres, cost = RK.kmeans(z, zc, K.CLUSTER_K, K.CLUSTER_STARTS, SEED)
    _, _, one = RK.kmeans(z, zc, K.CLUSTER_K, 1, SEED)
    far = [sum((F.col(c) - F.lit(v)) ** 2 for c, v in zip(zc, centre)) for centre in centres]
    own = F.element_at(F.array(*far), F.col("cluster"))
    used = one_row(out.agg(F.array_sort(F.collect_set("cluster")).alias("c")))["c"]
    return out.select(
        "transaction_id", "oversample_draw", F.col("cluster").isNotNull().cast("int").alias("has_cluster"),
        F.coalesce(own <= F.least(*far) + 1e-9, F.lit(True)).cast("int").alias("in_nearest"),
        F.lit(int(list(used) == [1, 2, 3])).alias("labels_used"), F.lit(int(cost <= one * (1 + 1e-9))).alias("best_of_starts"))


@register("risk_enriched_rows", RISK_SQL + """ SELECT transaction_id, oversample_draw, user_id, city,
          latitude, longitude, cloud_rule_risk, risk_score FROM scored""",
          ["latitude", "longitude", "risk_score"])
def risk_enriched(spark, sf):
    """The enriched table of the risk run (without the cluster id)."""
    return _scored(spark, sf).select("transaction_id", "oversample_draw", "user_id", "city", "latitude",
                                     "longitude", "cloud_rule_risk", "risk_score")
