"""Catalog: scoring rules, validation, filters and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from txlens import constants as K
from txlens.functions import rules as R
from txlens.operators.filters import drop_non_finite, filter_status, split_by_flag
from txlens.operators.normalize import default_reason, event_unix, ledger_to_feed
from txlens.operators.reports import velocity_24h
from txlens.operators.validate import validate_profiles, validate_transactions
from txlens.plans import fixtures as fx
from txlens.plans.catalog import register
from txlens.plans.catalog_features import FEAT_DOUBLES, FEAT_OUT, features

SESS = "WITH " + fx.sql_sessions()
LIN = ("(0.00002 * amount + 0.8 * (CASE WHEN hour <= 4 THEN 1.0 ELSE 0.0 END) + 1.4 * device_risk"
       " + 1.2 * location_risk + 0.15 * txn_velocity)")


def _sess(spark, sf):
    return fx.sessions(spark, sf)


@register("rul3_heuristic_score",
          SESS + f" SELECT transaction_id, least(greatest(1.0 / (1.0 + exp(-{LIN} + 2.2)), 0.0), 1.0)"
          " AS heuristic_score FROM sess", ["heuristic_score"])
def rul3(spark, sf):
    return _sess(spark, sf).select("transaction_id", R.heuristic_score().alias("heuristic_score"))


@register("rul4_heuristic_label",
          SESS + f" SELECT transaction_id, CASE WHEN {LIN} > 2.2 THEN 1 ELSE 0 END AS label FROM sess")
def rul4(spark, sf):
    return _sess(spark, sf).select("transaction_id", R.heuristic_label().alias("label"))


@register("rul5_edge_decision",
          SESS + """ SELECT transaction_id,
          CASE WHEN edge_fraud_probability >= 0.95 THEN 'blocked' ELSE 'approved' END AS decision,
          CASE WHEN edge_fraud_probability >= 0.95 THEN 'Edge anomaly threshold exceeded'
               ELSE 'Standard transfer pattern' END AS decision_reason,
          CASE WHEN edge_fraud_probability >= 0.82 THEN 'blocked' ELSE 'approved' END AS decision_at_082
          FROM sess""")
def rul5(spark, sf):
    """Edge decision at the code threshold 0.95 and at the documented 0.82."""
    return _sess(spark, sf).select(
        "transaction_id", R.edge_status().alias("decision"), R.edge_reason().alias("decision_reason"),
        R.edge_status(threshold=0.82).alias("decision_at_082"))


@register("rul6_risk_band",
          SESS + """ SELECT transaction_id, CASE WHEN status = 'blocked' THEN 'block'
          WHEN edge_fraud_probability >= 0.65 THEN 'flag' ELSE 'safe' END AS risk_band FROM sess""")
def rul6(spark, sf):
    return _sess(spark, sf).select("transaction_id", R.risk_band().alias("risk_band"))


@register("rul7_device_risk",
          SESS + """ SELECT transaction_id, user_id, device_id,
          CASE WHEN row_number() OVER (PARTITION BY user_id, device_id ORDER BY event_ts, transaction_id) = 1
               THEN 0.78 ELSE 0.12 END AS device_signal FROM sess""", ["device_signal"])
def rul7(spark, sf):
    """First sighting of a (user, device) pair scores 0.78, later ones 0.12."""
    return R.device_risk(_sess(spark, sf)).select("transaction_id", "user_id", "device_id", "device_signal")


@register("rul8_location_risk",
          SESS + """ SELECT transaction_id, timezone,
          CASE WHEN NOT starts_with(timezone, 'Asia/') THEN 0.85
               WHEN timezone <> 'Asia/Kolkata' THEN 0.35 ELSE 0.08 END AS location_signal FROM sess""",
          ["location_signal"])
def rul8(spark, sf):
    return _sess(spark, sf).select("transaction_id", "timezone",
                                   R.location_risk_from_zone("timezone").alias("location_signal"))


_VEL_SQL = SESS + """,
reftime AS (SELECT max(event_ts) AS a FROM sess),
vel AS (
  SELECT user_id, coalesce(sum(CASE WHEN status = 'approved'
            AND epoch(a) - epoch(event_ts) <= 86400 THEN amount END), 0.0) AS velocity_24h
  FROM sess, reftime GROUP BY user_id
)"""


@register("win6_velocity_24h", _VEL_SQL + " SELECT user_id, velocity_24h FROM vel", ["velocity_24h"])
def win6(spark, sf):
    """Approved spend per user in the 24 h before the latest event time of the data."""
    return velocity_24h(_sess(spark, sf))


@register("rul9_txn_velocity",
          _VEL_SQL + " SELECT user_id, greatest(1.0, velocity_24h / 1000.0) AS txn_velocity FROM vel",
          ["txn_velocity"])
def rul9(spark, sf):
    v = velocity_24h(_sess(spark, sf))
    return v.select("user_id", R.velocity_from_spend("velocity_24h").alias("txn_velocity"))


@register("rul10_pct",
          SESS + """ SELECT transaction_id,
          CAST(floor(edge_fraud_probability * 100.0 + 0.5) AS BIGINT) AS probability_pct,
          CAST(floor(device_risk * 100.0 + 0.5) AS BIGINT) AS device_pct,
          CAST(floor(location_risk * 100.0 + 0.5) AS BIGINT) AS location_pct FROM sess""")
def rul10(spark, sf):
    s = _sess(spark, sf)
    return s.select("transaction_id", R.pct("edge_fraud_probability").alias("probability_pct"),
                    R.pct("device_risk").alias("device_pct"), R.pct("location_risk").alias("location_pct"))


# -- validation --------------------------------------------------------------

def _num(c):
    return f"TRY_CAST({c} AS DOUBLE)"


def _between(c, lo, hi):
    x = _num(c)
    return f"({x} IS NOT NULL AND NOT isnan({x}) AND NOT isinf({x}) AND {x} >= {lo} AND {x} <= {hi})"


_FLT2_RULES = [
    ("amount_positive", f"({_num('amount')} IS NOT NULL AND NOT isnan({_num('amount')}) AND NOT isinf({_num('amount')}) AND {_num('amount')} > 0)"),
    ("event_time_iso", "(coalesce(regexp_full_match(event_time, '\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?Z'), false)"
                       " AND TRY_CAST(event_time AS TIMESTAMP) IS NOT NULL)"),
    ("hour_int_0_23", f"({_between('hour', 0, 23)} AND {_num('hour')} = floor({_num('hour')}))"),
    ("device_risk_0_1", _between("device_risk", 0, 1)),
    ("location_risk_0_1", _between("location_risk", 0, 1)),
    ("txn_velocity_0_10000", _between("txn_velocity", 0, 10000)),
    ("probability_0_1", _between("edge_fraud_probability", 0, 1)),
    ("status_enum", "coalesce(status IN ('approved', 'blocked'), false)"),
]
_FLT2_FAILED = "concat_ws(',', " + ", ".join(
    f"CASE WHEN NOT {cond} THEN '{name}' END" for name, cond in _FLT2_RULES) + ")"


@register("flt2_validate_transactions",
          "WITH " + fx.sql_raw_faulty() + f""" SELECT transaction_id, {_FLT2_FAILED} AS failed_rules,
          CASE WHEN {_FLT2_FAILED} = '' THEN 1 ELSE 0 END AS is_valid FROM rawf""")
def flt2(spark, sf):
    """Payload rules on the faulty text feed; names of failed rules joined by ','."""
    v = validate_transactions(fx.raw_feed(spark, sf, faulty=True, duplicates=True))
    return v.select("transaction_id", F.concat_ws(",", "failed_rules").alias("failed_rules"),
                    F.col("is_valid").cast("int").alias("is_valid"))


_PROFILE_UPDATES_SQL = """
pupd AS (
  SELECT 'c' || CAST(c_custkey AS VARCHAR) AS user_id,
         CASE WHEN c_custkey % 11 = 0 THEN 'X' ELSE c_name END AS name,
         c_acctbal * 1000.0 AS account_balance,
         abs(c_acctbal) * 100.0 AS monthly_income,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'conservative'
              WHEN c_mktsegment = 'MACHINERY' THEN 'aggressive'
              WHEN c_mktsegment = 'AUTOMOBILE' THEN 'balanced'
              WHEN c_mktsegment = 'FURNITURE' THEN NULL
              ELSE lower(c_mktsegment) END AS risk_appetite
  FROM customer
)"""
_FLT3_RULES = [
    ("name_2_80", "(name IS NULL OR (length(name) >= 2 AND length(name) <= 80))"),
    ("account_balance_range", f"(account_balance IS NULL OR {_between('account_balance', 0, 999999999)})"),
    ("monthly_income_range", f"(monthly_income IS NULL OR {_between('monthly_income', 0, 999999999)})"),
    ("risk_appetite_enum", "(risk_appetite IS NULL OR coalesce(risk_appetite IN ('conservative', 'balanced', 'aggressive'), false))"),
]
_FLT3_FAILED = "concat_ws(',', " + ", ".join(
    f"CASE WHEN NOT {cond} THEN '{name}' END" for name, cond in _FLT3_RULES) + ")"


def profile_updates(spark, sf):
    """Profile updates derived from ``customer`` (some out of bounds by construction)."""
    c = fx.table(spark, sf, "customer")
    seg = F.col("c_mktsegment")
    return c.select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("user_id"),
        F.when(F.col("c_custkey") % 11 == 0, F.lit("X")).otherwise(F.col("c_name")).alias("name"),
        (F.col("c_acctbal") * 1000.0).alias("account_balance"),
        (F.abs(F.col("c_acctbal")) * 100.0).alias("monthly_income"),
        F.when(seg == "BUILDING", "conservative").when(seg == "MACHINERY", "aggressive")
        .when(seg == "AUTOMOBILE", "balanced").when(seg == "FURNITURE", F.lit(None).cast("string"))
        .otherwise(F.lower(seg)).alias("risk_appetite"))


@register("flt3_validate_profiles",
          "WITH " + _PROFILE_UPDATES_SQL + f""" SELECT user_id, {_FLT3_FAILED} AS failed_rules,
          CASE WHEN {_FLT3_FAILED} = '' THEN 1 ELSE 0 END AS is_valid FROM pupd""")
def flt3(spark, sf):
    v = validate_profiles(profile_updates(spark, sf))
    return v.select("user_id", F.concat_ws(",", "failed_rules").alias("failed_rules"),
                    F.col("is_valid").cast("int").alias("is_valid"))


@register("flt4_filter_status",
          SESS + """ SELECT 'blocked' AS filter, transaction_id FROM sess WHERE status = 'blocked'
          UNION ALL SELECT 'all' AS filter, transaction_id FROM sess""")
def flt4(spark, sf):
    """Status filter 'blocked', and an unknown value ('all') that filters nothing."""
    s = _sess(spark, sf)
    return (filter_status(s, "blocked").select(F.lit("blocked").alias("filter"), "transaction_id")
            .unionByName(filter_status(s, "all").select(F.lit("all").alias("filter"), "transaction_id")))


@register("flt5_split_by_flag",
          "WITH " + fx.sql_features() + """ SELECT transaction_id,
          CASE WHEN cloud_rule_risk = 1 THEN 'fraud' ELSE 'normal' END AS side FROM featr""")
def flt5(spark, sf):
    fraud, normal = split_by_flag(features(spark, sf))
    return (fraud.select("transaction_id", F.lit("fraud").alias("side"))
            .unionByName(normal.select("transaction_id", F.lit("normal").alias("side"))))


@register("flt6_drop_non_finite",
          SESS + """ SELECT transaction_id, ratio FROM (
            SELECT transaction_id,
                   CASE WHEN k % 13 = 0 THEN CAST('Infinity' AS DOUBLE)
                        WHEN k % 13 = 1 THEN CAST('-Infinity' AS DOUBLE)
                        WHEN k % 13 = 2 THEN CAST('NaN' AS DOUBLE)
                        ELSE amount / 1000.0 END AS ratio
            FROM sess) WHERE ratio IS NOT NULL AND NOT isnan(ratio) AND NOT isinf(ratio)""", ["ratio"])
def flt6(spark, sf):
    """+-Inf and NaN values (placed by rule on k) become NULL and their rows go."""
    s = _sess(spark, sf)
    ratio = (F.when(F.col("k") % 13 == 0, F.lit(float("inf")))
             .when(F.col("k") % 13 == 1, F.lit(float("-inf")))
             .when(F.col("k") % 13 == 2, F.lit(float("nan")))
             .otherwise(F.col("amount") / 1000.0))
    return drop_non_finite(s.select("transaction_id", ratio.alias("ratio")), ["ratio"])


@register("prj5_ledger_to_feed",
          SESS + """ SELECT transaction_id, user_id, amount,
          strftime(event_ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS event_time, hour, device_risk, location_risk,
          txn_velocity, edge_fraud_probability, status, reason FROM sess""",
          ["amount", "device_risk", "location_risk", "txn_velocity", "edge_fraud_probability"])
def prj5(spark, sf):
    """camelCase ledger records renamed to the feed's snake_case columns."""
    s = _sess(spark, sf)
    ledger = s.select(
        F.col("transaction_id").alias("publicId"), F.col("user_id").alias("userId"),
        "amount",
        F.col("event_ts").alias("eventTime"), "hour", F.col("device_risk").alias("deviceRisk"),
        F.col("location_risk").alias("locationRisk"), F.col("txn_velocity").alias("txnVelocity"),
        F.col("edge_fraud_probability").alias("edgeFraudProbability"), "status", "reason")
    return ledger_to_feed(ledger)


@register("prj6_default_reason",
          SESS + " SELECT transaction_id, coalesce(reason, 'standard transaction pattern') AS reason FROM sess")
def prj6(spark, sf):
    s = _sess(spark, sf)
    return s.select("transaction_id", default_reason("reason").alias("reason"))
