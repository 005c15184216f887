"""Catalog: feed normalisation, keep-latest, rolling features, rule flag."""

from __future__ import annotations

from pyspark.sql import functions as F

from txlens.constants import REQUIRED_COLUMNS
from txlens.functions.rules import rule_hits
from txlens.operators.dedupe import dedupe_latest
from txlens.operators.normalize import event_unix, is_blocked, normalize, parse_event_ts
from txlens.plans import fixtures as fx
from txlens.plans.catalog import register
from txlens.plans.features import FEATURE_COLUMNS, feature_job

FEED_DOUBLES = ["amount", "device_risk", "location_risk", "txn_velocity", "edge_fraud_probability"]
FEAT_OUT = [c for c in FEATURE_COLUMNS if c != "event_ts"]
FEAT_DOUBLES = FEED_DOUBLES + ["rolling_total_spend_24h", "rolling_avg_amount_24h"]


def features(spark, sf, strategy="sweep"):
    """The 19-column feature table of the fixture feed (with duplicates)."""
    return feature_job(fx.transactions(spark, sf, duplicates=True), strategy=strategy)


def _typed_faulty(spark, sf):
    return normalize(fx.raw_feed(spark, sf, faulty=True, duplicates=True))


# -- flagship ----------------------------------------------------------------

@register("features_job", "WITH " + fx.sql_features() + f" SELECT {', '.join(FEAT_OUT)} FROM featr",
          FEAT_DOUBLES)
def features_job(spark, sf):
    """Feed -> normalize -> keep-latest -> 24 h / 10 min features -> rule flag."""
    return features(spark, sf).select(*FEAT_OUT)


@register("win8_rolling_features_sweep",
          "WITH " + fx.sql_features() + f" SELECT {', '.join(FEAT_OUT)} FROM featr", FEAT_DOUBLES)
def win8_sweep(spark, sf):
    """Same table through the hot-key-safe sweep strategy."""
    return features(spark, sf, strategy="sweep").select(*FEAT_OUT)


@register("win8_rolling_features_window",
          "WITH " + fx.sql_features() + f" SELECT {', '.join(FEAT_OUT)} FROM featr", FEAT_DOUBLES)
def win8_window(spark, sf):
    """Same table through the single-shuffle Window strategy."""
    return features(spark, sf, strategy="window").select(*FEAT_OUT)


# -- PRJ / FLT1 ---------------------------------------------------------------

_NORM_OUT = REQUIRED_COLUMNS + ["event_unix"]


@register("prj1_normalize",
          "WITH " + fx.sql_faulty() + f""" SELECT {', '.join(REQUIRED_COLUMNS)},
          CAST(floor(epoch(event_ts)) AS BIGINT) AS event_unix FROM faulty""", FEED_DOUBLES)
def prj1_normalize(spark, sf):
    """String feed with malformed values -> typed columns (bad values NULL)."""
    return _typed_faulty(spark, sf).withColumn("event_unix", event_unix("event_ts")).select(*_NORM_OUT)


@register("prj2_parse_event_ts",
          "WITH " + fx.sql_faulty() + """ SELECT transaction_id, event_time,
          CAST(floor(epoch(event_ts)) AS BIGINT) AS event_unix,
          CAST(epoch_ms(event_ts) % 1000 AS BIGINT) AS event_millis FROM faulty""")
def prj2_parse_event_ts(spark, sf):
    """ISO-8601 text -> timestamp (as epoch seconds + millis); bad text -> NULL."""
    t = _typed_faulty(spark, sf)
    ts = parse_event_ts("event_time")
    return t.select("transaction_id", "event_time", event_unix(ts).alias("event_unix"),
                    (F.unix_millis(ts) % 1000).alias("event_millis"))


@register("prj3_event_unix",
          "WITH " + fx.sql_transactions() + """ SELECT transaction_id,
          CAST(floor(epoch(event_ts)) AS BIGINT) AS event_unix FROM txn""")
def prj3_event_unix(spark, sf):
    t = normalize(fx.transactions(spark, sf))
    return t.select("transaction_id", event_unix("event_ts").alias("event_unix"))


@register("prj4_is_blocked",
          "WITH " + fx.sql_faulty() + """ SELECT transaction_id, status,
          CASE WHEN status = 'blocked' THEN 1 ELSE 0 END AS is_blocked FROM faulty""")
def prj4_is_blocked(spark, sf):
    t = _typed_faulty(spark, sf)
    return t.select("transaction_id", "status", is_blocked("status").alias("is_blocked"))


@register("flt1_drop_null_ids",
          "WITH " + fx.sql_faulty() + """ SELECT transaction_id,
          CAST(floor(epoch(event_ts)) AS BIGINT) AS event_unix FROM faulty WHERE event_ts IS NOT NULL""")
def flt1_drop_null_ids(spark, sf):
    """Rows without id or parseable time dropped (the drop_null_ts option)."""
    t = normalize(fx.raw_feed(spark, sf, faulty=True, duplicates=True), drop_null_ts=True)
    return t.select("transaction_id", event_unix("event_ts").alias("event_unix"))


# -- WIN7 -------------------------------------------------------------------

_DEDUP_SQL = """,
fdedup AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (
      PARTITION BY transaction_id
      ORDER BY event_ts DESC NULLS LAST, user_id DESC NULLS LAST, amount DESC NULLS LAST,
               event_time DESC NULLS LAST, hour DESC NULLS LAST, device_risk DESC NULLS LAST,
               location_risk DESC NULLS LAST, txn_velocity DESC NULLS LAST,
               edge_fraud_probability DESC NULLS LAST, status DESC NULLS LAST) AS rn
    FROM faulty) WHERE rn = 1
)"""


@register("win7_dedupe_latest",
          "WITH " + fx.sql_faulty() + _DEDUP_SQL + f""" SELECT {', '.join(REQUIRED_COLUMNS)},
          CAST(floor(epoch(event_ts)) AS BIGINT) AS event_unix FROM fdedup""", FEED_DOUBLES)
def win7_dedupe_latest(spark, sf):
    """Latest copy per transaction_id, NULL times last, full tie-break."""
    d = dedupe_latest(_typed_faulty(spark, sf), key="transaction_id", order="event_ts")
    return d.withColumn("event_unix", event_unix("event_ts")).select(*_NORM_OUT)


# -- WIN1..WIN5 -----------------------------------------------------------

def _one_feature(name, double):
    sql = "WITH " + fx.sql_features() + f" SELECT transaction_id, user_id, event_unix, {name} FROM featr"

    def q(spark, sf):
        return features(spark, sf).select("transaction_id", "user_id", "event_unix", name)
    return sql, q, ([name] if double else [])


for _key, _col, _dbl in [
    ("win1_rolling_total_spend_24h", "rolling_total_spend_24h", True),
    ("win2_rolling_txn_count_24h", "rolling_txn_count_24h", False),
    ("win3_rolling_avg_amount_24h", "rolling_avg_amount_24h", True),
    ("win4_rolling_blocked_count_24h", "rolling_blocked_count_24h", False),
    ("win5_rolling_txn_count_10m", "rolling_txn_count_10m", False),
]:
    _sql, _q, _d = _one_feature(_col, _dbl)
    register(_key, _sql, _d)(_q)


# -- RUL1 / RUL2 -------------------------------------------------------------

@register("rul1_cloud_rule_risk",
          "WITH " + fx.sql_features() + """ SELECT transaction_id, edge_fraud_probability,
          rolling_txn_count_10m, amount, hour, cloud_rule_risk FROM featr""",
          ["edge_fraud_probability", "amount"])
def rul1_cloud_rule_risk(spark, sf):
    f = features(spark, sf)
    return f.select("transaction_id", "edge_fraud_probability", "rolling_txn_count_10m",
                    "amount", "hour", "cloud_rule_risk")


@register("rul2_rule_hits",
          "WITH " + fx.sql_features() + """ SELECT transaction_id,
          CASE WHEN edge_fraud_probability >= 0.8 THEN 1 ELSE 0 END AS hit_high_probability,
          CASE WHEN rolling_txn_count_10m >= 4 THEN 1 ELSE 0 END AS hit_burst_10m,
          CASE WHEN amount > 250000 AND hour <= 4 THEN 1 ELSE 0 END AS hit_night_high_value,
          CASE WHEN edge_fraud_probability >= 0.8 THEN 'high_probability'
               WHEN rolling_txn_count_10m >= 4 THEN 'burst_10m'
               WHEN amount > 250000 AND hour <= 4 THEN 'night_high_value' END AS first_rule,
          cloud_rule_risk FROM featr""")
def rul2_rule_hits(spark, sf):
    f = features(spark, sf)
    hits = rule_hits()
    return f.select("transaction_id", *[c.alias(n) for n, c in hits.items()], "cloud_rule_risk")


# -- SRT1 -------------------------------------------------------------------

@register("srt1_features_by_time",
          "WITH " + fx.sql_features() + """ SELECT transaction_id, event_unix,
          CAST(row_number() OVER (ORDER BY event_ts, transaction_id) AS BIGINT) AS pos FROM featr""")
def srt1_features_by_time(spark, sf):
    """Global ascending event_ts order of the published table, as a position.

    A range-partitioned sort (``orderBy``) followed by a distributed index: the
    position is the number of rows before the row in that order, computed from
    per-partition counts, not by collecting rows.
    """
    from txlens.operators.ordering import global_position
    f = features(spark, sf).select("transaction_id", "event_unix", "event_ts")
    return global_position(f, [F.col("event_ts").asc(), F.col("transaction_id").asc()],
                           "pos").select("transaction_id", "event_unix", "pos")
