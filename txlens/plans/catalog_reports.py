"""Catalog: per-user reports, pages, top-k and joins of the read side."""

from __future__ import annotations

from pyspark.sql import functions as F

from txlens.operators import reports as RP
from txlens.operators import topk as TK
from txlens.operators.joins import orphans, user_transactions, with_profile
from txlens.plans import fixtures as fx
from txlens.plans.catalog import register
from txlens.plans.catalog_features import features

SESS = "WITH " + fx.sql_sessions()


def _sess(spark, sf):
    return fx.sessions(spark, sf)


@register("agg3_summary", SESS + """ SELECT user_id, count(*) AS total_transactions,
          count(*) FILTER (WHERE status = 'blocked') AS total_blocked,
          coalesce(sum(amount) FILTER (WHERE status = 'approved'), 0.0) AS approved_volume
          FROM sess GROUP BY user_id""", ["approved_volume"])
def agg3(spark, sf):
    return RP.summary(_sess(spark, sf))


_COUNTS = """ SELECT user_id, count(*) FILTER (WHERE status = 'approved') AS approved_count,
          count(*) FILTER (WHERE status = 'blocked') AS blocked_count FROM sess GROUP BY user_id"""


@register("agg4_status_counts", SESS + _COUNTS)
def agg4(spark, sf):
    return RP.status_counts(_sess(spark, sf))


@register("agg5_block_rate", SESS + ", cnt AS (" + _COUNTS + """)
          SELECT user_id, approved_count, blocked_count,
          CASE WHEN approved_count + blocked_count > 0
               THEN CAST(floor(CAST(blocked_count AS DOUBLE) / (approved_count + blocked_count) * 100.0 + 0.5) AS BIGINT)
               ELSE 0 END AS block_rate FROM cnt""")
def agg5(spark, sf):
    return RP.block_rate(RP.status_counts(_sess(spark, sf)))


_LATEST = """ SELECT *, row_number() OVER (PARTITION BY user_id
              ORDER BY event_ts DESC NULLS LAST, transaction_id DESC NULLS LAST) AS rank_in_user FROM sess"""


@register("agg6_page_summary", SESS + ", lat AS (" + _LATEST + """)
          SELECT user_id, count(*) FILTER (WHERE status = 'approved') AS approved_count,
          count(*) FILTER (WHERE status = 'blocked') AS blocked_count,
          coalesce(sum(amount) FILTER (WHERE status = 'approved'), 0.0) AS approved_amount
          FROM lat WHERE rank_in_user <= 120 GROUP BY user_id""", ["approved_amount"])
def agg6(spark, sf):
    """Counts and approved amount over each user's latest 120 rows."""
    return TK.page_summary(_sess(spark, sf), 120)


@register("agg7_status_ratio", SESS + """ SELECT status, count(transaction_id) AS transactions,
          count(transaction_id) / sum(count(transaction_id)) OVER () AS share FROM sess GROUP BY status""",
          ["share"])
def agg7(spark, sf):
    return RP.status_ratio(_sess(spark, sf))


@register("agg8_trend", "WITH " + fx.sql_features() + """ SELECT
          CAST(epoch(time_bucket(INTERVAL 1 HOUR, event_ts)) AS BIGINT) AS bucket_start,
          count(*) AS transactions, sum(amount) AS amount,
          sum(rolling_total_spend_24h) AS rolling_total_spend_24h
          FROM featr GROUP BY 1""", ["amount", "rolling_total_spend_24h"])
def agg8(spark, sf):
    """Hourly tumbling buckets of amount and rolling spend (the trend line)."""
    return RP.trend(features(spark, sf), "1 hour")


@register("agg12_filtered_count", SESS + """ SELECT user_id, count(*) AS matching FROM sess
          WHERE status = 'blocked' GROUP BY user_id""")
def agg12(spark, sf):
    return RP.filtered_count(_sess(spark, sf), "blocked")


@register("lim1_latest", SESS + ", lat AS (" + _LATEST + """)
          SELECT user_id, transaction_id, CAST(rank_in_user AS INTEGER) AS rank_in_user FROM lat WHERE rank_in_user <= 20""")
def lim1(spark, sf):
    """Each user's 20 newest transactions (default page size)."""
    return TK.latest(_sess(spark, sf), "not-a-number").select("user_id", "transaction_id", "rank_in_user")


@register("lim1_latest_blocked_200", SESS + """, lat AS (SELECT *, row_number() OVER (PARTITION BY user_id
          ORDER BY event_ts DESC NULLS LAST, transaction_id DESC NULLS LAST) AS rank_in_user FROM sess
          WHERE status = 'blocked') SELECT user_id, transaction_id, CAST(rank_in_user AS INTEGER) AS rank_in_user FROM lat WHERE rank_in_user <= 200""")
def lim1_blocked(spark, sf):
    """Blocked rows only, page size 999.9 clamped to 200."""
    return TK.latest(_sess(spark, sf), 999.9, status="blocked").select("user_id", "transaction_id", "rank_in_user")


@register("lim2_top_risk", SESS + ", lat AS (" + _LATEST + """),
          top AS (SELECT *, row_number() OVER (PARTITION BY user_id
                  ORDER BY edge_fraud_probability DESC NULLS LAST, rank_in_user) AS risk_rank
                  FROM lat WHERE rank_in_user <= 25)
          SELECT user_id, transaction_id, edge_fraud_probability, CAST(risk_rank AS INTEGER) AS risk_rank FROM top WHERE risk_rank <= 3""",
          ["edge_fraud_probability"])
def lim2(spark, sf):
    t = TK.top_risk(_sess(spark, sf), 3, 25)
    return t.select("user_id", "transaction_id", "edge_fraud_probability", "risk_rank")


@register("lim3_feed", SESS + ", lat AS (" + _LATEST + """)
          SELECT user_id, transaction_id, amount, status, CAST(rank_in_user AS INTEGER) AS rank_in_user FROM lat WHERE rank_in_user <= 7""",
          ["amount"])
def lim3(spark, sf):
    return TK.feed(_sess(spark, sf), 7).select("user_id", "transaction_id", "amount", "status", "rank_in_user")


_PROF = "WITH " + fx.sql_profiles()


@register("jon2_with_profile", _PROF + """ SELECT u.id, u.email, u.name,
          CAST(coalesce(p.account_balance, 0) AS DOUBLE) AS account_balance,
          CAST(coalesce(p.monthly_income, 0) AS DOUBLE) AS monthly_income,
          coalesce(p.risk_appetite, 'balanced') AS risk_appetite,
          CASE WHEN p.user_id IS NOT NULL THEN 1 ELSE 0 END AS has_profile
          FROM usr u LEFT JOIN prof p ON u.id = p.user_id""", ["account_balance", "monthly_income"])
def jon2(spark, sf):
    j = with_profile(fx.users(spark, sf), fx.profiles(spark, sf))
    return j.withColumn("has_profile", F.col("has_profile").cast("int"))


@register("jon3_user_transactions", _PROF + ", " + fx.sql_sessions() + """
          SELECT u.id, u.name, s.transaction_id, s.amount FROM usr u JOIN sess s ON u.id = s.user_id""",
          ["amount"])
def jon3(spark, sf):
    j = user_transactions(fx.users(spark, sf), _sess(spark, sf))
    return j.select("id", "name", "transaction_id", "amount")


@register("jon5_orphans", _PROF + ", " + fx.sql_sessions() + """
          SELECT s.transaction_id, s.user_id FROM sess s
          WHERE NOT EXISTS (SELECT 1 FROM prof p WHERE p.user_id = s.user_id)""")
def jon5(spark, sf):
    """Transactions whose user has no profile row (foreign-key check against profiles)."""
    p = fx.profiles(spark, sf).select(F.col("user_id").alias("id"))
    return orphans(_sess(spark, sf), p).select("transaction_id", "user_id")
