"""Catalog: the account ledger (balance gate, closing balance, full decision
order, skip-duplicate inserts and upserts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from txlens.operators.ledger import balance_gate, closing_balance, insert_skip_duplicates, process_transactions, upsert
from txlens.plans import fixtures as fx
from txlens.plans.catalog import ORACLE, register
from txlens.plans.catalog_io import scratch
from txlens.sources.merge_table import MergeTable, create_merge_table


def _fold_sql(ledger_cte: str, prof_cte: str) -> str:
    """Recursive CTE ``fold``: the balance fold, row by row per user."""
    return f""",
ord AS (
  SELECT l.*, p.account_balance AS opening,
         row_number() OVER (PARTITION BY l.user_id ORDER BY l.event_ts NULLS FIRST, l.transaction_id NULLS FIRST,
                            l.amount NULLS FIRST) AS rn
  FROM {ledger_cte} l LEFT JOIN {prof_cte} p ON l.user_id = p.user_id
),
fold AS (
  SELECT user_id, rn, transaction_id, amount, status, opening,
         CASE WHEN status <> 'approved' OR status IS NULL THEN 'accepted'
              WHEN opening IS NULL OR opening < amount THEN 'rejected' ELSE 'accepted' END AS decision,
         CASE WHEN status = 'approved' AND opening IS NULL THEN 1
              WHEN status = 'approved' AND opening < amount THEN 2 ELSE 0 END AS why,
         CASE WHEN status = 'approved' AND opening >= amount THEN opening - amount ELSE opening END AS bal
  FROM ord WHERE rn = 1
  UNION ALL
  SELECT o.user_id, o.rn, o.transaction_id, o.amount, o.status, o.opening,
         CASE WHEN o.status <> 'approved' OR o.status IS NULL THEN 'accepted'
              WHEN f.bal IS NULL OR f.bal < o.amount THEN 'rejected' ELSE 'accepted' END,
         CASE WHEN o.status = 'approved' AND f.bal IS NULL THEN 1
              WHEN o.status = 'approved' AND f.bal < o.amount THEN 2 ELSE 0 END,
         CASE WHEN o.status = 'approved' AND f.bal >= o.amount THEN f.bal - o.amount ELSE f.bal END
  FROM fold f JOIN ord o ON o.user_id = f.user_id AND o.rn = f.rn + 1
)"""


_FOLD_OUT = """ SELECT transaction_id, user_id, decision,
  CASE WHEN why = 1 THEN 'Financial profile not found.' WHEN why = 2 THEN 'Insufficient account balance.'
       ELSE 'Transaction forwarded to cloud processor' END AS message,
  CASE WHEN decision = 'accepted' AND status = 'approved' THEN 1 ELSE 0 END AS debited,
  CAST(bal AS DOUBLE) AS balance_after FROM fold"""

ORDER_LEDGER_SQL = "WITH RECURSIVE " + fx.sql_order_ledger() + _fold_sql("oled", "oprof")


def _gate_out(g):
    return g.select("transaction_id", "user_id", "decision", "message", "debited",
                    F.col("balance_after").cast("double").alias("balance_after"))


@register("led1_balance_gate", ORDER_LEDGER_SQL + _FOLD_OUT, ["balance_after"])
def led1(spark, sf):
    """Orders as a ledger: each customer's orders in date order against |acctbal| * 100."""
    g = balance_gate(fx.order_ledger(spark, sf), fx.order_profiles(spark, sf))
    return _gate_out(g)


EVENT_LEDGER_SQL = ("WITH RECURSIVE " + fx.sql_transactions() + ", " + fx.sql_profiles() + """,
eled AS (SELECT transaction_id, user_id, CAST(amount AS DECIMAL(14,2)) AS amount, event_ts, status FROM txn)"""
                    + _fold_sql("eled", "prof"))


@register("led1_balance_gate_events", EVENT_LEDGER_SQL + _FOLD_OUT, ["balance_after"])
def led1_events(spark, sf):
    """The event feed as a ledger: ten users with ~1/10 of all rows each, one without profile."""
    t = fx.transactions(spark, sf).withColumn("event_ts", F.try_to_timestamp("event_time"))
    t = t.select("transaction_id", "user_id", F.col("amount").cast("decimal(14,2)").alias("amount"),
                 "event_ts", "status")
    return _gate_out(balance_gate(t, fx.profiles(spark, sf)))


@register("led2_closing_balance", ORDER_LEDGER_SQL + """,
          spent AS (SELECT user_id, sum(amount) FILTER (WHERE decision = 'accepted' AND status = 'approved') AS s
                    FROM fold GROUP BY user_id)
          SELECT p.user_id, CAST(p.account_balance AS DOUBLE) AS opening_balance,
                 CAST(p.account_balance - coalesce(s.s, 0) AS DOUBLE) AS closing_balance
          FROM oprof p LEFT JOIN spent s ON p.user_id = s.user_id""", ["opening_balance", "closing_balance"])
def led2(spark, sf):
    prof = fx.order_profiles(spark, sf)
    g = balance_gate(fx.order_ledger(spark, sf), prof)
    return closing_balance(prof, g)


def _led3_blacklist(spark, sf):
    """Blacklisted: customers of the 'aggressive' appetite segment (MACHINERY)."""
    c = fx.table(spark, sf, "customer")
    return c.filter(F.col("c_mktsegment") == "MACHINERY").select(
        F.concat(F.lit("u"), ((F.col("c_custkey") - 1)).cast("string")).alias("user_id"))


@register("led3_process_transactions", "WITH RECURSIVE " + fx.sql_raw_faulty() + ", " + fx.sql_profiles() + """,
          bl AS (SELECT 'u' || CAST(c_custkey - 1 AS VARCHAR) AS user_id FROM customer WHERE c_mktsegment = 'MACHINERY'),
          feed AS (SELECT * FROM rawf),
          denied AS (SELECT transaction_id, user_id, 403 AS code, 'rejected' AS decision,
                     'Account locked by Cloud Risk Intelligence (R-Cluster Anomaly).' AS message
                     FROM feed WHERE user_id IN (SELECT user_id FROM bl)),
          allowed AS (SELECT * FROM feed WHERE user_id NOT IN (SELECT user_id FROM bl)),
          chk AS (SELECT *, """ + "(" + " AND ".join([
    "(TRY_CAST(amount AS DOUBLE) IS NOT NULL AND NOT isnan(TRY_CAST(amount AS DOUBLE)) AND NOT isinf(TRY_CAST(amount AS DOUBLE)) AND TRY_CAST(amount AS DOUBLE) > 0)",
    "(coalesce(regexp_full_match(event_time, '\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?Z'), false) AND TRY_CAST(event_time AS TIMESTAMP) IS NOT NULL)",
    "(TRY_CAST(hour AS DOUBLE) BETWEEN 0 AND 23 AND TRY_CAST(hour AS DOUBLE) = floor(TRY_CAST(hour AS DOUBLE)))",
    "(TRY_CAST(device_risk AS DOUBLE) BETWEEN 0 AND 1)", "(TRY_CAST(location_risk AS DOUBLE) BETWEEN 0 AND 1)",
    "(TRY_CAST(txn_velocity AS DOUBLE) BETWEEN 0 AND 10000)", "(TRY_CAST(edge_fraud_probability AS DOUBLE) BETWEEN 0 AND 1)",
    "coalesce(status IN ('approved', 'blocked'), false)"]) + """) AS ok FROM allowed),
          invalid AS (SELECT transaction_id, user_id, 400 AS code, 'rejected' AS decision,
                      'Invalid transaction payload.' AS message FROM chk WHERE NOT ok),
          vled AS (SELECT transaction_id, user_id, CAST(TRY_CAST(amount AS DOUBLE) AS DECIMAL(14,2)) AS amount,
                   TRY_CAST(event_time AS TIMESTAMP) AS event_ts, status FROM chk WHERE ok)"""
          + _fold_sql("vled", "prof") + """
          SELECT transaction_id, user_id, CAST(code AS INTEGER) AS code, decision, message FROM denied
          UNION ALL SELECT transaction_id, user_id, CAST(code AS INTEGER), decision, message FROM invalid
          UNION ALL SELECT transaction_id, user_id, CAST(CASE WHEN decision = 'accepted' THEN 200 ELSE 400 END AS INTEGER),
                    decision, CASE WHEN why = 1 THEN 'Financial profile not found.'
                                   WHEN why = 2 THEN 'Insufficient account balance.'
                                   ELSE 'Transaction forwarded to cloud processor' END FROM fold""")
def led3(spark, sf):
    """Blacklist -> validation -> balance gate over the faulty feed (duplicates included)."""
    feed = fx.raw_feed(spark, sf, faulty=True, duplicates=True)
    return process_transactions(feed, _led3_blacklist(spark, sf), fx.profiles(spark, sf))


@register("snk4_insert_skip_duplicates", """
  WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders),
  existing AS (SELECT o_orderkey FROM o WHERE o_orderdate < TIMESTAMP '1997-01-01'),
  batch AS (SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, 0 AS seq FROM o
            UNION ALL SELECT o_orderkey, o_custkey + 1, o_orderdate, o_totalprice, 1 AS seq FROM o WHERE o_custkey % 3 = 0),
  fresh AS (SELECT * FROM batch WHERE o_orderkey NOT IN (SELECT o_orderkey FROM existing)),
  firsts AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY seq) AS rn FROM fresh)
  SELECT o_orderkey, o_custkey, seq FROM firsts WHERE rn = 1""")
def snk4(spark, sf):
    """Orders from 1997 on appended to a ledger holding the older ones; in-batch
    repeats (a second copy of some orders) are skipped, first one wins."""
    o = fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    existing = o.filter(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
    batch = (o.withColumn("seq", F.lit(0))
             .unionByName(o.filter(F.col("o_custkey") % 3 == 0)
                          .withColumn("o_custkey", F.col("o_custkey") + 1).withColumn("seq", F.lit(1))))
    return insert_skip_duplicates(existing, batch, "o_orderkey", "seq").select("o_orderkey", "o_custkey", "seq")


@register("snk5_profile_upsert", "WITH " + fx.sql_profiles() + """,
  upd AS (SELECT id AS user_id, CASE WHEN hash_even THEN 123.45 END AS monthly_income FROM
          (SELECT id, CAST(substr(id, 2) AS INTEGER) % 2 = 0 AS hash_even FROM usr
           UNION ALL SELECT 'new' || id, CAST(substr(id, 2) AS INTEGER) % 2 = 0 FROM usr))
  SELECT coalesce(p.user_id, u.user_id) AS user_id,
         CAST(CASE WHEN p.user_id IS NULL THEN 0 ELSE p.account_balance END AS DOUBLE) AS account_balance,
         CAST(coalesce(u.monthly_income, CASE WHEN p.user_id IS NULL THEN 0 ELSE p.monthly_income END) AS DOUBLE) AS monthly_income,
         CASE WHEN p.user_id IS NULL THEN 'balanced' ELSE p.risk_appetite END AS risk_appetite
  FROM prof p FULL OUTER JOIN upd u ON p.user_id = u.user_id""", ["account_balance", "monthly_income"])
def snk5_profiles(spark, sf):
    """Profiles upserted: known users keep what the batch leaves out, new ones get
    balance 0, income 0 and appetite 'balanced'."""
    ids = fx.users(spark, sf).select("id")
    ids = ids.select(F.col("id").alias("user_id"), "id").unionByName(ids.select(F.concat(F.lit("new"), "id").alias("user_id"), "id"))
    even = F.substring("id", 2, 10).cast("int") % 2 == 0
    batch = ids.select("user_id", F.when(even, F.lit("123.45").cast("decimal(14,2)")).alias("monthly_income"))
    return upsert(fx.profiles(spark, sf), batch, "user_id",
                  {"account_balance": 0, "monthly_income": 0, "risk_appetite": "balanced"})


@register("snk5_upsert", """
  WITH old AS (SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 4 <> 0),
  upd AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || ' (updated)' END AS c_name,
                 c_acctbal + 1.0 AS c_acctbal FROM customer WHERE c_custkey % 3 = 0)
  SELECT coalesce(o.c_custkey, u.c_custkey) AS c_custkey, coalesce(u.c_name, o.c_name) AS c_name,
         coalesce(u.c_acctbal, o.c_acctbal) AS c_acctbal, o.c_mktsegment AS c_mktsegment
  FROM old o FULL OUTER JOIN upd u ON o.c_custkey = u.c_custkey""", ["c_acctbal"])
def snk5(spark, sf):
    """Customer snapshot upserted with a partial batch (absent fields keep old values)."""
    c = fx.table(spark, sf, "customer")
    old = c.filter(F.col("c_custkey") % 4 != 0).select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    upd = c.filter(F.col("c_custkey") % 3 == 0).select(
        "c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit(" (updated)"))).alias("c_name"),
        (F.col("c_acctbal") + 1.0).alias("c_acctbal"))
    return upsert(old, upd, "c_custkey")


@register("snk5_bucketed_merge", ORACLE["snk5_upsert"])
def snk5_merge(spark, sf):
    """The customer upsert as merges into a bucketed table, a part of the keys per
    batch and one batch sent twice; each rewrites the buckets of its keys only."""
    c = fx.table(spark, sf, "customer")
    path = f"{scratch(spark, 'merge')}/customers"
    create_merge_table(c.filter(F.col("c_custkey") % 4 != 0).select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"),
                       path, "c_custkey", buckets=16)
    upd = c.filter(F.col("c_custkey") % 3 == 0).select(
        "c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit(" (updated)"))).alias("c_name"),
        (F.col("c_acctbal") + 1.0).alias("c_acctbal"))
    for part in (0, 1, 1, 2):
        MergeTable(spark, path).merge(upd.filter(F.pmod(F.xxhash64("c_custkey"), F.lit(3)) == part),
                                      stream="customers", batch_id=part)
    return MergeTable(spark, path).read()
