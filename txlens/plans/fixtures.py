"""Test-table views: the transaction feed and the ledger derived from the
driver's parquet tables, in Spark and as DuckDB SQL text for the oracle.

Derivation (see FIXTURES.md):

* ``transaction_id = 't' || event_id``; ``user_id = 'u' || (user_id % 10)``
  (folded so the 10-minute burst rule can fire);
* ``amount = value * 2000``; ``event_time`` = ISO-8601 text with milliseconds
  and ``Z``; ``hour = hour(ts)``;
* ``k`` = the integer in ``props``; probability ``k / 99``; device risk
  ``((k * 37) % 100) / 99``; location risk ``((k * 53) % 100) / 99``;
  velocity ``k % 11``; status ``blocked`` when probability >= 0.95;
* duplicates: rows with ``event_id % 20 = 0`` again, one second later and
  ``blocked`` (the later copy must win the dedupe);
* faults (the ``faulty`` feed only): one broken field per value of ``k``.

Every view reads whole tables; nothing is subset or capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txlens.constants import REQUIRED_COLUMNS

ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k() -> F.Column:
    """The integer in ``props`` (``{"k": N}``).

    Read by position (cheap: Catalyst inlines ``k`` into every predicate that
    uses it), with the JSON parser as fallback for any other layout.
    """
    props = F.col("props")
    direct = props.substr(F.lit(7), F.length(props) - F.lit(7)).try_cast("int")
    return F.when(props.startswith('{"k": ') & props.endswith("}"), direct).otherwise(
        F.get_json_object(props, "$.k").cast("int"))


def transactions(spark: SparkSession, sf_dir: str, duplicates: bool = False,
                 extra: bool = False) -> DataFrame:
    """Typed transaction feed (the ten feed columns) derived from ``events``.

    ``extra=True`` keeps the helper columns ``k`` and ``event_id``.
    """
    ev = table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "value", _k().alias("k"))
    prob = F.col("k") / F.lit(99.0)
    base = ev.select(
        F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("transaction_id"),
        F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")).alias("user_id"),
        (F.col("value") * F.lit(2000.0)).alias("amount"),
        F.date_format("ts", ISO_MILLIS).alias("event_time"),
        F.hour("ts").cast("int").alias("hour"),
        ((F.col("k") * 37) % 100 / F.lit(99.0)).alias("device_risk"),
        ((F.col("k") * 53) % 100 / F.lit(99.0)).alias("location_risk"),
        (F.col("k") % 11).cast("double").alias("txn_velocity"),
        prob.alias("edge_fraud_probability"),
        F.when(prob >= 0.95, F.lit("blocked")).otherwise(F.lit("approved")).alias("status"),
        "k", "event_id", "ts",
    )
    if duplicates:
        dup = (base.filter(F.col("event_id") % 20 == 0)
               .withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 SECOND"))
               .withColumn("event_time", F.date_format("ts", ISO_MILLIS))
               .withColumn("status", F.lit("blocked")))
        base = base.unionByName(dup)
    cols = REQUIRED_COLUMNS + (["k", "event_id"] if extra else [])
    return base.select(*cols)


# Faults injected by the ``faulty`` feed, one per value of k.
# FIXED FIXTURE VALUES: k -> (column, replacement text)
FAULTS = {
    3: ("amount", "-1"),
    5: ("amount", "n/a"),
    7: ("hour", "24"),
    9: ("hour", "12.5"),
    11: ("edge_fraud_probability", "1.5"),
    13: ("status", "pending"),
    15: ("event_time", "not-a-date"),
    17: ("transaction_id", None),
    19: ("device_risk", "-0.5"),
    21: ("txn_velocity", "10001"),
    23: ("event_time", "2024-01-05 10:00:00"),
}


def raw_feed(spark: SparkSession, sf_dir: str, faulty: bool = True,
             duplicates: bool = True) -> DataFrame:
    """The feed as a CSV reader returns it: ten string columns."""
    t = transactions(spark, sf_dir, duplicates=duplicates, extra=True)
    out = []
    for c in REQUIRED_COLUMNS:
        v = F.col(c).cast("string")
        if faulty:
            for k, (col_name, text) in FAULTS.items():
                if col_name == c:
                    v = F.when(F.col("k") == k, F.lit(text).cast("string")).otherwise(v)
        out.append(v.alias(c))
    return t.select(*out)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct folded users of ``events``: id, email, name."""
    return (table(spark, sf_dir, "events")
            .select((F.col("user_id") % 10).alias("n")).distinct()
            .select(F.concat(F.lit("u"), F.col("n").cast("string")).alias("id"),
                    F.concat(F.lit("u"), F.col("n").cast("string"), F.lit("@example.test")).alias("email"),
                    F.concat(F.lit("User "), F.col("n").cast("string")).alias("name")))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Financial profiles of the folded users; user n draws on customer n+1.

    Opening balance = |c_acctbal| * 10000 as DECIMAL(14,2); every seventh user
    (n % 7 = 6) has no profile.
    """
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    u = (table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("n")).distinct()
         .filter(F.col("n") % 7 != 6))
    return (u.join(cust, u.n + 1 == cust.c_custkey, "inner")
            .select(F.concat(F.lit("u"), F.col("n").cast("string")).alias("user_id"),
                    (F.abs(F.col("c_acctbal")) * 10000).cast("decimal(14,2)").alias("account_balance"),
                    (F.abs(F.col("c_acctbal")) * 1000).cast("decimal(14,2)").alias("monthly_income"),
                    F.when(F.col("c_mktsegment") == "BUILDING", "conservative")
                    .when(F.col("c_mktsegment") == "MACHINERY", "aggressive")
                    .otherwise("balanced").alias("risk_appetite")))


def order_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger at join scale: every order is a transaction of its customer.

    status 'blocked' for orderstatus 'P', else 'approved'; event_ts = order date.
    """
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("transaction_id"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("user_id"),
        F.col("o_totalprice").cast("decimal(14,2)").alias("amount"),
        F.col("o_orderdate").cast("timestamp").alias("event_ts"),
        F.when(F.col("o_orderstatus") == "P", "blocked").otherwise("approved").alias("status"),
    )


def order_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening balances for the order ledger: |c_acctbal| * 100; custkey % 7 = 0 has none."""
    c = table(spark, sf_dir, "customer")
    return (c.filter(F.col("c_custkey") % 7 != 0)
            .select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("user_id"),
                    (F.abs(F.col("c_acctbal")) * 100).cast("decimal(14,2)").alias("account_balance")))


# ---------------------------------------------------------------------------
# DuckDB text of the same views (the oracle side)
# ---------------------------------------------------------------------------

def sql_transactions(duplicates: bool = False) -> str:
    """CTE body list producing ``txn`` (ten columns plus event_ts, k, event_id)."""
    base = """
ev AS (
  SELECT event_id, ts, user_id AS uid, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events
),
txn_base AS (
  SELECT 't' || CAST(event_id AS VARCHAR) AS transaction_id,
         'u' || CAST(uid % 10 AS VARCHAR) AS user_id,
         value * 2000.0 AS amount,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS event_time,
         date_trunc('millisecond', ts) AS event_ts,
         CAST(hour(ts) AS INTEGER) AS hour,
         CAST((k * 37) % 100 AS DOUBLE) / 99.0 AS device_risk,
         CAST((k * 53) % 100 AS DOUBLE) / 99.0 AS location_risk,
         CAST(k % 11 AS DOUBLE) AS txn_velocity,
         CAST(k AS DOUBLE) / 99.0 AS edge_fraud_probability,
         CASE WHEN CAST(k AS DOUBLE) / 99.0 >= 0.95 THEN 'blocked' ELSE 'approved' END AS status,
         k, event_id, ts
  FROM ev
)"""
    if duplicates:
        base += """,
txn AS (
  SELECT * FROM txn_base
  UNION ALL
  SELECT transaction_id, user_id, amount,
         strftime(ts + INTERVAL 1 SECOND, '%Y-%m-%dT%H:%M:%S.%gZ') AS event_time,
         date_trunc('millisecond', ts + INTERVAL 1 SECOND) AS event_ts,
         hour, device_risk, location_risk, txn_velocity, edge_fraud_probability,
         'blocked' AS status, k, event_id, ts + INTERVAL 1 SECOND AS ts
  FROM txn_base WHERE event_id % 20 = 0
)"""
    else:
        base += """,
txn AS (SELECT * FROM txn_base)"""
    return base


def sql_dedup() -> str:
    """CTEs ``txn`` (with duplicates) and ``dedup`` (keep-latest)."""
    return sql_transactions(duplicates=True) + """,
dedup AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (
      PARTITION BY transaction_id
      ORDER BY event_ts DESC NULLS LAST, user_id DESC NULLS LAST, amount DESC NULLS LAST,
               event_time DESC NULLS LAST, hour DESC NULLS LAST, device_risk DESC NULLS LAST,
               location_risk DESC NULLS LAST, txn_velocity DESC NULLS LAST,
               edge_fraud_probability DESC NULLS LAST, status DESC NULLS LAST) AS rn
    FROM txn) WHERE rn = 1
)"""


def sql_features() -> str:
    """CTEs up to ``feat``: the 19-column feature table of the deduped feed."""
    return sql_dedup() + """,
enr AS (
  SELECT *, CAST(floor(epoch(event_ts)) AS BIGINT) AS event_unix,
         CASE WHEN status = 'blocked' THEN 1 ELSE 0 END AS is_blocked
  FROM dedup
),
feat AS (
  SELECT *,
    sum(amount) OVER w24 AS rolling_total_spend_24h,
    count(transaction_id) OVER w24 AS rolling_txn_count_24h,
    avg(amount) OVER w24 AS rolling_avg_amount_24h,
    CAST(sum(is_blocked) OVER w24 AS BIGINT) AS rolling_blocked_count_24h,
    count(transaction_id) OVER w10 AS rolling_txn_count_10m
  FROM enr
  WINDOW w24 AS (PARTITION BY user_id ORDER BY event_unix RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW),
         w10 AS (PARTITION BY user_id ORDER BY event_unix RANGE BETWEEN 600 PRECEDING AND CURRENT ROW)
),
featr AS (
  SELECT *,
    CASE WHEN edge_fraud_probability >= 0.8 THEN 1
         WHEN rolling_txn_count_10m >= 4 THEN 1
         WHEN amount > 250000 AND hour <= 4 THEN 1
         ELSE 0 END AS cloud_rule_risk
  FROM feat
)"""


def sql_profiles() -> str:
    return """
prof AS (
  SELECT 'u' || CAST(u.n AS VARCHAR) AS user_id,
         CAST(abs(c.c_acctbal) * 10000 AS DECIMAL(14,2)) AS account_balance,
         CAST(abs(c.c_acctbal) * 1000 AS DECIMAL(14,2)) AS monthly_income,
         CASE WHEN c.c_mktsegment = 'BUILDING' THEN 'conservative'
              WHEN c.c_mktsegment = 'MACHINERY' THEN 'aggressive'
              ELSE 'balanced' END AS risk_appetite
  FROM (SELECT DISTINCT user_id % 10 AS n FROM events) u
  JOIN customer c ON u.n + 1 = c.c_custkey
  WHERE u.n % 7 <> 6
),
usr AS (
  SELECT 'u' || CAST(n AS VARCHAR) AS id,
         'u' || CAST(n AS VARCHAR) || '@example.test' AS email,
         'User ' || CAST(n AS VARCHAR) AS name
  FROM (SELECT DISTINCT user_id % 10 AS n FROM events)
)"""


def sql_order_ledger() -> str:
    return """
oled AS (
  SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS transaction_id,
         'c' || CAST(o_custkey AS VARCHAR) AS user_id,
         CAST(o_totalprice AS DECIMAL(14,2)) AS amount,
         o_orderdate AS event_ts,
         CASE WHEN o_orderstatus = 'P' THEN 'blocked' ELSE 'approved' END AS status
  FROM orders
),
oprof AS (
  SELECT 'c' || CAST(c_custkey AS VARCHAR) AS user_id,
         CAST(abs(c_acctbal) * 100 AS DECIMAL(14,2)) AS account_balance
  FROM customer WHERE c_custkey % 7 <> 0
)"""


def _sql_quote(text):
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def sql_faulty() -> str:
    """CTEs up to ``faulty``: the typed view of the faulty raw feed (with duplicates).

    Mirrors :func:`raw_feed` followed by ``normalize``: bad numbers are NULL,
    hour text is truncated, unparseable times are NULL, NULL ids dropped.
    """
    cols = {c: c for c in REQUIRED_COLUMNS}
    cols["event_ts"] = "event_ts"
    for col_name in REQUIRED_COLUMNS + ["event_ts"]:
        src = "event_time" if col_name == "event_ts" else col_name
        cases = []
        for k, (fcol, text) in FAULTS.items():
            if fcol != src:
                continue
            q = _sql_quote(text)
            if col_name in ("amount", "device_risk", "location_risk", "txn_velocity",
                            "edge_fraud_probability"):
                val = f"TRY_CAST({q} AS DOUBLE)"
            elif col_name == "hour":
                val = f"CAST(trunc(TRY_CAST({q} AS DOUBLE)) AS INTEGER)"
            elif col_name == "event_ts":
                val = f"TRY_CAST({q} AS TIMESTAMP)"
            else:
                val = f"CAST({q} AS VARCHAR)"
            cases.append(f"WHEN k = {k} THEN {val}")
        if cases:
            cols[col_name] = f"CASE {' '.join(cases)} ELSE {col_name} END"
    select = ",\n         ".join(f"{expr} AS {name}" for name, expr in cols.items())
    return sql_transactions(duplicates=True) + f""",
faulty_all AS (
  SELECT {select}, k, event_id
  FROM txn
),
faulty AS (SELECT * FROM faulty_all WHERE transaction_id IS NOT NULL)"""


# Browser signals of the fixture sessions.  FIXED FIXTURE VALUES:
# time zone by event_id % 3.
FIXTURE_ZONES = ["Asia/Kolkata", "Asia/Dubai", "Europe/Paris"]


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed feed plus ``event_ts``, ``device_id`` ('d' || k % 4), ``timezone`` and ``reason``."""
    t = transactions(spark, sf_dir, extra=True)
    zone = F.when(F.col("event_id") % 3 == 0, FIXTURE_ZONES[0]).when(
        F.col("event_id") % 3 == 1, FIXTURE_ZONES[1]).otherwise(FIXTURE_ZONES[2])
    reason = F.when(F.col("k") % 5 == 0, F.lit(None).cast("string")).when(
        F.col("status") == "blocked", "Edge anomaly threshold exceeded").otherwise("Standard transfer pattern")
    return (t.withColumn("event_ts", F.try_to_timestamp("event_time"))
            .withColumn("device_id", F.concat(F.lit("d"), (F.col("k") % 4).cast("string")))
            .withColumn("timezone", zone)
            .withColumn("reason", reason))


def sql_sessions() -> str:
    return sql_transactions() + f""",
sess AS (
  SELECT *, 'd' || CAST(k % 4 AS VARCHAR) AS device_id,
         CASE WHEN event_id % 3 = 0 THEN '{FIXTURE_ZONES[0]}'
              WHEN event_id % 3 = 1 THEN '{FIXTURE_ZONES[1]}'
              ELSE '{FIXTURE_ZONES[2]}' END AS timezone,
         CASE WHEN k % 5 = 0 THEN NULL
              WHEN status = 'blocked' THEN 'Edge anomaly threshold exceeded'
              ELSE 'Standard transfer pattern' END AS reason
  FROM txn
)"""


def sql_raw_faulty() -> str:
    """CTE ``rawf``: the faulty feed as text (the input of validation)."""
    cols = []
    for c in REQUIRED_COLUMNS:
        expr = f"CAST({c} AS VARCHAR)"
        cases = [f"WHEN k = {k} THEN {_sql_quote(text)}" for k, (fc, text) in FAULTS.items() if fc == c]
        if cases:
            expr = f"CASE {' '.join(cases)} ELSE {expr} END"
        cols.append(f"{expr} AS {c}")
    return sql_transactions(duplicates=True) + """,
rawf AS (SELECT """ + ", ".join(cols) + ", k FROM txn)"


def card_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card-style dataset from ``events``: Time (s since 2024-01-01), V10/V12/V14
    from k, Amount = value, Class = 1 for k >= 90."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "value", _k().alias("k"))
    t0 = 1704067200.0
    return ev.select(
        "event_id",
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - F.lit(t0)).alias("Time"),
        ((F.col("k") * 13) % 100 - 50).cast("double").__truediv__(10.0).alias("V10"),
        ((F.col("k") * 7) % 100 - 50).cast("double").__truediv__(10.0).alias("V12"),
        (F.col("k") - 50).cast("double").__truediv__(10.0).alias("V14"),
        F.col("value").alias("Amount"),
        F.when(F.col("k") >= 90, 1).otherwise(0).alias("Class"))


def sql_card() -> str:
    return """
cev AS (SELECT event_id, ts, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
card AS (
  SELECT event_id, epoch(ts) - 1704067200.0 AS "Time",
         CAST((k * 13) % 100 - 50 AS DOUBLE) / 10.0 AS V10,
         CAST((k * 7) % 100 - 50 AS DOUBLE) / 10.0 AS V12,
         CAST(k - 50 AS DOUBLE) / 10.0 AS V14,
         value AS "Amount", CASE WHEN k >= 90 THEN 1 ELSE 0 END AS "Class"
  FROM cev
)"""


def training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five features + Class from the feed: amount / 10, label = heuristic score > 2.2."""
    from txlens.functions.rules import heuristic_label
    t = transactions(spark, sf_dir, extra=True)
    base = t.select("transaction_id", (F.col("amount") / 10.0).alias("amount"),
                    F.col("hour").cast("double").alias("hour"), "device_risk", "location_risk", "txn_velocity")
    return base.withColumn("Class", heuristic_label())
