"""Catalog: sources and sinks.  Each query writes a table derived from the
driver's tables into a fresh folder under the session's checkpoint folder
and reads it back through the library's reader."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from txlens.constants import MODEL_FEATURES as M_FEATURES
from txlens.constants import REQUIRED_COLUMNS
from txlens.functions.scalars import with_scalars
from txlens.operators import ml as M
from txlens.operators.joins import with_profile
from txlens.operators.normalize import MissingColumnsError, event_unix, normalize
from txlens.plans import fixtures as fx
from txlens.plans.catalog import ORACLE, oracle_text, register
from txlens.plans.catalog_features import FEAT_DOUBLES, FEAT_OUT, features
from txlens.session import checkpoint_dir
from txlens.sources import feed as SRC
from txlens.sources import sinks as SNK


def scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/txlens-io/{name}-{uuid.uuid4().hex}"


def _copy_oracle(src: str, dst: str) -> None:
    ORACLE[dst] = ORACLE[src]


@register("src1_read_transactions")
def src1(spark, sf):
    """Faulty text feed written as CSV, read back as text, normalised."""
    path = scratch(spark, "feed")
    SNK.append_transactions(fx.raw_feed(spark, sf, faulty=True, duplicates=True), path)
    t = normalize(SRC.read_transactions(spark, path))
    return t.withColumn("event_unix", event_unix("event_ts")).select(*REQUIRED_COLUMNS, "event_unix")


@register("src3_read_features")
def src3(spark, sf):
    """Feature table published (parquet by event date, atomic swap) and read back."""
    path = scratch(spark, "features")
    SNK.write_features(features(spark, sf), path)
    return SRC.read_features(spark, path).select(*FEAT_OUT)


@register("src4_read_card_dataset")
def src4(spark, sf):
    """Card dataset written as CSV with header, read with the fixed schema, featurised."""
    path = scratch(spark, "card")
    card = fx.card_dataset(spark, sf).drop("event_id")
    for i in range(1, 29):
        if f"V{i}" not in card.columns:
            card = card.withColumn(f"V{i}", F.lit(0.0))
    card.select(*[f.name for f in SRC.CARD_SCHEMA.fields]).write.option("header", True).csv(path)
    return M.card_features(SRC.read_card_dataset(spark, path))


@register("src5_read_ledger")
def src5(spark, sf):
    """Users, profiles and transactions written as parquet tables, read back and
    joined: each user's profile with the count and sum of their transactions."""
    base = scratch(spark, "ledger")
    fx.users(spark, sf).write.parquet(f"{base}/users")
    fx.profiles(spark, sf).write.parquet(f"{base}/profiles")
    fx.transactions(spark, sf).write.parquet(f"{base}/transactions")
    led = SRC.read_ledger(spark, base)
    j = with_profile(led["users"], led["profiles"])
    per_user = led["transactions"].groupBy("user_id").agg(F.count(F.lit(1)).alias("transactions"),
                                                          F.sum("amount").alias("amount"))
    return (j.withColumn("has_profile", F.col("has_profile").cast("int"))
            .join(per_user, F.col("id") == F.col("user_id"), "left").drop("user_id"))


@register("src2_missing_column")
def src2(spark, sf):
    """Every feed column left out in turn: the reader names it; the whole feed reads."""
    out = []
    for c in [None, *REQUIRED_COLUMNS]:
        path = scratch(spark, "columns")
        feed = fx.raw_feed(spark, sf, faulty=False, duplicates=False)
        SNK.append_transactions(feed.drop(c) if c else feed, path)
        try:
            read = SRC.read_transactions(spark, path)
            out.append(read.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("").alias("missing"), "rows"))
        except MissingColumnsError as e:
            out.append(spark.read.option("header", True).csv(path).agg(F.lit(0).cast("long").alias("rows"))
                       .select(F.lit(",".join(e.missing)).alias("missing"), "rows"))
    return reduce(lambda a, b: a.unionByName(b), out)


@register("src1_reordered_header")
def src1_reordered(spark, sf):
    """The faulty feed written with its columns in reverse order, read by name."""
    path = scratch(spark, "reordered")
    SNK.append_transactions(fx.raw_feed(spark, sf, faulty=True, duplicates=True).select(*REQUIRED_COLUMNS[::-1]), path)
    t = normalize(SRC.read_transactions(spark, path))
    return t.withColumn("event_unix", event_unix("event_ts")).select(*REQUIRED_COLUMNS, "event_unix")


@register("snk1_write_features_by_date")
def snk1(spark, sf):
    """The published feature table, read back with its date partition; published
    twice, so the pointer moves."""
    path = scratch(spark, "features")
    SNK.write_features(features(spark, sf).limit(1), path)
    SNK.write_features(features(spark, sf), path)
    return SRC.read_published(spark, path).select(*FEAT_OUT, F.col("event_date").cast("string").alias("event_date"))


@register("snk3_append_transactions")
def snk3(spark, sf):
    """Two appends of rows whose reason holds a comma, a quote and a newline; read back."""
    path = scratch(spark, "append")
    s = fx.sessions(spark, sf).select(
        "transaction_id", "user_id",
        F.concat(F.lit('note, "quoted"\nline for '), F.col("transaction_id")).alias("reason"))
    SNK.append_transactions(s, path)
    SNK.append_transactions(s, path)
    back = (spark.read.option("header", True).option("multiLine", True).option("quote", '"')
            .option("escape", '"').csv(path))
    return back.groupBy("transaction_id", "user_id", "reason").agg(F.count(F.lit(1)).alias("copies"))


@register("snk2_write_risk_outputs")
def snk2(spark, sf):
    """The four risk tables (with clustering) published and read back: table name
    and row count, and the rows that got a cluster."""
    from txlens.plans.risk_job import risk_job
    path = scratch(spark, "risk")
    outs = risk_job(features(spark, sf), "2024-02-01 00:00:00")
    SNK.write_risk_outputs(outs, path)
    clustered = (SRC.read_published(spark, f"{path}/enriched").filter(F.col("cluster").between(1, 3))
                 .agg(F.count(F.lit(1)).alias("rows")).select(F.lit("clustered").alias("table"), "rows"))
    parts = [clustered] + [SRC.read_published(spark, f"{path}/{n}").agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(n).alias("table"), "rows") for n in ("blacklist", "enriched", "user_risk", "hotspots")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("snk6_write_scaler_metrics")
def snk6(spark, sf):
    """Scaler and metrics artifacts written as JSON and read back: one row per
    feature with its mean and scale, and the metrics beside it."""
    path = scratch(spark, "model")
    card = M.card_features(fx.card_dataset(spark, sf))
    scaler = M.fit_scaler(card)
    SNK.write_scaler(scaler, f"{path}/scaler")
    pred = fx.transactions(spark, sf, extra=True).select(
        F.col("edge_fraud_probability").alias("score"), F.when(F.col("k") >= 95, 1).otherwise(0).alias("Class"))
    SNK.write_metrics(M.evaluate(pred, "score", "Class"), f"{path}/metrics")
    sc = M.read_scaler(spark, f"{path}/scaler").select(F.explode(F.arrays_zip("feature_names", "mean", "scale")).alias("f"))
    me = SRC.read_published(spark, f"{path}/metrics", "json")
    return with_scalars(sc.select(F.col("f.feature_names").alias("feature"), "f.mean", "f.scale"),
                        me.select("val_loss", "val_accuracy", "val_auc", "dataset_source"))


def _finish():
    from txlens.plans import catalog_ml, catalog_reports, catalog_risk  # noqa: F401
    _copy_oracle("prj1_normalize", "src1_read_transactions")
    _copy_oracle("features_job", "src3_read_features")
    _copy_oracle("ml6_card_features", "src4_read_card_dataset")
    _copy_oracle("prj1_normalize", "src1_reordered_header")
    ORACLE["src2_missing_column"] = ("WITH " + fx.sql_transactions() + """
      SELECT '' AS missing, count(*) AS rows FROM txn UNION ALL
      SELECT unnest([""" + ", ".join(f"'{c}'" for c in REQUIRED_COLUMNS) + "]), 0")
    ORACLE["src5_read_ledger"] = oracle_text("WITH " + fx.sql_transactions() + ", " + fx.sql_profiles() + """
      SELECT u.id, u.email, u.name, CAST(coalesce(p.account_balance, 0) AS DOUBLE) AS account_balance,
             CAST(coalesce(p.monthly_income, 0) AS DOUBLE) AS monthly_income,
             coalesce(p.risk_appetite, 'balanced') AS risk_appetite,
             CASE WHEN p.user_id IS NOT NULL THEN 1 ELSE 0 END AS has_profile, t.transactions, t.amount
      FROM usr u LEFT JOIN prof p ON u.id = p.user_id
      LEFT JOIN (SELECT user_id, count(*) AS transactions, sum(amount) AS amount FROM txn GROUP BY 1) t
             ON u.id = t.user_id""", ["account_balance", "monthly_income", "amount"])
    ORACLE["snk1_write_features_by_date"] = oracle_text(
        "WITH " + fx.sql_features() + f""" SELECT {', '.join(FEAT_OUT)},
        CAST(CAST(event_ts AS DATE) AS VARCHAR) AS event_date FROM featr""", FEAT_DOUBLES)
    ORACLE["snk2_write_risk_outputs"] = catalog_risk.RISK_SQL + """
      SELECT 'blacklist' AS "table", count(*) AS rows FROM urisk WHERE risk_score > 75 UNION ALL
      SELECT 'enriched', count(*) FROM scored UNION ALL
      SELECT 'clustered', count(*) FROM scored WHERE amount IS NOT NULL AND device_risk IS NOT NULL
             AND location_risk IS NOT NULL AND rolling_total_spend_24h IS NOT NULL UNION ALL
      SELECT 'user_risk', count(*) FROM urisk UNION ALL
      SELECT 'hotspots', count(DISTINCT hour) FROM scored"""
    ORACLE["snk6_write_scaler_metrics"] = oracle_text(catalog_ml.CARD_SQL + ", " + fx.sql_transactions() + """,
      m AS (SELECT """ + ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(M_FEATURES)) + """ FROM cardf),
      pr AS (SELECT edge_fraud_probability AS score, CASE WHEN k >= 95 THEN 1 ELSE 0 END AS y FROM txn),
      rk AS (SELECT score, y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM pr),
      a AS (SELECT (sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
                   / (CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) * count(*) FILTER (WHERE y = 0)) AS val_auc FROM rk),
      b AS (SELECT avg(-(y * ln(least(greatest(score, 1e-7), 1 - 1e-7)) + (1 - y) * ln(1 - least(greatest(score, 1e-7), 1 - 1e-7)))) AS val_loss,
                   avg(CASE WHEN CAST(score >= 0.5 AS INTEGER) = y THEN 1.0 ELSE 0.0 END) AS val_accuracy FROM pr)
      SELECT f.feature, f.mean, f.scale, val_loss, val_accuracy, val_auc, 'synthetic' AS dataset_source FROM a, b, ("""
        + " UNION ALL ".join(f"SELECT '{c}' AS feature, m{i} AS mean, s{i} AS scale FROM m" for i, c in enumerate(M_FEATURES))
        + ") f", ["mean", "scale", "val_loss", "val_accuracy", "val_auc"])
    ORACLE["snk3_append_transactions"] = ("WITH " + fx.sql_transactions() + """
      SELECT transaction_id, user_id, 'note, "quoted"' || chr(10) || 'line for ' || transaction_id AS reason,
             CAST(2 AS BIGINT) AS copies FROM txn""")


_finish()
