"""Catalog: streaming jobs, run to completion over the fixture feed cut into
one CSV file per day (``availableNow``), results read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from txlens.constants import REQUIRED_COLUMNS
from txlens.plans import fixtures as fx
from txlens.plans.catalog import ORACLE, register
from txlens.plans.catalog_features import FEAT_OUT
from txlens.plans.catalog_io import scratch
from txlens.sources.feed import hadoop_path, read_published, read_transactions, stream_transactions
from txlens.streaming import feature_stream as ST


def run_feature_stream(spark, sf, files_per_batch=10, newest_first=False, **updater_args):
    """Stream the fixture feed, one CSV part per event day, ``files_per_batch`` per micro-batch.

    ``newest_first`` writes the days in reverse, so every older day arrives late.
    Returns the run folder (output in ``out``).
    """
    root = run_feature_stream_input(spark, sf, newest_first)
    q = ST.start_feature_stream(spark, f"{root}/in", f"{root}/out", f"{root}/chk", buckets=8, trigger=None,
                                max_files_per_trigger=files_per_batch, **updater_args)
    q.awaitTermination()
    return root


def run_feature_stream_input(spark, sf, newest_first=False, faulty=False):
    """The fixture feed as CSV files in event-day order under ``<root>/in``."""
    root = scratch(spark, "stream")
    feed = fx.raw_feed(spark, sf, faulty=faulty, duplicates=True)
    day = F.substring("event_time", 1, 10)
    # One part per day (the day count is bounded by the calendar span), named in
    # day order.  This stages test input for the stream queries: the bounded-
    # lateness stream (STR2) needs each day whole in one file so that files
    # arrive in event-day order.
    staged = f"{root}/staged"
    (feed.withColumn("__day", day).repartition("__day").write.partitionBy("__day")
     .option("header", True).csv(staged))
    fs, _ = hadoop_path(spark, root)
    jvm = spark.sparkContext._jvm
    folders = [st.getPath().getName() for st in fs.listStatus(jvm.org.apache.hadoop.fs.Path(staged)) if st.isDirectory()]
    days = sorted((f.split("=", 1)[1] for f in folders if f.startswith("__day=")), reverse=newest_first)
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{root}/in"))
    began = 1_700_000_000_000
    for i, d in enumerate(days):
        src = jvm.org.apache.hadoop.fs.Path(f"{staged}/__day={d}")
        for st in fs.listStatus(src):
            name = st.getPath().getName()
            if name.endswith(".csv"):
                target = jvm.org.apache.hadoop.fs.Path(f"{root}/in/{i:04d}-{name}")
                if not fs.rename(st.getPath(), target):
                    raise OSError(f"could not move {name}")
                fs.setTimes(target, began + i * 1000, -1)      # the file source takes the oldest first
    return root


@register("str1_feature_stream")
def str1(spark, sf):
    """Feature stream over the feed in micro-batches; equals the batch feature job."""
    return ST.current_features(spark, f"{run_feature_stream(spark, sf)}/out").select(*FEAT_OUT)


@register("str4_late_arrivals")
def str4(spark, sf):
    """Days arrive newest first, so every older day is late; nothing is dropped and
    the result still equals the batch feature job."""
    root = run_feature_stream(spark, sf, files_per_batch=8, newest_first=True)
    return ST.current_features(spark, f"{root}/out").select(*FEAT_OUT)


@register("str5_risk_refresh")
def str5(spark, sf):
    """Risk analysis, clustering included, refreshed inside the feature stream after
    every batch; the user scores of the last refresh equal the batch risk run."""
    root = scratch(spark, "riskstream")
    run_feature_stream(spark, sf, files_per_batch=15, risk_every=1, risk_dir=f"{root}/risk",
                       flagged_at="2024-02-01 00:00:00")
    if read_published(spark, f"{root}/risk/enriched").filter("cluster IS NULL").count():
        raise AssertionError("the refreshed table has rows without a cluster")
    return read_published(spark, f"{root}/risk/user_risk")


@register("str2_rolling_state")
def str2(spark, sf):
    """Rolling features in per-user streaming state (RocksDB), daily files in order;
    the upsert view of the emitted rows equals the batch feature job."""
    from txlens.operators.normalize import event_unix, normalize
    from txlens.streaming.rolling_state import latest_emitted, rolling_state_stream
    root = run_feature_stream_input(spark, sf)
    raw = stream_transactions(spark, f"{root}/in", 10)
    typed = (normalize(raw).withColumn("event_unix", event_unix("event_ts"))
             .withColumn("event_ms", F.unix_millis("event_ts")))
    q = (rolling_state_stream(typed).writeStream.format("parquet").option("path", f"{root}/str2")
         .option("checkpointLocation", f"{root}/str2chk").trigger(availableNow=True).start())
    q.awaitTermination()
    return latest_emitted(spark.read.parquet(f"{root}/str2")).select(*FEAT_OUT)


@register("str3_stream_first_seen")
def str3(spark, sf):
    """First-seen dedupe with a 24 h watermark over the streamed feed."""
    root = scratch(spark, "dedupe")
    fx.raw_feed(spark, sf, faulty=False, duplicates=True).write.option("header", True).csv(f"{root}/in")
    stream = stream_transactions(spark, f"{root}/in")
    typed = stream.select(*REQUIRED_COLUMNS, F.try_to_timestamp("event_time").alias("event_ts"))
    q = (ST.first_seen(typed).writeStream.format("parquet").option("path", f"{root}/out")
         .option("checkpointLocation", f"{root}/chk").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out").select("transaction_id", "user_id")


@register("str6_decision_stream")
def str6(spark, sf):
    """Decision stream over the faulty feed, a few days per micro-batch, balances
    carried across batches; the decisions equal the batch run over the whole feed,
    and exactly the accepted rows reach the feature feed."""
    root = run_feature_stream_input(spark, sf, faulty=True)
    fx.profiles(spark, sf).write.parquet(f"{root}/opening")
    c = fx.table(spark, sf, "customer")
    (c.filter(F.col("c_mktsegment") == "MACHINERY")
     .select(F.concat(F.lit("u"), (F.col("c_custkey") - 1).cast("string")).alias("user_id"))
     .write.parquet(f"{root}/blacklist"))
    q = ST.start_decision_stream(spark, f"{root}/in", f"{root}/chk", trigger=None, max_files_per_trigger=8,
                                 blacklist_path=f"{root}/blacklist", opening_profiles_path=f"{root}/opening",
                                 decisions_dir=f"{root}/decisions", feed_dir=f"{root}/feed", compact_every=2)
    q.awaitTermination()
    decided = ST.read_decisions(spark, f"{root}/decisions").select("transaction_id", "user_id", "code", "decision", "message")
    accepted = decided.filter("code = 200").groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n"))
    appended = read_transactions(spark, f"{root}/feed").groupBy("transaction_id").agg(F.count(F.lit(1)).alias("m"))
    both = accepted.join(appended, accepted.transaction_id.eqNullSafe(appended.transaction_id), "full_outer")
    if both.filter("NOT (n <=> m)").count():
        raise AssertionError("the feature feed is not the accepted rows")
    return decided


def _finish():
    from txlens.plans import catalog_features  # noqa: F401
    from txlens.plans import catalog_ledger, catalog_risk  # noqa: F401
    ORACLE["str1_feature_stream"] = ORACLE["features_job"]
    ORACLE["str4_late_arrivals"] = ORACLE["features_job"]
    ORACLE["str2_rolling_state"] = ORACLE["features_job"]
    ORACLE["str5_risk_refresh"] = ORACLE["agg1_user_risk"]
    ORACLE["str6_decision_stream"] = ORACLE["led3_process_transactions"]
    ORACLE["str3_stream_first_seen"] = "WITH " + fx.sql_transactions() + " SELECT transaction_id, user_id FROM txn"


_finish()
