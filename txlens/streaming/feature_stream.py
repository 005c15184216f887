"""Streaming jobs (STR1-STR6).

STR1 -- continuous feature job.  The original re-read the whole feed every
8 seconds and recomputed everything.  Here a Structured Streaming file source
feeds ``foreachBatch``, whose work follows the batch, not the history:

* The feature table itself is the state: the latest copy of every transaction
  with its features, partitioned by (user bucket, event date); rows without a
  time are in the date ``none``.  It is a snapshot table (``sources.snapshots``):
  a batch writes new files and becomes visible by one rename.
* An index of all received copies (``id_index``) tells where an id that comes
  again had been.  It is committed with the table, by the same rename.
* A batch changes a user's features from the earliest time it touches (a new
  row, or any former copy of a repeated id, also of another user) up to 24 h
  after the latest.  Only the days of that range, and the day before for
  context, are read, by path, for the buckets touched; only they are rewritten
  (a day left without rows is dropped from the table).

A crash anywhere before the rename leaves the table as it was, and the batch is
done again from the start; after it, a replayed batch is recognised by its number
and does nothing.  Readers see the version before a batch or the one after it.
Rows may arrive arbitrarily late -- nothing is dropped (STR4) -- and after any
sequence of batches the output equals the batch job over everything received.

STR3 -- first-seen dedupe with a watermark (``dropDuplicatesWithinWatermark``).
STR5 -- optional risk refresh every n batches inside the same ``foreachBatch``.
STR6 -- decision stream: the blacklist is re-read for every micro-batch, the
balances are carried as the changes of each batch, and accepted rows are
appended to the feed that STR1 reads; a batch is decided and appended once.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txlens import constants as K
from txlens.constants import REQUIRED_COLUMNS, WINDOW_24H_SECONDS
from txlens.operators.dedupe import dedupe_latest
from txlens.operators.normalize import event_unix, normalize
from txlens.plans.features import FEATURE_COLUMNS, compute_features
from txlens.session import temporary_tables
from txlens.sources.feed import (
    FEATURE_SCHEMA, path_exists, read_published, stream_transactions,
)
from txlens.sources.snapshots import SnapshotLog, State, read_snapshot
from txlens.streaming.id_index import FANOUT, FILE_ROWS, IdIndex

DEFAULT_BUCKETS = 64
COMPACT_EVERY = 20
NO_DATE = "none"
DAY = 86_400


def user_bucket(col: str = "user_id", buckets: int = DEFAULT_BUCKETS) -> F.Column:
    return F.pmod(F.xxhash64(F.col(col)), F.lit(buckets)).cast("int")


def _event_date(col: str = "event_unix") -> F.Column:
    return F.coalesce(F.date_format(F.timestamp_seconds(F.col(col)), "yyyy-MM-dd"), F.lit(NO_DATE))


def query_name(spark: SparkSession) -> str:
    """The identity of the running query: kept by its checkpoint over restarts, new
    with a new checkpoint; ``direct`` outside a query."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"


TABLE_SCHEMA = (T.StructType([FEATURE_SCHEMA[c] for c in FEATURE_COLUMNS])
                .add("user_bucket", T.IntegerType()).add("event_date", T.StringType()))
PARTS = ["user_bucket", "event_date"]


class FeatureStreamUpdater:
    """``foreachBatch`` body of STR1 (see the module text)."""

    def __init__(self, output_dir: str, buckets: int = DEFAULT_BUCKETS, strategy: str = "sweep", risk_every: int = 0,
                 risk_dir: str | None = None, flagged_at: str = "1970-01-01 00:00:00",
                 cluster_starts: int = K.CLUSTER_STARTS, compact_every: int = COMPACT_EVERY,
                 index_file_rows: int = FILE_ROWS, index_fanout: int = FANOUT):
        self.output_dir, self.buckets, self.strategy = output_dir, buckets, strategy
        self.compact_every, self.index_file_rows, self.index_fanout = compact_every, index_file_rows, index_fanout
        self.risk_every, self.risk_dir, self.flagged_at = risk_every, risk_dir, flagged_at
        self.cluster_starts = cluster_starts
        #: partitions of the feature table that each batch read, for monitoring
        self.partitions_read: list[int] = []
        self.log: SnapshotLog | None = None
        self.index: IdIndex | None = None

    def __call__(self, batch_df: DataFrame, batch_id: int) -> None:
        spark, batch_id = batch_df.sparkSession, int(batch_id)
        if self.log is None:
            self.log = SnapshotLog(spark, self.output_dir, checkpoint_every=self.compact_every)
            self.index = IdIndex(self.log, self.index_file_rows, self.index_fanout)
        stream = query_name(spark)
        commit = self.log.begin(stream, batch_id)
        if commit is not None:
            with temporary_tables(spark) as keep:
                typed = keep(normalize(batch_df).withColumn("event_unix", event_unix("event_ts"))
                             .withColumn("user_bucket", user_bucket("user_id", self.buckets)))
                if typed.isEmpty():
                    return
                self._update(spark, typed, stream, batch_id, commit, keep)
        if self.risk_every and self.risk_dir and (batch_id + 1) % self.risk_every == 0:
            refresh_risk(spark, self.output_dir, self.risk_dir, self.flagged_at, cluster_starts=self.cluster_starts)

    def _partition_paths(self, state: State, ranges: dict[int, tuple]) -> list[str]:
        """Partitions of the buckets' day ranges (and ``none``)."""
        def wanted(partition: str) -> bool:
            bucket, day = (x.split("=")[1] for x in partition.split("/"))
            if int(bucket) not in ranges:
                return False
            first, last, untimed = ranges[int(bucket)]
            return bool(untimed) if day == NO_DATE else first is not None and first <= day <= last
        return self.log.paths(state, wanted)

    def _update(self, spark: SparkSession, typed: DataFrame, stream: str, batch_id: int, commit: str, keep) -> None:
        state = self.log.state()
        ids = typed.select("transaction_id").distinct()
        entries = keep(typed.select("transaction_id", "user_id", "event_unix").distinct())
        n = entries.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("transaction_id").alias("ids")).first()
        runs = self.index.write(entries, f"{commit}~level0", n.rows, 0)
        copies = (self.index.lookup(state, ids, n.ids).unionByName(entries)
                  .withColumn("user_bucket", user_bucket("user_id", self.buckets)))
        affected = keep(copies.groupBy(F.col("user_id").alias("__user"), "user_bucket").agg(
            F.min("event_unix").alias("__from"), (F.max("event_unix") + WINDOW_24H_SECONDS).alias("__to"),
            F.max(F.col("event_unix").isNull()).alias("__untimed")))
        day = lambda unix: None if unix is None else dt.datetime.fromtimestamp(unix, dt.timezone.utc).strftime("%Y-%m-%d")
        ranges = {r.user_bucket: (day(None if r.a is None else r.a - DAY), day(r.b), r.n) for r in
                  affected.groupBy("user_bucket").agg(F.min("__from").alias("a"), F.max("__to").alias("b"),
                                                      F.max("__untimed").alias("n")).collect()}   # a row per bucket
        paths = self._partition_paths(state, ranges)
        self.partitions_read.append(len(paths))
        stored = self.log.read(TABLE_SCHEMA, paths)          # immutable files: every read sees the same rows

        # the current copy of each of the batch's ids, among what came and what was kept
        old = keep(stored.join(ids, "transaction_id", "left_semi"))
        current = dedupe_latest(typed.select(*REQUIRED_COLUMNS, "event_ts").unionByName(
            old.select(*REQUIRED_COLUMNS, "event_ts")), "transaction_id", "event_ts")
        others = stored.join(ids, "transaction_id", "left_anti")
        mine = F.col("user_id").eqNullSafe(F.col("__user"))
        limits = affected.drop("user_bucket")
        changes = F.when(F.col("event_unix").isNull(), F.col("__untimed")).otherwise(
            F.col("event_unix").between(F.col("__from"), F.col("__to")))
        context = F.when(F.col("event_unix").isNull(), F.col("__untimed")).otherwise(
            F.col("event_unix").between(F.col("__from") - WINDOW_24H_SECONDS, F.col("__to")))
        seen = (others.join(limits, mine).filter(F.coalesce(context, F.lit(False)))
                .select(*REQUIRED_COLUMNS, "event_ts").unionByName(current.select(*REQUIRED_COLUMNS, "event_ts")))
        fresh = keep(compute_features(seen, strategy=self.strategy).join(limits, mine)
                     .filter(F.coalesce(changes, F.lit(False))).select(*FEATURE_COLUMNS)
                     .withColumn("user_bucket", user_bucket("user_id", self.buckets))
                     .withColumn("event_date", _event_date()))
        kept = (others.join(limits, mine, "left").filter(~F.coalesce(changes, F.lit(False)))
                .select(*FEATURE_COLUMNS, *PARTS))
        # partitions that get, lose or change a row: at most those of the buckets' days
        touched = fresh.select(*PARTS).unionByName(old.select(*PARTS)).distinct().collect()
        touched_rows = spark.createDataFrame([tuple(r) for r in touched], "user_bucket int, event_date string")
        content = kept.join(F.broadcast(touched_rows), PARTS, "left_semi").unionByName(fresh)
        written = self.log.write(content.hint("rebalance", *PARTS), commit, PARTS)
        names = {f"user_bucket={r.user_bucket}/event_date={r.event_date}" for r in touched}
        more, dropped = self.index.merged(replace(state, runs={**state.runs, **runs}), commit)
        runs = {k: v for k, v in {**runs, **more}.items() if k not in dropped}
        self.log.commit(commit, stream, batch_id, written, sorted(names - set(written)), runs,
                        [r for r in dropped if r in state.runs])


def refresh_risk(spark: SparkSession, features_dir: str, risk_dir: str, flagged_at: str,
                 cluster: bool = True, cluster_starts: int = K.CLUSTER_STARTS) -> None:
    """STR5: rerun the risk analysis over the current feature table and publish it."""
    from txlens.plans.risk_job import risk_job
    from txlens.sources.sinks import write_risk_outputs
    feats = current_features(spark, features_dir)
    write_risk_outputs(risk_job(feats, flagged_at, cluster=cluster, cluster_starts=cluster_starts), risk_dir)


def start_feature_stream(spark: SparkSession, input_dir: str, output_dir: str, checkpoint_location: str,
                         trigger: str | None = "8 seconds", max_files_per_trigger: int | None = None,
                         updater: FeatureStreamUpdater | None = None, multi_line: bool = False, **updater_args):
    """STR1: start the stream over CSV files landing in ``input_dir``.

    ``trigger=None`` processes what is there now and stops (``availableNow``).
    """
    stream = stream_transactions(spark, input_dir, max_files_per_trigger, multi_line)
    w = (stream.writeStream.foreachBatch(updater or FeatureStreamUpdater(output_dir, **updater_args))
         .option("checkpointLocation", checkpoint_location))
    w = w.trigger(availableNow=True) if trigger is None else w.trigger(processingTime=trigger)
    return w.start()


def current_features(spark: SparkSession, output_dir: str) -> DataFrame:
    """The newest version of the feature table."""
    return read_snapshot(spark, output_dir, TABLE_SCHEMA).select(*FEATURE_COLUMNS)


# -- STR3 -------------------------------------------------------------------

def first_seen(stream: DataFrame, key: str = "transaction_id", ts: str = "event_ts",
               delay: str = "24 hours") -> DataFrame:
    """STR3: keep the *first* copy of every key seen within the watermark delay.

    Use where ids are immutable; keep-latest semantics need STR1's upsert.
    """
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


# -- STR6 -------------------------------------------------------------------

DECISION_SCHEMA = (T.StructType().add("transaction_id", "string").add("user_id", "string").add("code", "integer")
                   .add("decision", "string").add("message", "string").add("stream", "string").add("batch_id", "long"))
BALANCE = "user_id string, account_balance decimal(14,2), version long"


def read_decisions(spark: SparkSession, decisions_dir: str) -> DataFrame:
    """The committed decisions of all batches."""
    return read_snapshot(spark, decisions_dir, DECISION_SCHEMA)


class DecisionStreamUpdater:
    """``foreachBatch`` body of the decision stream.

    For a batch: read the blacklist as it is now and the balances before it (the
    opening profiles, overlaid with the changes of earlier batches), run LED3 once,
    and commit to the snapshot table ``decisions_dir``, by one rename: the decisions,
    the balances that changed and the accepted rows as CSV.  Then those very files are
    put into ``feed_dir``, the feed that STR1 reads, each by a rename.

    A batch is decided once: replayed before its commit it starts from the same
    balances, replayed after it only the files still missing from the feed are put
    there, whatever the blacklist or the number of partitions is by then.  Balance
    changes are merged every ``compact_every`` batches.
    """

    def __init__(self, blacklist_path: str, opening_profiles_path: str, decisions_dir: str,
                 feed_dir: str | None = None, compact_every: int = COMPACT_EVERY):
        self.blacklist_path, self.opening = blacklist_path, opening_profiles_path
        self.decisions_dir, self.feed_dir, self.compact_every = decisions_dir, feed_dir, compact_every
        self.log: SnapshotLog | None = None

    def _runs(self, state: State, kind: str) -> list[str]:
        return [r for r, note in state.runs.items() if note["kind"] == kind]

    def _changes(self, spark: SparkSession, runs: list[str]) -> DataFrame | None:
        """(user_id, account_balance, version) after the last batch that changed it."""
        if not runs:
            return None
        stored = spark.read.schema(BALANCE).parquet(*[f"{self.log.path}/_runs/{r}" for r in runs])
        return stored.groupBy("user_id").agg(F.max_by("account_balance", "version").alias("account_balance"),
                                             F.max("version").alias("version"))

    def _profiles(self, spark: SparkSession, state: State) -> DataFrame:
        opening = read_published(spark, self.opening)
        changes = self._changes(spark, self._runs(state, "balances"))
        if changes is None:
            return opening
        now = changes.select(F.col("user_id").alias("__user"), F.col("account_balance").alias("__now"))
        return (opening.join(now, F.col("user_id") == F.col("__user"), "left")
                .withColumn("account_balance", F.coalesce("__now", "account_balance")).drop("__user", "__now"))

    def __call__(self, batch_df: DataFrame, batch_id: int) -> None:
        spark, batch_id = batch_df.sparkSession, int(batch_id)
        if self.log is None:
            self.log = SnapshotLog(spark, self.decisions_dir, checkpoint_every=self.compact_every)
        stream = query_name(spark)
        commit = self.log.begin(stream, batch_id)
        if commit is not None:
            with temporary_tables(spark) as keep:
                # row numbers are fixed once stored
                feed = keep(batch_df.withColumn("__row", F.monotonically_increasing_id()))
                if feed.isEmpty():
                    return
                self._decide(spark, feed, stream, batch_id, commit, keep)
        self._publish(spark, stream, batch_id)

    def _decide(self, spark: SparkSession, feed: DataFrame, stream: str, batch_id: int, commit: str, keep) -> None:
        from txlens.operators.ledger import closing_balance, decide_transactions
        from txlens.sources.sinks import append_transactions

        state = self.log.state()
        if path_exists(spark, self.blacklist_path):
            blacklist = read_published(spark, self.blacklist_path).select("user_id")
        else:
            blacklist = spark.createDataFrame([], "user_id string")
        profiles = self._profiles(spark, state)
        # the blacklist and the balances are read once: everything follows from the stored rows
        decisions, gated = decide_transactions(feed, blacklist, profiles, keep=keep, carry=["__row"])
        decisions = keep(decisions)
        written = self.log.write(decisions.drop("__row").select(
            "*", F.lit(stream).alias("stream"), F.lit(batch_id).cast("long").alias("batch_id")), commit, ["stream", "batch_id"])
        after = closing_balance(profiles, gated).filter("closing_balance <> opening_balance").select(
            "user_id", F.col("closing_balance").alias("account_balance"), F.lit(state.version + 1).cast("long").alias("version"))
        # balances: one more run, or all of them merged into one; feed files of batches already put into the feed go
        balances, dropped = self._runs(state, "balances"), self._runs(state, "feed")
        if len(balances) + 1 >= self.compact_every:
            former = self._changes(spark, balances)
            after = after if former is None else former.join(after, "user_id", "left_anti").unionByName(after)
            dropped += balances
        self.log.write_run(after, f"{commit}~balances")
        added = {f"{commit}~balances": {"kind": "balances"}}
        if self.feed_dir:
            accepted = feed.join(decisions.filter("code = 200").select("__row"), "__row", "left_semi")
            name = f"{commit}~feed"
            self.log.write_run(accepted.select(*REQUIRED_COLUMNS), name, append_transactions)
            files = sorted(n for n in self.log.names(f"_runs/{name}") if n.endswith(".csv") and n[0] not in "._")
            added[name] = {"kind": "feed", "stream": stream, "batch": batch_id, "files": files}
        self.log.commit(commit, stream, batch_id, written, [], added, dropped)

    def _publish(self, spark: SparkSession, stream: str, batch_id: int) -> None:
        """The batch's committed CSV files into the feed folder; those there stay."""
        for run, note in self.log.state().runs.items():
            if note["kind"] == "feed" and (note["stream"], note["batch"]) == (stream, batch_id):
                for i, name in enumerate(note["files"]):
                    self.log.copy_out(f"_runs/{run}/{name}", f"{self.feed_dir}/accepted-{stream}-{batch_id:010d}-{i:05d}.csv")


def start_decision_stream(spark: SparkSession, input_dir: str, checkpoint_location: str,
                          trigger: str | None = "8 seconds", max_files_per_trigger: int | None = None,
                          multi_line: bool = False, **paths):
    stream = stream_transactions(spark, input_dir, max_files_per_trigger, multi_line)
    w = (stream.writeStream.foreachBatch(DecisionStreamUpdater(**paths))
         .option("checkpointLocation", checkpoint_location))
    w = w.trigger(availableNow=True) if trigger is None else w.trigger(processingTime=trigger)
    return w.start()
