"""A keyed table that merges touch only in part (SNK5 at scale).

The table is a snapshot table (``sources.snapshots``) cut into buckets by a hash
of its key.  A merge

* stores the batch once and finds the buckets of its keys;
* reads those buckets, by path; the rest of the table is not opened and its
  files stay in the next version;
* updates the rows by a left join and finds the new keys by an anti join that
  reads the key column alone.  Neither is a full outer join: a batch below
  Spark's own broadcast bound (its stored size is known) is sent to the rows,
  which then are not shuffled at all; a larger one is joined by shuffle;
* becomes visible by the rename of one log entry.  A crash before it leaves the
  table as it was; a replay of a committed batch (same ``stream`` and number)
  does nothing; of two writers at once one gets ``ConcurrentCommitError``.

A bucket is the unit that is rewritten: more buckets mean less is rewritten for
a small batch.  Every ``compact_every`` merges the rewritten buckets are brought
together first, which keeps the number of their files small.

Semantics are those of ``operators.ledger.upsert``: fields that the batch leaves
out or holds as NULL keep their value; new keys take ``defaults`` for them; a key
that the batch holds twice is an error.  A NULL key equals no other and is
inserted.  An empty batch commits nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txlens.operators.ledger import insert_rows, update_rows
from txlens.session import temporary_tables
from txlens.sources.snapshots import SnapshotLog

#: the run that holds the table's description
TABLE = "table"
BUCKET = "key_bucket"
DEFAULT_BUCKETS = 4096
COMPACT_EVERY = 20


def create_merge_table(rows: DataFrame, path: str, key: str, buckets: int = DEFAULT_BUCKETS) -> "MergeTable":
    """Write ``rows`` as the first version of the table at ``path``."""
    if BUCKET in rows.columns:
        raise ValueError(f"{BUCKET} is a column of the table's own")
    spark, log = rows.sparkSession, SnapshotLog(rows.sparkSession, path)
    if log.state().version >= 0:
        raise ValueError(f"{path} holds a table already")
    commit = log.begin("create", 0)
    about = {"schema": rows.schema.json(), "key": key, "buckets": int(buckets)}
    placed = rows.withColumn(BUCKET, _bucket(F.col(key), buckets)).hint("rebalance", BUCKET)
    log.commit(commit, "create", 0, log.write(placed, commit, [BUCKET]), [], runs_added={TABLE: about})
    return MergeTable(spark, path)


def _bucket(key: F.Column, buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(int(buckets))).cast("int")


class MergeTable:
    """Reads and merges into the table at ``path``."""

    def __init__(self, spark: SparkSession, path: str, compact_every: int = COMPACT_EVERY):
        self.spark, self.compact_every = spark, compact_every
        self.log = SnapshotLog(spark, path)
        about = self.log.state().runs[TABLE]
        self.schema = T.StructType.fromJson(json.loads(about["schema"]))
        self.key, self.buckets = about["key"], about["buckets"]
        self.stored = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])

    def read(self) -> DataFrame:
        """The newest version."""
        return self._rows(self.log.paths(self.log.state())).drop(BUCKET)

    def _rows(self, paths: list[str]) -> DataFrame:
        return self.log.read(self.stored, paths)

    def merge(self, batch: DataFrame, defaults: dict | None = None, stream: str = "merge",
              batch_id: int | None = None) -> list[str]:
        """Upsert ``batch``; returns the partitions written.  With a
        ``batch_id`` (growing) a batch is merged once, however often it is replayed.
        Writers beside each other need a ``stream`` name each."""
        if batch_id is None:
            batch_id = self.log.state().batches.get(stream, -1) + 1
        commit = self.log.begin(stream, batch_id)
        if commit is None:
            return []
        state = self.log.state()
        with temporary_tables(self.spark) as keep:
            keyed = keep(batch.withColumn(self.key, F.col(self.key).cast(self.schema[self.key].dataType))
                         .withColumn(BUCKET, _bucket(F.col(self.key), self.buckets)))
            # at most a number per bucket
            touched = {f"{BUCKET}={r[0]}" for r in keyed.select(BUCKET).distinct().collect()}
            if not touched:
                return []
            old = self._rows(self.log.paths(state, touched.__contains__))
            new = insert_rows(old.drop(BUCKET), keyed.drop(BUCKET), self.key, defaults)
            rows = (update_rows(old.drop(BUCKET), keyed.drop(BUCKET), self.key).unionByName(new)
                    .withColumn(BUCKET, _bucket(F.col(self.key), self.buckets)))
            if state.version % self.compact_every == self.compact_every - 1:
                rows = rows.hint("rebalance", BUCKET)
            written = self.log.write(rows, commit, [BUCKET])
        self.log.commit(commit, stream, batch_id, written, [])
        return written
