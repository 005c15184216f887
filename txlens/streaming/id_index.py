"""Index of all received copies of a stream's ids: sorted runs merged in levels.

An entry is (transaction_id, user_id, event_unix).  Each batch adds one run, its
entries sorted by id in files of at most about ``file_rows`` rows; ``fanout`` runs
of a level are merged into one of the next, so there are at most ``fanout`` runs a
level and an entry is rewritten once a level.  The files' smallest and largest ids
stand in the table's snapshot log.

A lookup opens, of every run, only the files in whose range one of the batch's ids
falls.  Where the batch has few ids (``PUSHED``) they are pushed into the scan,
where Parquet's Bloom filters skip the row groups that hold none of them; a larger
batch is joined.  Ids that grow with time touch the newest files whatever the
history; ids in no order touch at most a file per id and run.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txlens.sources.snapshots import SnapshotLog, State

ENTRY = "transaction_id string, user_id string, event_unix long"
COLUMNS = ["transaction_id", "user_id", "event_unix"]
FILE_ROWS = 200_000
FANOUT = 8
PUSHED = 256        # a pushed list becomes a chain of comparisons, deep in the reader's stack


class IdIndex:
    def __init__(self, log: SnapshotLog, file_rows: int = FILE_ROWS, fanout: int = FANOUT):
        self.log, self.file_rows, self.fanout = log, file_rows, fanout
        #: bytes of the files that each lookup opened, for monitoring
        self.bytes_opened: list[int] = []

    def lookup(self, state: State, ids: DataFrame, n_ids: int) -> DataFrame:
        """The entries of ``ids`` (distinct ``transaction_id``) in the runs of ``state``."""
        spark = self.log.spark
        files = [(f"{self.log.path}/_runs/{run}/{f['name']}", f) for run, note in state.runs.items() for f in note["files"]]
        firsts = [[f["min"].encode() for f in note["files"]] for note in state.runs.values()]
        lasts = [[f["max"].encode() for f in note["files"]] for note in state.runs.values()]

        @F.pandas_udf("array<int>")
        def touched(ids: pd.Series) -> pd.Series:
            own = np.array([x.encode() for x in ids], object)
            found, offset = [[] for _ in own], 0
            for low, high in zip(firsts, lasts):
                at = np.searchsorted(np.array(low, object), own, "right") - 1
                for i in np.flatnonzero(at >= 0):
                    # equal ids may lie on both sides of a border between two files
                    k = int(at[i])
                    while k >= 0 and own[i] <= high[k]:
                        found[i].append(offset + k)
                        k = k - 1 if low[k] == own[i] else -1
                offset += len(low)
            return pd.Series(found)

        opened = (sorted(r[0] for r in ids.select(F.explode(touched("transaction_id"))).distinct().collect())
                  if files else [])                                          # at most a number per file
        self.bytes_opened.append(sum(files[i][1]["bytes"] for i in opened))
        if not opened:
            return spark.createDataFrame([], ENTRY)
        paths = [files[i][0] for i in opened]
        if n_ids <= PUSHED:
            pushing = spark.newSession()          # the caller's session keeps its settings
            pushing.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(PUSHED))
            wanted = [r[0] for r in ids.collect()]
            return pushing.read.schema(ENTRY).parquet(*paths).filter(F.col("transaction_id").isin(wanted))
        return spark.read.schema(ENTRY).parquet(*paths).join(ids, "transaction_id", "left_semi")

    def write(self, entries: DataFrame, name: str, rows: int, level: int) -> dict[str, dict]:
        """A new run (not visible before its commit); returns its note for the log."""
        spark, path = self.log.spark, f"{self.log.path}/_runs/{name}"
        (entries.select(*COLUMNS).repartitionByRange(max(1, -(-rows // self.file_rows)), "transaction_id")
         .sortWithinPartitions("transaction_id", "event_unix").write.mode("overwrite")
         .option("parquet.bloom.filter.enabled#transaction_id", "true")
         .option("parquet.bloom.filter.expected.ndv#transaction_id", str(self.file_rows))
         .option("parquet.block.size", str(4 << 20)).parquet(path))
        of = spark.read.schema(ENTRY).parquet(path).groupBy(
            F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("bytes"))
        files = of.agg(F.min("transaction_id").alias("min"), F.max("transaction_id").alias("max"),
                       F.count(F.lit(1)).alias("rows")).orderBy("min", "max").collect()        # a row per file
        return {name: {"level": level, "files": [r.asDict() for r in files]}}

    def merged(self, state: State, name: str) -> tuple[dict[str, dict], list[str]]:
        """Merge the fullest lower level that is due: (runs added, runs dropped)."""
        spark = self.log.spark
        by_level: dict[int, list[str]] = {}
        for run, note in state.runs.items():
            by_level.setdefault(note["level"], []).append(run)
        for level, runs in sorted(by_level.items()):
            if len(runs) >= self.fanout:
                paths = [f"{self.log.path}/_runs/{run}" for run in runs]
                rows = sum(f["rows"] for run in runs for f in state.runs[run]["files"])
                entries = reduce(DataFrame.unionByName, [spark.read.schema(ENTRY).parquet(p) for p in paths]).distinct()
                return self.write(entries, f"{name}~level{level + 1}", rows, level + 1), runs
        return {}, []
