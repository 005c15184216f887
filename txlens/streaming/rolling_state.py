"""STR2: rolling features with per-user streaming state.

``transformWithStateInPandas`` keyed by user.  The state is held in pieces, so
that a batch reads and writes what it touches, not the user's whole history:

* ``cells``: the rows of each hour, the latest copy per transaction id;
* ``places``: the hour in which an id's current copy lies, in buckets of ids;
* ``untimed``: rows without a time (they see only each other);
* ``newest``: the newest event time, and a sequence number.

For each micro-batch and user:

* rows older than ``newest - lateness`` are not lost: they are emitted with
  ``kind = 'late'`` and no features, for a side output (:func:`late_rows`);
* a new copy of an id replaces the older one wherever that lies (keep-latest);
* the changed times are those of the new rows *and* of the copies they replace;
  every row from the earliest of them to 24 h after the latest is recomputed
  and emitted again with a growing ``emit_seq``, so a downstream upsert by
  ``transaction_id`` keeping the highest ``emit_seq`` holds the exact features;
* hours before ``newest - lateness - 24 h`` are evicted with their ids (those that a
  batch itself passes by are never stored).

With ``ttl_seconds`` the state of a user that sends nothing for that long (at
least lateness + 24 h, in processing time) expires.

Per batch and user one task holds the rows of the hours between the earliest
changed time minus 24 h and the latest plus 24 h.  All work on them is vectorised
and goes by whole hours, buckets of ids and days, so the calls to the state store
follow those, not the rows; features are handed out day by day.  An id is expected to stay with one user (STR1 has no such limit).
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from txlens.constants import (RULE_BURST_COUNT_MIN, RULE_NIGHT_AMOUNT_ABOVE, RULE_NIGHT_HOUR_MAX,
                              RULE_PROBABILITY_MIN, WINDOW_10M_SECONDS, WINDOW_24H_SECONDS)

ROW_FIELDS = [
    ("transaction_id", T.StringType()), ("user_id", T.StringType()), ("amount", T.DoubleType()),
    ("event_time", T.StringType()), ("hour", T.IntegerType()), ("device_risk", T.DoubleType()),
    ("location_risk", T.DoubleType()), ("txn_velocity", T.DoubleType()),
    ("edge_fraud_probability", T.DoubleType()), ("status", T.StringType()), ("event_unix", T.LongType()),
    ("event_ms", T.LongType()),
]
ROW_SCHEMA = T.StructType([T.StructField(n, t) for n, t in ROW_FIELDS])
ROW_NAMES = [n for n, _ in ROW_FIELDS]

CELL_SECONDS = 3600
PLACE_BUCKETS = 256
EMIT_CELLS = 24          # features are computed and handed out for so many hours at once
PACKED = T.StructType([T.StructField("rows", T.BinaryType())])
LONG = T.StructType([T.StructField("n", T.LongType())])

OUTPUT_SCHEMA = T.StructType(ROW_SCHEMA.fields + [
    T.StructField("is_blocked", T.IntegerType()),
    T.StructField("rolling_total_spend_24h", T.DoubleType()),
    T.StructField("rolling_txn_count_24h", T.LongType()),
    T.StructField("rolling_avg_amount_24h", T.DoubleType()),
    T.StructField("rolling_blocked_count_24h", T.LongType()),
    T.StructField("rolling_txn_count_10m", T.LongType()),
    T.StructField("cloud_rule_risk", T.IntegerType()),
    T.StructField("emit_seq", T.LongType()), T.StructField("kind", T.StringType()),
])
FEATURES = [f.name for f in OUTPUT_SCHEMA.fields if f.name not in ROW_NAMES + ["emit_seq", "kind"]]

_ARROW = {T.StringType: pa.string(), T.DoubleType: pa.float64(), T.IntegerType: pa.int32(), T.LongType: pa.int64()}
PACK_SCHEMA = pa.schema([(n, _ARROW[type(t)]) for n, t in ROW_FIELDS])


def pack(rows: pd.DataFrame) -> bytes:
    """Rows as one Arrow stream, for the state."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, PACK_SCHEMA) as out:
        out.write_batch(pa.RecordBatch.from_pandas(rows[ROW_NAMES], schema=PACK_SCHEMA, preserve_index=False))
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


DEDUPE_ORDER = ["event_ms", "user_id", "amount", "event_time", "hour", "device_risk", "location_risk",
                "txn_velocity", "edge_fraud_probability", "status"]


def untimed_features(rows: pd.DataFrame) -> pd.DataFrame:
    """Features of one user's rows without a time: every row sees all of them."""
    whole = rows.assign(event_unix=0)
    out = frame_features(whole, whole["transaction_id"].to_numpy())
    out["event_unix"] = None
    return out


def frame_features(rows: pd.DataFrame, targets: np.ndarray) -> pd.DataFrame:
    """Features of ``rows[targets]`` over all ``rows`` (one user, times not NULL)."""
    rows = rows.sort_values("event_unix", kind="mergesort").reset_index(drop=True)
    t = rows["event_unix"].to_numpy(dtype=np.int64)
    amount = rows["amount"].to_numpy(dtype=np.float64)
    has_amount = ~np.isnan(amount)
    blocked = (rows["status"].to_numpy(dtype=object) == "blocked").astype(np.int64)
    cs_amt = np.r_[0.0, np.cumsum(np.where(has_amount, amount, 0.0))]
    cs_n = np.r_[0, np.cumsum(has_amount.astype(np.int64))]
    cs_b = np.r_[0, np.cumsum(blocked)]
    sel = rows["transaction_id"].isin(targets).to_numpy()
    ts = t[sel]
    hi = np.searchsorted(t, ts, side="right")
    lo24 = np.searchsorted(t, ts - WINDOW_24H_SECONDS, side="left")
    lo10 = np.searchsorted(t, ts - WINDOW_10M_SECONDS, side="left")
    n_amt = cs_n[hi] - cs_n[lo24]
    spend = cs_amt[hi] - cs_amt[lo24]
    out = rows.loc[sel, ROW_NAMES].copy()
    out["is_blocked"] = blocked[sel].astype(np.int32)
    out["rolling_total_spend_24h"] = np.where(n_amt > 0, spend, np.nan)
    out["rolling_txn_count_24h"] = (hi - lo24).astype(np.int64)
    out["rolling_avg_amount_24h"] = np.where(n_amt > 0, spend / np.maximum(n_amt, 1), np.nan)
    out["rolling_blocked_count_24h"] = (cs_b[hi] - cs_b[lo24]).astype(np.int64)
    out["rolling_txn_count_10m"] = (hi - lo10).astype(np.int64)
    prob = out["edge_fraud_probability"].to_numpy(dtype=np.float64)
    hour = out["hour"].to_numpy(dtype=np.float64)
    flag = ((prob >= RULE_PROBABILITY_MIN) | (out["rolling_txn_count_10m"].to_numpy() >= RULE_BURST_COUNT_MIN)
            | ((out["amount"].to_numpy(dtype=np.float64) > RULE_NIGHT_AMOUNT_ABOVE) & (hour <= RULE_NIGHT_HOUR_MAX)))
    out["cloud_rule_risk"] = flag.astype(np.int32)
    return out


class RollingStateProcessor(StatefulProcessor):
    def __init__(self, lateness_seconds: int = WINDOW_24H_SECONDS, ttl_seconds: int | None = None):
        self.lateness = int(lateness_seconds)
        self.ttl = None if ttl_seconds is None else int(ttl_seconds) * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        number = T.StructType([T.StructField("n", T.LongType())])
        self.cells = handle.getMapState("cells", number, PACKED, self.ttl)
        self.places = handle.getMapState("places", number, PACKED, self.ttl)
        self.untimed = handle.getValueState("untimed", PACKED, self.ttl)
        self.newest = handle.getValueState("newest", LONG, self.ttl)
        self.seq = handle.getValueState("seq", LONG, self.ttl)
        self.oldest = handle.getValueState("oldest", LONG, self.ttl)

    # -- state access ---------------------------------------------------------

    def _number(self, state, default: int | None) -> int | None:
        return int(state.get()[0]) if state.exists() else default

    def _ids(self, bucket: int) -> dict[str, int]:
        """Cell by transaction id, of the ids of a bucket."""
        return pickle.loads(self.places.getValue((bucket,))[0]) if self.places.containsKey((bucket,)) else {}

    @staticmethod
    def _buckets(ids: pd.Series) -> np.ndarray:
        return np.fromiter((zlib.crc32((i or "").encode()) % PLACE_BUCKETS for i in ids), dtype=np.int64, count=len(ids))

    # -- one batch of one user ------------------------------------------------

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)[ROW_NAMES]
        before, oldest = self._number(self.newest, -(2 ** 62)), self._number(self.oldest, None)
        late = (new["event_unix"] < before - self.lateness).fillna(False).astype(bool)
        if late.any():
            yield self._emit(new[late], "late", 0)
        new = self._latest(new[~late]).reset_index(drop=True)
        if new.empty:
            return
        empty = new.iloc[:0]
        loaded: dict[int, pd.DataFrame] = {}

        def cell_rows(cell: int) -> pd.DataFrame:
            if cell not in loaded:
                stored = (oldest is not None and oldest <= cell <= before // CELL_SECONDS
                          and self.cells.containsKey((cell,)))
                loaded[cell] = unpack(self.cells.getValue((cell,))[0]) if stored else empty
            return loaded[cell]

        # where the ids were, and their former copies
        bucket = self._buckets(new["transaction_id"])
        ids = {b: self._ids(b) for b in np.unique(bucket).tolist()}
        was = [ids[b].get(i) for b, i in zip(bucket.tolist(), new["transaction_id"])]
        held = unpack(self.untimed.get()[0]) if self.untimed.exists() else empty
        former = [f[f["transaction_id"].isin(new["transaction_id"])]
                  for f in [held, *[cell_rows(c) for c in sorted({c for c in was if c is not None})]] if len(f)]
        former = pd.concat(former, ignore_index=True) if any(len(f) for f in former) else empty
        displaced = former
        if len(former):
            # the newer copy stays, of equal ones the one that is here
            again = new["transaction_id"].isin(former["transaction_id"])
            last = self._latest(pd.concat([new[again].assign(__new=True), former.assign(__new=False)], ignore_index=True))
            stays = last.loc[~last["__new"], "transaction_id"]
            keep = ~new["transaction_id"].isin(stays).to_numpy()
            new, bucket = new[keep].reset_index(drop=True), bucket[keep]
            displaced = former[~former["transaction_id"].isin(stays)]
        seq = self._number(self.seq, 0) + 1
        self.seq.update((seq,))
        timed = new["event_unix"].notna().to_numpy()
        was_untimed = displaced["event_unix"].isna()
        if was_untimed.any() or not timed.all():
            parts = [f for f in (held[~held["transaction_id"].isin(displaced["transaction_id"])], new[~timed]) if len(f)]
            held = pd.concat(parts, ignore_index=True) if parts else empty
            self.untimed.update((pack(held),))
            if len(held):
                yield self._emit(untimed_features(held), "feature", seq)
        new, bucket, displaced = new[timed], bucket[timed], displaced[~was_untimed]
        t = new["event_unix"].to_numpy(dtype=np.int64)
        left = displaced["event_unix"].to_numpy(dtype=np.int64)
        times = np.concatenate([t, left])
        if not len(times):
            return

        # the changed cells
        dirty = set()
        for cell in np.unique(left // CELL_SECONDS).tolist():
            here = cell_rows(cell)
            loaded[cell] = here[~here["transaction_id"].isin(displaced["transaction_id"])]
            dirty.add(cell)
        cell_of = t // CELL_SECONDS
        for cell, mine in new.groupby(cell_of, sort=False):
            here = cell_rows(int(cell))
            loaded[int(cell)] = pd.concat([here, mine], ignore_index=True) if len(here) else mine
            dirty.add(int(cell))
        newest = max(before, int(times.max()))
        self.newest.update((newest,))
        lo, hi = int(times.min()), int(times.max()) + WINDOW_24H_SECONDS
        first = min(lo // CELL_SECONDS if oldest is None else oldest, lo // CELL_SECONDS)
        back = WINDOW_24H_SECONDS // CELL_SECONDS + 1
        end = min(hi, newest) // CELL_SECONDS + 1
        for start in range(lo // CELL_SECONDS, end, EMIT_CELLS):
            around = [cell_rows(c) for c in range(max(start - back, first), min(start + EMIT_CELLS, end))]
            around = [f for f in around if len(f)]
            if around:
                around = pd.concat(around, ignore_index=True)
                from_, to = max(lo, start * CELL_SECONDS), min(hi, (start + EMIT_CELLS) * CELL_SECONDS - 1)
                inside = around["event_unix"].between(from_, to)
                if inside.any():
                    yield self._emit(frame_features(around, around.loc[inside, "transaction_id"].to_numpy()), "feature", seq)

        # what stays: no hour, and no id, before the horizon
        keep_from = (newest - self.lateness - WINDOW_24H_SECONDS) // CELL_SECONDS
        for b, i, cell in zip(bucket.tolist(), new["transaction_id"], cell_of.tolist()):
            ids[b][i] = cell
        changed = set(bucket.tolist())
        for cell in range(first if oldest is None else oldest, min(keep_from, before // CELL_SECONDS + 1)):
            if self.cells.containsKey((cell,)):
                evicted = unpack(self.cells.getValue((cell,))[0])["transaction_id"]
                changed |= set(self._buckets(evicted).tolist())
                self.cells.removeKey((cell,))
        for b in changed:
            kept = {i: cell for i, cell in (ids[b] if b in ids else self._ids(b)).items() if cell >= keep_from}
            if kept:
                self.places.updateValue((b,), (pickle.dumps(kept),))
            elif self.places.containsKey((b,)):
                self.places.removeKey((b,))
        for cell in sorted(c for c in dirty if c >= keep_from):
            if len(loaded[cell]):
                self.cells.updateValue((cell,), (pack(loaded[cell]),))
            elif self.cells.containsKey((cell,)):
                self.cells.removeKey((cell,))
        self.oldest.update((max(first, keep_from),))

    @staticmethod
    def _latest(rows: pd.DataFrame) -> pd.DataFrame:
        """The latest copy per id; of equal ones the last.  Only repeated ids are sorted."""
        repeated = rows["transaction_id"].duplicated(keep=False)
        if not repeated.any():
            return rows
        latest = (rows[repeated].sort_values(DEDUPE_ORDER, kind="mergesort", na_position="first")
                  .drop_duplicates("transaction_id", keep="last"))
        return pd.concat([rows[~repeated], latest]) if not repeated.all() else latest

    @staticmethod
    def _emit(rows: pd.DataFrame, kind: str, seq: int) -> pd.DataFrame:
        out = rows.assign(emit_seq=np.int64(seq), kind=kind)
        for c in FEATURES:
            if c not in out:
                out[c] = None
        return out[OUTPUT_SCHEMA.names]

    def close(self) -> None:
        pass


def rolling_state_stream(typed_stream: DataFrame, lateness_seconds: int = WINDOW_24H_SECONDS,
                         ttl_seconds: int | None = None) -> DataFrame:
    """Apply STR2 to a typed stream (the ten feed columns, ``event_unix`` and
    ``event_ms``, the epoch milliseconds that order copies for keep-latest)."""
    if ttl_seconds is not None and ttl_seconds < lateness_seconds + WINDOW_24H_SECONDS:
        raise ValueError("the state must outlive lateness + 24 h")
    spark = typed_stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return (typed_stream.select(*ROW_NAMES).groupBy("user_id")
            .transformWithStateInPandas(RollingStateProcessor(lateness_seconds, ttl_seconds), OUTPUT_SCHEMA,
                                        outputMode="Append", timeMode="None" if ttl_seconds is None else "ProcessingTime"))


def latest_emitted(emitted: DataFrame) -> DataFrame:
    """The upsert view of STR2's output: highest ``emit_seq`` per transaction id."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    w = Window.partitionBy("transaction_id").orderBy(F.col("emit_seq").desc())
    return (emitted.filter("kind = 'feature'").withColumn("__rn", F.row_number().over(w)).filter("__rn = 1")
            .drop("__rn", "emit_seq", "kind"))


def late_rows(emitted: DataFrame) -> DataFrame:
    """The side output: rows that came later than the allowed lateness."""
    return emitted.filter("kind = 'late'").select(*ROW_NAMES)
