"""Sharding by histogram sort: near-equal bytes per shard, one exchange.

The documents are ordered by (key, row hash).  Splitters of that order are
found by counting, without moving a row: each round sends a set of candidate
boundaries (probes) to all partitions, which return the exact bytes and rows
below each probe; every splitter's interval shrinks to the two probes around
its target, until a probe is within ``tolerance`` or the interval holds one
key only.  Then the rows are exchanged once, by bucket, and sorted inside.

A shard is cut into equal sub-buckets of about ``bucket_bytes``, so no task
sorts a whole shard.  Their number grows with the input: the splitters are
refined ``GROUP`` at a time, each group with counting rounds of its own.  The slot is the bucket's exact row offset, known from
the histogram, plus the rank inside the bucket.

A key that holds a third of all rows is split by the row hash: when an
interval has come down to one key, the probes go on inside it.  Rows equal in
every column have equal places; where a splitter would have to lie among so many
of them that the law fails, the rows are stored once more with a number each,
which then breaks the ties.

Defined results: NULL keys sort first; NULL text has 0 bytes (plus the
16 of every row); an empty table gives an empty result; columns called
``shard`` or ``slot`` in the input are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txlens.llm.common import col, fresh, row_hash, text_or_empty
from txlens.session import materialize

LOW = -(1 << 63)
SPAN = 1 << 64
ROW_BYTES = 16
TOLERANCE = 0.001          # of a bucket's share
BUCKET_BYTES = 64 << 20
GROUP = 10_240             # splitters refined at once, whatever the number of buckets
PROBES_PER_ROUND = 4_096


def row_size(text: str = "text") -> Column:
    return (F.octet_length(text_or_empty(text)) + F.lit(ROW_BYTES)).cast("long")


def _pack(key: int, tie: int) -> int:
    return (key - LOW) * SPAN + (tie - LOW)


def _unpack(place: int) -> tuple[int, int]:
    key = place // SPAN + LOW
    return (key, place % SPAN + LOW) if key < SPAN // 2 else (SPAN // 2 - 1, SPAN // 2 - 1)


def locate(keys: np.ndarray, ties: np.ndarray, at_key: np.ndarray, at_tie: np.ndarray) -> np.ndarray:
    """Number of boundaries at or below each (key, tie); boundaries ascend."""
    lo = np.searchsorted(at_key, keys, "left")
    hi = np.searchsorted(at_key, keys, "right")
    out = hi.copy()
    for k in np.unique(at_key[at_tie != LOW]):
        a, b = np.searchsorted(at_key, k, "left"), np.searchsorted(at_key, k, "right")
        rows = np.flatnonzero((lo == a) & (hi == b))
        if len(rows):
            out[rows] = a + np.searchsorted(at_tie[a:b], ties[rows], "right")
    return out


def _histogram(narrow: DataFrame, probes: list[int]) -> tuple[list[int], list[int]]:
    """Exact bytes and rows below each probe (ascending), over all partitions."""
    at_key = np.array([_unpack(p)[0] for p in probes], "int64")
    at_tie = np.array([_unpack(p)[1] for p in probes], "int64")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.zeros(len(at_key) + 1, "int64")
        rows = np.zeros(len(at_key) + 1, "int64")
        for b in batches:
            where = locate(b.column(0).to_numpy(), b.column(1).to_numpy(), at_key, at_tie)
            size += np.bincount(where, b.column(2).to_numpy(), len(size)).astype("int64")
            rows += np.bincount(where, minlength=len(rows))
        full = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(full.astype("int64")), pa.array(size[full]), pa.array(rows[full])],
            names=["bucket", "bytes", "n"])

    # at most one row per probe comes back
    got = (narrow.mapInArrow(count, "bucket long, bytes long, n long")
           .groupBy("bucket").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect())
    size, rows = [0] * (len(probes) + 1), [0] * (len(probes) + 1)
    for r in got:
        size[r.bucket], rows[r.bucket] = r.bytes, r.n
    return (np.cumsum(size[:-1], dtype="int64").tolist(),
            np.cumsum(rows[:-1], dtype="int64").tolist())


def _probes(lo: int, hi: int, share: float, n: int) -> set[int]:
    """Up to ``n`` + 1 boundaries strictly inside (lo, hi): evenly spaced ones and
    the interpolated place; whole keys first, then places inside one key."""
    first, last = lo // SPAN + 1, (hi - 1) // SPAN
    if first <= last:
        width, base, unit = last - first + 1, first, SPAN
    else:
        width, base, unit = hi - lo - 1, lo + 1, 1
    if width <= 0:
        return set()
    if width <= n:
        return {(base + i) * unit for i in range(width)}
    places = {(base + width * (i + 1) // (n + 1)) * unit for i in range(n)}
    return places | {(base + min(width - 1, int(width * share))) * unit}


def splitters(narrow: DataFrame, n_buckets: int, tolerance: float = TOLERANCE) -> tuple[list[int], list[int], int]:
    """Boundaries that cut (key, tie, size) rows into ``n_buckets`` of near-equal
    bytes, the rows below each, and the number of counting rounds."""
    s = narrow.agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.sum("size").alias("bytes"),
                   F.count(F.lit(1)).alias("n")).first()
    if not s.n or n_buckets < 2:
        return [], [], 0
    total, start, end = int(s.bytes), _pack(s.lo, LOW), _pack(s.hi, LOW) + SPAN
    targets = [total * i // n_buckets for i in range(1, n_buckets)]
    cut, below, rounds, first = [], [], 0, (start, (0, 0))
    for i in range(0, len(targets), GROUP):
        known = dict([first, (end, (total, s.n))])
        places, first, n = _refine(narrow, targets[i:i + GROUP], known, first[0], end,
                                   tolerance * total / n_buckets)
        cut += [p for p, _ in places]
        below += [n_rows for _, n_rows in places]
        rounds += n
    return cut, below, rounds


def _refine(narrow: DataFrame, targets: list[int], known: dict[int, tuple[int, int]], start: int, end: int,
            slack: float) -> tuple[list[tuple[int, int]], tuple[int, tuple[int, int]], int]:
    """(boundary, rows below it) of each target, the last place known to lie at
    or below the last target, and the number of counting rounds."""
    low, high = [start] * len(targets), [end] * len(targets)
    each = max(3, PROBES_PER_ROUND // len(targets))

    def off(i: int) -> tuple[int, int]:
        return min((abs(known[p][0] - targets[i]), p) for p in (low[i], high[i]))

    rounds = 0
    while True:
        probes: set[int] = set()
        for i, t in enumerate(targets):
            if off(i)[0] > slack:
                below, above = known[low[i]][0], known[high[i]][0]
                probes |= _probes(low[i], high[i], (t - below) / max(1, above - below), each)
        probes = sorted(p for p in probes if p not in known)
        if not probes:
            break
        rounds += 1
        size, rows = _histogram(narrow, probes)
        known.update(zip(probes, zip(size, rows)))
        at, order = 0, sorted(known)
        for i, t in enumerate(targets):
            while at + 1 < len(order) and known[order[at + 1]][0] <= t:
                at += 1
            low[i] = max(low[i], order[at])
            high[i] = min(high[i], order[min(at + 1, len(order) - 1)])
        kept = set(low) | set(high) | {start, end}
        known = {p: v for p, v in known.items() if p in kept}
    cut = [off(i)[1] for i in range(len(targets))]
    return [(p, known[p][1]) for p in cut], (low[-1], known[low[-1]]), rounds


def _misfit(narrow: DataFrame, cut: list[int], total: int, n_buckets: int) -> float:
    """How many bytes the worst splitter is off its target."""
    places = sorted(set(cut))
    if not places:
        return 0
    below = dict(zip(places, _histogram(narrow, places)[0]))
    return max(abs(below[p] - total * i // n_buckets) for i, p in enumerate(cut, 1))


def shard_documents(docs: DataFrame, n_shards: int, key_col: str = "doc_id", size: Column | None = None,
                    tolerance: float = TOLERANCE, bucket_bytes: int = BUCKET_BYTES, number: str | None = None) -> DataFrame:
    """``docs`` with ``shard`` (0 .. n_shards-1, near-equal bytes, ascending in
    key order) and ``slot`` (gapless from 0 in each shard, in key order).  ``number``:
    a column that tells equal rows apart."""
    docs = docs.drop("shard", "slot")
    key, tie, sz, place = (fresh(docs, x) for x in ("key", "tie", "size", "place"))
    size = row_size() if size is None else size
    keyed = docs.select("*", F.coalesce(col(key_col).cast("long"), F.lit(LOW)).alias(key),
                        row_hash(docs).alias(tie), size.alias(sz))      # ``number`` is in the hash
    narrow = materialize(keyed.select(F.col(key).alias("key"), F.col(tie).alias("tie"), F.col(sz).alias("size")))
    whole = narrow.agg(F.sum("size").alias("bytes"), F.max("size").alias("largest")).first()
    total = whole.bytes or 0
    per_shard = int(max(1, -(-total // (n_shards * bucket_bytes))))
    n_buckets = n_shards * per_shard
    cut, below, _ = splitters(narrow, n_buckets, tolerance)
    if number is None and _misfit(narrow, cut, total, n_buckets) > max(tolerance * total / n_buckets, whole.largest or 0):
        number = fresh(docs, "number")
        stored = materialize(docs.withColumn(number, F.monotonically_increasing_id()))      # fixed once stored
        return shard_documents(stored, n_shards, key_col, size, tolerance, bucket_bytes, number).drop(number)
    at_key = np.array([_unpack(p)[0] for p in cut], "int64")
    at_tie = np.array([_unpack(p)[1] for p in cut], "int64")
    starts = np.array([0, *below, *[0] * (n_buckets - 1 - len(below))], "int64")
    base = starts - starts[(np.arange(n_buckets) // per_shard) * per_shard]

    @F.pandas_udf("bucket int, base long")
    def bucket_of(k: pd.Series, t: pd.Series) -> pd.DataFrame:
        where = locate(k.to_numpy("int64"), t.to_numpy("int64"), at_key, at_tie)
        return pd.DataFrame({"bucket": where.astype("int32"), "base": base[where]})

    placed = keyed.withColumn(place, bucket_of(F.col(key), F.col(tie)))
    rank = F.row_number().over(Window.partitionBy(F.col(f"{place}.bucket")).orderBy(key, tie))
    return placed.select(
        *[col(c) for c in docs.columns],
        F.floor(F.col(f"{place}.bucket") / per_shard).cast("int").alias("shard"),
        (F.col(f"{place}.base") + rank - 1).cast("long").alias("slot"))
