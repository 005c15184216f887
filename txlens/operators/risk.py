"""Risk analysis (ML1-ML5, AGG1, AGG2, AGG9, AGG10).

Global statistics are one ``agg`` over the data -- partial aggregation on every
task, one row at the end -- applied as constants (``functions.scalars``): the
single row is read back, like a fitted scaler, and never joined to the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txlens import constants as K
from txlens.functions.scalars import with_scalars
from txlens.operators.vector_sums import block_rows, longs, row_blocks, sum_vectors


def minmax_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """AGG9: one row with ``<c>_min`` / ``<c>_max`` for every column."""
    return df.agg(*[f(c).alias(f"{c}_{n}") for c in cols for n, f in (("min", F.min), ("max", F.max))])


def moments(df: DataFrame, cols: list[str]) -> DataFrame:
    """AGG10: one row with mean, sample std (n-1) and population std (n) per column."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std_samp"),
                 F.stddev_pop(c).alias(f"{c}_std_pop")]
    return df.agg(*aggs)


def _with_stats(df: DataFrame, stats: DataFrame) -> DataFrame:
    return with_scalars(df, stats)


def minmax(df: DataFrame, cols: list[str], suffix: str = "_mm", stats_from: DataFrame | None = None) -> DataFrame:
    """ML3: ``(x - min) / (max - min)`` per column; all 0 when the column is constant.

    Copies do not move min or max, so the scaling is the same with or without
    oversampling; ``stats_from`` may name the rows before the copies were
    appended, so the statistics pass does not recompute the copies.
    """
    stats = minmax_stats(df if stats_from is None else stats_from, cols)
    j = _with_stats(df, stats)
    for c in cols:
        lo, hi = F.col(f"{c}_min"), F.col(f"{c}_max")
        j = j.withColumn(f"{c}{suffix}", F.when(hi == lo, F.lit(0.0)).otherwise((F.col(c) - lo) / (hi - lo)))
    return j.drop(*[f"{c}_{n}" for c in cols for n in ("min", "max")])


def zscore(df: DataFrame, cols: list[str], ddof: int = 1, suffix: str = "_z") -> DataFrame:
    """ML1: ``(x - mean) / std`` with sample (ddof=1) or population (ddof=0) std.

    A zero std gives 0 (instead of NaN), so clustering still runs.
    """
    stats = moments(df, cols)
    j = _with_stats(df, stats)
    std_kind = "std_samp" if ddof == 1 else "std_pop"
    for c in cols:
        sd = F.col(f"{c}_{std_kind}")
        j = j.withColumn(f"{c}{suffix}", F.when((sd.isNull()) | (sd == 0), F.lit(0.0))
                         .otherwise((F.col(c) - F.col(f"{c}_mean")) / sd))
    return j.drop(*[f"{c}_{n}" for c in cols for n in ("mean", "std_samp", "std_pop")])


def risk_score(df: DataFrame, flag: str = "cloud_rule_risk", stats_from: DataFrame | None = None) -> DataFrame:
    """ML4: ``100 * (0.30 mm(amount) + 0.25 mm(spend_24h) + 0.20 mm(location)
    + 0.20 mm(device) + 0.05 flag)``.  A NULL input gives a NULL score.
    ``stats_from``: see :func:`minmax`."""
    cols = [c for c, _ in K.RISK_WEIGHTS]
    scaled = minmax(df, cols, "__mm", stats_from)
    total = sum((F.lit(w) * F.col(f"{c}__mm") for c, w in K.RISK_WEIGHTS), F.lit(0.0))
    total = total + F.lit(K.RISK_FLAG_WEIGHT) * F.col(flag)
    return scaled.withColumn("risk_score", F.lit(100.0) * total).drop(*[f"{c}__mm" for c in cols])


def user_risk(scored: DataFrame, user_col: str = "user_id", weight: str | None = None) -> DataFrame:
    """AGG1: mean risk score per user; rows with NULL user or score are skipped.
    ``weight`` counts a row as so many."""
    rows = scored.dropna(subset=[user_col, "risk_score"]).groupBy(user_col)
    if weight is None:
        return rows.agg(F.avg("risk_score").alias("risk_score"))
    return rows.agg((F.sum(F.col("risk_score") * F.col(weight)) / F.sum(weight)).alias("risk_score"))


HOTSPOT_SCHEMA = T.StructType([T.StructField("hour", T.IntegerType()),
                               T.StructField("fraud_events", T.LongType())])


def hotspots(scored: DataFrame, flag: str = "cloud_rule_risk", weight: str | None = None) -> DataFrame:
    """AGG2: flagged rows per hour; hours present with no flags keep a 0.
    ``weight`` counts a row as so many.

    Without an ``hour`` column the result is an empty table of the same schema.
    """
    if "hour" not in scored.columns:
        return scored.sparkSession.createDataFrame([], HOTSPOT_SCHEMA)
    return (scored.dropna(subset=["hour", flag])
            .groupBy("hour").agg(F.sum(F.col(flag) * (F.col(weight) if weight else 1)).cast("long").alias("fraud_events")))


def blacklist(user_scores: DataFrame, flagged_at, threshold: float = K.BLACKLIST_SCORE_ABOVE) -> DataFrame:
    """ML5: users above the threshold with the run time and the fixed reason.

    ``flagged_at`` is passed in (the run time), so reruns are repeatable.  The
    cluster id is not used, as in the original.
    """
    at = flagged_at if hasattr(flagged_at, "_jc") else F.lit(flagged_at).cast("timestamp")
    return (user_scores.filter(F.col("risk_score") > threshold)
            .select("user_id", at.alias("flagged_at"), F.lit(K.BLACKLIST_REASON).alias("reason")))


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in (0, 1) from 64-bit hashes, another series per salt."""
    x = h.astype("uint64") + np.uint64((salt * 0x9E3779B97F4A7C15) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype("float64") / 2.0 ** 53 + 2.0 ** -54


def _squared_distances(x: np.ndarray, centres: np.ndarray) -> list[np.ndarray]:
    """Of the points (the columns of ``x``) to each centre; a plain loop over few
    dimensions keeps every array in the cache."""
    return [sum((x[j] - c[j]) ** 2 for j in range(len(c))) for c in centres]


def _draw_centres(blocks: DataFrame, d: int, centres: list[np.ndarray], seed: int) -> list[np.ndarray]:
    """One more centre per start, drawn with probability weight x squared distance to
    the start's centres (k-means++): a row's logarithmic weight plus a Gumbel number
    of its hash; the largest wins.  One pass for all starts."""
    starts = len(centres)

    def best(batches):
        key, at = np.full(starts, -np.inf), np.zeros((starts, d))
        for rows in block_rows(batches, d + 2):
            x, w, h = np.ascontiguousarray(rows[:, :d].T), rows[:, d], longs(rows[:, d + 1])
            for s in range(starts):
                far = np.minimum.reduce(_squared_distances(x, centres[s])) if len(centres[s]) else np.ones(len(w))
                with np.errstate(divide="ignore"):
                    own = np.log(w * far) - np.log(-np.log(_uniform(h, (seed + s) * 1009 + len(centres[s]))))
                i = int(own.argmax())
                if own[i] > key[s]:
                    key[s], at[s] = own[i], x[:, i]
        found = np.flatnonzero(key > -np.inf)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found, pa.int32()), pa.array(key[found]), pa.array(list(at[found]), pa.list_(pa.float64()))],
            names=["s", "key", "x"])

    drawn = (blocks.mapInArrow(best, "s int, key double, x array<double>").groupBy("s")
             .agg(F.max(F.struct("key", "x")).alias("m")).collect())                     # a row per start
    of = {r.s: np.array(r.m.x) for r in drawn}
    return [np.vstack([c, of[s]]) for s, c in enumerate(centres)]


def _lloyd_pass(blocks: DataFrame, d: int, centres: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(sums, weights, cost) of each start's clusters, all in one pass."""
    k = len(centres[0])
    width = k * (d + 1) + 1

    def partial(batches):
        total = np.zeros((len(centres), width))
        for rows in block_rows(batches, d + 2):
            x, w = np.ascontiguousarray(rows[:, :d].T), rows[:, d]
            weighted = np.vstack([w, x * w])                     # weights, then each dimension
            for s, c in enumerate(centres):
                near, own = np.full(len(w), np.inf), np.zeros(len(w), dtype=np.int8)
                for i, far in enumerate(_squared_distances(x, c)):
                    closer = far < near                          # the first of equally near ones
                    own[closer] = i
                    near = np.minimum(near, far)
                member = (own == np.arange(k, dtype=np.int8)[:, None]).astype("float64")
                total[s, :-1] += (weighted @ member.T).ravel()
                total[s, -1] += w @ near
        yield total.ravel()

    sums = sum_vectors(blocks, partial, len(centres) * width).reshape(len(centres), width)
    return [(v[k:-1].reshape(d, k).T, v[:k], float(v[-1])) for v in sums]


def kmeans(df: DataFrame, cols: list[str], k: int = K.CLUSTER_K, starts: int = K.CLUSTER_STARTS,
           seed: int = K.RISK_SEED, max_iter: int = K.CLUSTER_MAX_ITER, out: str = "cluster", tol: float = 1e-4):
    """ML2: best of ``starts`` k-means runs (lowest cost) on ``cols``.

    Equal points are first grouped to one with a weight (narrow, stored, and packed
    once into blocks that stay with the executors).  Every pass over them serves all starts at once: a seeding pass draws one centre for
    each, a Lloyd pass moves the centres of the starts that still move (by more
    than ``tol``); so the passes are those of one run.  Draws are hashes of the
    points: the result does not depend on partitions.  Clusters are numbered 1..k
    by ascending centre; a row's cluster is an expression over the constants.

    Returns (DataFrame with ``out``, centres, cost).  Rows with a NULL or
    non-finite feature take no part and get a NULL cluster.  Fewer than k distinct
    points is an error, as in the original.
    """
    from txlens.session import materialize

    whole, d = F.lit(True), len(cols)
    for c in cols:
        x = F.col(c).cast("double")
        whole = whole & F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False))
    names = [f"x{i}" for i in range(d)]
    points = materialize(df.filter(whole).select(*[(F.col(c).cast("double") + 0.0).alias(n) for c, n in zip(cols, names)])
                         .groupBy(*names).agg(F.count(F.lit(1)).cast("double").alias("w"))
                         .withColumn("h", F.xxhash64(*names)))
    if (distinct := points.limit(k).count()) < k:
        raise ValueError(f"k-means needs at least {k} distinct points, got {distinct}")
    blocks = row_blocks(points.select(*names, "w", "h"), d + 2, required=(d, d + 1)).persist()
    try:
        centres = [np.zeros((0, d)) for _ in range(starts)]
        for _ in range(k):
            centres = _draw_centres(blocks, d, centres, seed)
        moving = list(range(starts))
        for _ in range(max_iter):
            for s, (sums, weights, _) in zip(list(moving), _lloyd_pass(blocks, d, [centres[s] for s in moving])):
                new = np.where(weights[:, None] > 0, sums / np.maximum(weights, 1e-300)[:, None], centres[s])
                if ((new - centres[s]) ** 2).sum(axis=1).max() <= tol ** 2:
                    moving.remove(s)
                centres[s] = new
            if not moving:
                break
        costs = [cost for _, _, cost in _lloyd_pass(blocks, d, centres)]
    finally:
        blocks.unpersist()
    best = int(np.argmin(costs))
    ordered = sorted(c.tolist() for c in centres[best])
    far = [F.struct(sum((F.col(c) - F.lit(v)) ** 2 for c, v in zip(cols, centre)).alias("far"), F.lit(i + 1).alias("i"))
           for i, centre in enumerate(ordered)]
    return df.withColumn(out, F.when(whole, F.array_min(F.array(*far))["i"]).cast("int")), ordered, costs[best]
