"""Oversampling and stratified splitting (SMP1, SMP2, SET1).

Both are deterministic and independent of partitioning: every random choice
is an MD5 draw of (seed, key), so a rerun -- or a recomputed partition after
an executor loss -- gives the same rows, and the DuckDB oracle can repeat it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txlens import constants as K
from txlens.functions.hashing import md5_bigint
from txlens.functions.scalars import with_scalars
from txlens.operators.ordering import global_position


def oversample(df: DataFrame, flag: str = "cloud_rule_risk", key: str = "transaction_id",
               seed: int = K.RISK_SEED, factor: int = K.OVERSAMPLE_FACTOR) -> DataFrame:
    """SMP1: the extra rows of the rebalancing step.

    When any row is flagged, ``m = min(n_normal, factor * n_flagged)`` flagged
    rows are drawn *with replacement* (draw ``j`` takes flagged row number
    ``md5(seed:draw:j) mod n_flagged + 1`` in ``key`` order).  Returns the drawn
    copies with a column ``oversample_draw = j``; empty when nothing is flagged.

    Plan: one aggregate for both counts (two longs read by the driver), a
    distributed global numbering of the flagged rows, ``spark.range(m)`` for
    the draws and one equi-join on the row number.  No row passes through the
    driver and the draws never pile up on one key (they are uniform).
    """
    flagged = df.filter(F.col(flag) == 1)
    draws = _draws(df, flag, seed, factor)
    if draws is None:
        return flagged.withColumn("oversample_draw", F.lit(None).cast("long")).limit(0)
    numbered = global_position(flagged, [F.col(key).asc()], "__pos")
    return numbered.join(draws, "__pos").drop("__pos")


def _draws(df: DataFrame, flag: str, seed: int, factor: int) -> DataFrame | None:
    """(oversample_draw, __pos): the number of the flagged row that each draw takes."""
    counts = df.agg(F.count_if(F.col(flag) == 1).alias("nf"), F.count_if(F.col(flag) == 0).alias("nn")).first()
    nf, nn = int(counts["nf"]), int(counts["nn"])
    m = min(nn, factor * nf) if nf > 0 else 0
    if m == 0:
        return None
    return df.sparkSession.range(m).select(
        F.col("id").alias("oversample_draw"),
        (F.pmod(md5_bigint(F.lit(seed), F.lit("draw"), F.col("id")), F.lit(nf)) + 1).alias("__pos"))


def oversample_weights(df: DataFrame, flag: str = "cloud_rule_risk", key: str = "transaction_id",
                       seed: int = K.RISK_SEED, factor: int = K.OVERSAMPLE_FACTOR,
                       name: str = "weight") -> DataFrame:
    """``df`` with ``name``: how often each row is in the rebalanced set (1 plus its
    draws in SMP1).  Sums and means over that set need no copied rows."""
    draws = _draws(df, flag, seed, factor)
    one = F.lit(1).cast("long")
    if draws is None:
        return df.withColumn(name, one)
    times = draws.groupBy("__pos").agg(F.count(F.lit(1)).alias("__times"))
    flagged = (global_position(df.filter(F.col(flag) == 1), [F.col(key).asc()], "__pos").join(times, "__pos", "left")
               .withColumn(name, one + F.coalesce("__times", F.lit(0))).drop("__pos", "__times"))
    rest = df.filter(~F.coalesce(F.col(flag) == 1, F.lit(False))).withColumn(name, one)
    return rest.unionByName(flagged)


def with_oversample(df: DataFrame, flag: str = "cloud_rule_risk", key: str = "transaction_id",
                    seed: int = K.RISK_SEED, balanced: bool = True) -> DataFrame:
    """SET1: the input rows plus the drawn copies (UNION ALL by name).

    ``oversample_draw`` is NULL on original rows.  ``balanced=False`` skips the
    copies (the per-user means are then not inflated by them).
    """
    base = df.withColumn("oversample_draw", F.lit(None).cast("long"))
    if not balanced:
        return base
    return base.unionByName(oversample(df, flag, key, seed))


def stratified_split(df: DataFrame, label: str, key: str, fraction: float = K.VALIDATION_FRACTION,
                     seed: int = K.MODEL_SEED) -> DataFrame:
    """SMP2: adds ``is_validation``; exactly ``round(fraction * n_class)`` rows of
    every class go to validation.  Rows without a label are a class of their own.

    Rows are ranked inside their class by ``md5(seed:key)`` (ties by key) and
    the first ``round(fraction * n)`` are validation.  The rank uses the
    distributed numbering per class, so no class is held by one task; size and
    start of each class come from the numbered rows.
    """
    h = md5_bigint(F.lit(seed), F.col(key))
    ranked = df.withColumn("__h", h)
    # Global position over (label, hash, key): positions of one class are contiguous.
    pos = global_position(ranked, [F.col(label).asc(), F.col("__h").asc(), F.col(key).asc()], "__gpos")
    classes = pos.groupBy(F.col(label).alias("__label")).agg(F.min("__gpos").alias("__start"),
                                                             F.count(F.lit(1)).alias("__n"))
    j = pos.join(classes, F.col(label).eqNullSafe(F.col("__label")), "left").drop("__label")
    rank = F.col("__gpos") - F.col("__start") + 1
    n_val = F.round(F.lit(fraction) * F.col("__n"))
    return j.withColumn("is_validation", (rank <= n_val).cast("int")).drop("__h", "__gpos", "__start", "__n")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """AGG11: per class ``n / (k * n_class)`` (balanced weights), one row per class.

    Rows and classes in all come from one partially aggregated row, applied as
    constants, so free-text classes never meet in one task."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    total = counts.agg(F.sum("n_class").alias("__rows"), F.count(F.lit(1)).alias("__classes"))
    return with_scalars(counts, total).select(
        label, "n_class", (F.col("__rows") / (F.col("__classes") * F.col("n_class"))).alias("weight"))
