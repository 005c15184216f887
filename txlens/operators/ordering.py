"""Global order without a single-partition window (SRT1, SRT2 helpers).

``global_position`` numbers rows 1..n in a total order.  The rows are range
partitioned and sorted inside each partition (the plan of ``orderBy``); each
row's index inside its partition comes from ``monotonically_increasing_id``
(partition id in the upper bits, record number in the lower 33 bits), and the
partition's offset from a per-partition count table.  That table has one row
per partition -- its size is bounded by the partition count, not the data --
so it is broadcast.

The numbered rows are read twice (counts, then rows), and both reads must see
the same partition boundaries; range bounds come from sampling, so the tagged
rows are materialised (a parquet table in the session's shared checkpoint
folder) before they are counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txlens.session import materialize

LOW_BITS = 33


def global_position(df: DataFrame, order, name: str = "pos", partitions: int | None = None) -> DataFrame:
    """Number rows 1..n in ``order``.

    The numbered rows are always materialised before they are read twice: even
    over a stored table, the range partitioner re-samples unbalanced input
    partitions with a seed derived from the RDD id, so two reads can draw
    different range bounds.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort_keys = [o for o in order]
    ranged = df.repartitionByRange(n, *sort_keys).sortWithinPartitions(*sort_keys)
    mid = F.monotonically_increasing_id()
    tagged = ranged.select("*", F.shiftright(mid, LOW_BITS).alias("__pid"),
                           mid.bitwiseAND(F.lit((1 << LOW_BITS) - 1)).alias("__idx"))
    tagged = materialize(tagged)
    counts = tagged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(
        "__pid",
        F.coalesce(F.sum("__n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("__off"))
    return (tagged.join(F.broadcast(offsets), "__pid")
            .withColumn(name, F.col("__off") + F.col("__idx") + 1)
            .drop("__pid", "__idx", "__off"))


def prefix_sums(df: DataFrame, order, value_cols: list[str], partitions: int | None = None,
                inclusive: bool = True) -> DataFrame:
    """Running sums of ``value_cols`` in a total order, without a one-task window.

    Rows are dealt to ranges of the order and stored with their range (its bounds
    are sampled, so they are drawn once); a window inside each range adds up in the
    JVM, and the range's offset comes from a table of one row per range, broadcast.
    Adds ``<c>_cum`` (inclusive, or exclusive when ``inclusive=False``); NULL
    counts as 0.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    local = materialize(df.repartitionByRange(n, *order).withColumn("__pid", F.spark_partition_id()))
    totals = local.groupBy("__pid").agg(*[F.sum(c).cast("double").alias(f"{c}_tot") for c in value_cols])
    prior = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__pid", *[F.coalesce(F.sum(f"{c}_tot").over(prior), F.lit(0.0)).alias(f"{c}_off")
                                       for c in value_cols])
    run = Window.partitionBy("__pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = (local.select("*", *[F.coalesce(F.sum(F.col(c).cast("double")).over(run), F.lit(0.0)).alias(f"{c}_cum")
                               for c in value_cols])
           .join(F.broadcast(offsets), "__pid"))
    for c in value_cols:
        out = out.withColumn(f"{c}_cum", F.col(f"{c}_cum") + F.col(f"{c}_off")).drop(f"{c}_off")
    return out.drop("__pid")
