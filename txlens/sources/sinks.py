"""Writers (SNK1, SNK2, SNK3, SNK6).

Every write is distributed (executors write their partitions); nothing is
collected to the driver.  A published table is a folder of versions and a
pointer file: a new version is written beside the old one, then the pointer is
replaced by one atomic rename.  Readers (``feed.read_published``) follow the
pointer; a failed write leaves it where it was.  The version before the current
one is kept for readers that have just opened it.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txlens.sources.feed import CSV_OPTIONS, POINTER, current_version, hadoop_path


def _point_to(spark: SparkSession, path: str, version: str) -> None:
    jvm = spark.sparkContext._jvm
    fs, fresh = hadoop_path(spark, f"{path}/{POINTER}.{uuid.uuid4().hex}")
    _, pointer = hadoop_path(spark, f"{path}/{POINTER}")
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    # raises if it fails; readers see the old pointer or the new one
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(fresh), fs.makeQualified(pointer), overwrite)
    if current_version(spark, path) != f"{path}/{version}":
        raise OSError(f"{path}: the pointer does not name {version}")


def publish(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None, skip_empty: bool = False,
            **options) -> bool:
    """Write ``df`` as the new version of the table at ``path``.  With
    ``skip_empty`` a version without data files is thrown away (False)."""
    spark, path = df.sparkSession, path.rstrip("/")
    version = f"version={time.time_ns()}-{uuid.uuid4().hex[:8]}"
    w = df.write.mode("overwrite").format(fmt).options(**options)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.save(f"{path}/{version}")
    fs, folder = hadoop_path(spark, f"{path}/{version}")
    if skip_empty and not any(s.isDirectory() for s in fs.listStatus(folder)):
        fs.delete(folder, True)
        return False
    before = current_version(spark, path)
    _point_to(spark, path, version)
    _, root = hadoop_path(spark, path)
    for s in fs.listStatus(root):
        name = s.getPath().getName()
        if name.startswith("version=") and name < version and not (before or "").endswith(name):
            fs.delete(s.getPath(), True)
    return True


def write_features(df: DataFrame, path: str, partition_by: str = "event_date") -> bool:
    """SNK1: publish the feature table (parquet partitioned by event date).

    Rows are brought together by date first (a date with very many rows is split
    by the adaptive plan), so the table is not tasks x dates small files.  Empty
    input publishes nothing and returns False; the input is computed once.
    """
    out = df.withColumn(partition_by, F.to_date("event_ts")) if partition_by not in df.columns else df
    return publish(out.hint("rebalance", partition_by), path, "parquet", partition_by, skip_empty=True)


def write_risk_outputs(outputs: dict[str, DataFrame], path: str, fmt: str = "parquet") -> list[str]:
    """SNK2: the risk run's tables, each published (empty ones keep their schema)."""
    written = []
    for name in ("blacklist", "enriched", "user_risk", "hotspots"):
        if name in outputs:
            written.append(f"{path.rstrip('/')}/{name}")
            publish(outputs[name], written[-1], fmt, **({"header": "true"} if fmt == "csv" else {}))
    return written


def append_transactions(df: DataFrame, path: str) -> None:
    """SNK3: append feed rows as CSV with a header; fields holding a comma, a
    quote or a newline are quoted, quotes doubled (RFC 4180)."""
    df.write.mode("append").options(**CSV_OPTIONS).option("quoteAll", False).csv(path)


def write_scaler(scaler: DataFrame, path: str) -> None:
    """SNK6: one-row scaler artifact (feature_names, mean, scale) as JSON."""
    publish(scaler.coalesce(1), path, "json")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """SNK6: one-row metrics artifact (val_loss, val_accuracy, val_auc, dataset_source) as JSON."""
    publish(metrics.coalesce(1), path, "json")
