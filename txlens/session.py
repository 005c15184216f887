"""Session helpers.

The library never creates a session behind the caller's back; these helpers
are for tests, the bench and command-line use.  Settings that matter for
correctness (UTC session time zone, ANSI mode on) are applied on every session
the library is handed via :func:`ensure_session_defaults`.
"""

from __future__ import annotations

import itertools
import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "txlens", extra: dict | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TXLENS_DRIVER_MEMORY", "8g"))
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_session_defaults(spark)
    return spark


def ensure_session_defaults(spark: SparkSession) -> None:
    """Pin the settings the operators' semantics depend on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.ansi.enabled", "true")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and staged outputs.

    On a cluster this is the shared location named by ``spark.checkpoint.dir``
    (read from the session).  Only a local master without that setting (tests,
    local runs) gets a fresh local scratch folder; elsewhere its absence is an
    error, because executors would not see the driver's disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="txlens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def _application_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/txlens-materialized/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def materialize(df):
    """Cut lineage: write ``df`` once as a parquet table in the shared checkpoint
    folder and read it back.

    Used where a large intermediate is read several times, or where two reads
    must see identical rows (ids from ``monotonically_increasing_id``).  The
    table is computed once (an RDD ``checkpoint()`` would recompute it for its
    write) and stored columnar; it lives in the shared folder, never on a
    machine-local disk, so a lost executor does not lose it.

    The tables of an application share one folder, which
    :func:`delete_materialized` removes; jobs that run on and on use
    :func:`temporary_tables`.
    """
    spark = df.sparkSession
    path = f"{_application_folder(spark)}/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def delete_materialized(spark: SparkSession) -> None:
    """Remove every table this application materialised; frames that still read
    them become unusable."""
    _delete(spark, _application_folder(spark))


@contextmanager
def temporary_tables(spark: SparkSession):
    """Yields a :func:`materialize` whose tables go when the block ends."""
    folder = f"{_application_folder(spark)}/{uuid.uuid4().hex}"
    made = itertools.count()

    def keep(df):
        path = f"{folder}/{next(made)}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    try:
        yield keep
    finally:
        _delete(spark, folder)
