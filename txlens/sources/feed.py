"""Readers (SRC1, SRC3, SRC4, SRC5).

Paths may be on any Hadoop file system; existence checks go through the
session's Hadoop configuration, never the local disk of the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from txlens.constants import REQUIRED_COLUMNS
from txlens.operators.normalize import MissingColumnsError, require_columns

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in REQUIRED_COLUMNS])

FEATURE_SCHEMA = T.StructType(
    [T.StructField("transaction_id", T.StringType()), T.StructField("user_id", T.StringType()),
     T.StructField("amount", T.DoubleType()), T.StructField("event_time", T.StringType()),
     T.StructField("hour", T.IntegerType()), T.StructField("device_risk", T.DoubleType()),
     T.StructField("location_risk", T.DoubleType()), T.StructField("txn_velocity", T.DoubleType()),
     T.StructField("edge_fraud_probability", T.DoubleType()), T.StructField("status", T.StringType()),
     T.StructField("event_ts", T.TimestampType()), T.StructField("event_unix", T.LongType()),
     T.StructField("is_blocked", T.IntegerType()), T.StructField("rolling_total_spend_24h", T.DoubleType()),
     T.StructField("rolling_txn_count_24h", T.LongType()), T.StructField("rolling_avg_amount_24h", T.DoubleType()),
     T.StructField("rolling_blocked_count_24h", T.LongType()), T.StructField("rolling_txn_count_10m", T.LongType()),
     T.StructField("cloud_rule_risk", T.IntegerType())])

CARD_SCHEMA = T.StructType(
    [T.StructField("Time", T.DoubleType())]
    + [T.StructField(f"V{i}", T.DoubleType()) for i in range(1, 29)]
    + [T.StructField("Amount", T.DoubleType()), T.StructField("Class", T.IntegerType())])

USER_SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("email", T.StringType()),
                            T.StructField("name", T.StringType())])
PROFILE_SCHEMA = T.StructType([T.StructField("user_id", T.StringType()),
                               T.StructField("account_balance", T.DecimalType(14, 2)),
                               T.StructField("monthly_income", T.DecimalType(14, 2)),
                               T.StructField("risk_appetite", T.StringType())])

TRANSACTION_SCHEMA = T.StructType(
    [T.StructField("transaction_id", T.StringType()), T.StructField("user_id", T.StringType()),
     T.StructField("amount", T.DoubleType()), T.StructField("event_time", T.StringType()),
     T.StructField("hour", T.IntegerType()), T.StructField("device_risk", T.DoubleType()),
     T.StructField("location_risk", T.DoubleType()), T.StructField("txn_velocity", T.DoubleType()),
     T.StructField("edge_fraud_probability", T.DoubleType()), T.StructField("status", T.StringType())])


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of a location on any Hadoop file system."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hpath = hadoop_path(spark, path)
    return bool(fs.exists(hpath))


def has_files(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds a data file (names that start with _ or . are none)."""
    fs, hpath = hadoop_path(spark, path)
    return any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(hpath))


POINTER = "_current"


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder of the version that is published under ``path``, if any."""
    fs, pointer = hadoop_path(spark, f"{path.rstrip('/')}/{POINTER}")
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return f"{path.rstrip('/')}/{spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, 'UTF-8').strip()}"
    finally:
        stream.close()


def read_published(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A published table (see ``sinks.publish``) or a plain one at ``path``."""
    return spark.read.format(fmt).load(current_version(spark, path) or path)


#: How every CSV of the feed is written and read, in batch and in streams
#: (RFC 4180 quoting).  With ``enforceSchema`` off each file's header is checked
#: against the schema, so a file whose columns stand in another order than the
#: first one's stops the job instead of swapping values.
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "inferSchema": "false", "enforceSchema": "false"}


def header_schema(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> T.StructType:
    """``schema`` in the order of the files' own header (columns it does not name
    are text), so that columns are matched by name.  No job: the header line only."""
    names = spark.read.options(**CSV_OPTIONS).option("multiLine", multi_line).csv(path).columns
    missing = [f.name for f in schema.fields if f.name not in names]
    if missing:
        raise MissingColumnsError(missing)
    kinds = {f.name: f.dataType for f in schema.fields}
    return T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in names])


def read_csv_by_name(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    own = header_schema(spark, path, schema, multi_line)
    return spark.read.schema(own).options(**CSV_OPTIONS).option("multiLine", multi_line).csv(path)


def read_transactions(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame | None:
    """SRC1: the CSV feed with header; every column as text (no type inference).

    A missing path gives None (nothing to process).  Required columns are
    checked against the header at plan time (SRC2); extra columns are kept
    for the caller to drop.  ``multi_line`` allows line breaks inside quoted
    fields; such files cannot be split, each is one task.
    """
    if not path_exists(spark, path):
        return None
    return require_columns(read_csv_by_name(spark, path, RAW_SCHEMA, multi_line))


def stream_transactions(spark: SparkSession, input_dir: str, max_files_per_trigger: int | None = None,
                        multi_line: bool = False) -> DataFrame:
    """The feed as a stream of CSV files, read like the batch: columns by the
    header of what lies in the folder when the stream starts (the feed's own
    order while it is empty), required ones checked; ``multi_line`` as there."""
    schema = RAW_SCHEMA
    if path_exists(spark, input_dir) and has_files(spark, input_dir):
        schema = header_schema(spark, input_dir, RAW_SCHEMA, multi_line)
    reader = spark.readStream.schema(schema).options(**CSV_OPTIONS).option("multiLine", multi_line)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return require_columns(reader.csv(input_dir))


def read_features(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """SRC3: the feature table, typed (published or a stream's snapshot table, or CSV
    with the fixed schema)."""
    from txlens.sources.snapshots import is_snapshot_table, read_snapshot

    if fmt == "parquet" and is_snapshot_table(spark, path):
        return read_snapshot(spark, path, FEATURE_SCHEMA)
    if fmt == "parquet":
        return read_published(spark, path)
    return read_csv_by_name(spark, path, FEATURE_SCHEMA).select(*FEATURE_SCHEMA.names)


def read_card_dataset(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: card dataset CSV (Time, V1..V28, Amount, Class), columns by name."""
    return read_csv_by_name(spark, path, CARD_SCHEMA).select(*CARD_SCHEMA.names)


def read_ledger(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """SRC5: the relational ledger as three parquet tables under ``base``."""
    return {
        "users": spark.read.schema(USER_SCHEMA).parquet(f"{base}/users"),
        "profiles": spark.read.schema(PROFILE_SCHEMA).parquet(f"{base}/profiles"),
        "transactions": spark.read.schema(TRANSACTION_SCHEMA).parquet(f"{base}/transactions"),
    }
