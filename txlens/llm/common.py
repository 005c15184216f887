"""Small helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARROW_BATCH_BYTES = 16 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def col(name: str) -> Column:
    """The column of exactly that name (dots and blanks included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(col(name).cast("string"), F.lit(""))


def utf8(name: str = "text") -> Column:
    """The whole text as UTF-8 bytes; NULL counts as empty."""
    return text_or_empty(name).cast("binary")


def fresh(df: DataFrame, stem: str) -> str:
    """A working column name that ``df`` does not use."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name in taken:
        name += "_"
    return name


def holds_type(kind: T.DataType, names: tuple[str, ...]) -> bool:
    """Whether a type is, or has inside, one of these."""
    inside = ([f.dataType for f in kind.fields] if isinstance(kind, T.StructType)
              else [kind.elementType] if isinstance(kind, T.ArrayType)
              else [kind.keyType, kind.valueType] if isinstance(kind, T.MapType) else [])
    return kind.typeName() in names or any(holds_type(x, names) for x in inside)


def row_hash(df: DataFrame) -> Column:
    """64-bit hash over every column, NULL-ness included: equal rows have equal
    hashes, whatever task computes them.  Maps and variants, also inside other types,
    are hashed as JSON."""
    parts = []
    for f in df.schema.fields:
        if not holds_type(f.dataType, ("map", "variant")):
            parts += [col(f.name).isNull(), col(f.name)]
        else:
            whole = F.to_json(F.struct(col(f.name).alias("x")))
            parts += [col(f.name).isNull(), whole]
    return F.xxhash64(*parts) if parts else F.lit(0).cast("long")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches to Python are bounded in bytes, so that very long texts do
    not meet in one batch by the ten thousand."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")


CHUNK = 4_096


def sum_vectors(rows: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], Iterable[np.ndarray]],
                size: int) -> np.ndarray:
    """The sum of the vectors (``size`` doubles each) that ``partial`` yields on
    every partition.  They are added on the executors, in chunks, so no task
    gets more than one chunk per partition at a time and the driver one vector."""
    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v in partial(batches):
            full = [i for i in range(0, size, CHUNK) if v[i:i + CHUNK].any()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int64()), pa.array([v[i:i + CHUNK] for i in full], pa.list_(pa.float64()))],
                names=["i", "v"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1)):
                v = v.values.to_numpy()
                total[i] = total[i] + v if i in total else v
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.list_(pa.float64()))],
            names=["i", "v"])

    kind = "i long, v array<double>"
    out = np.zeros(size)
    for r in rows.mapInArrow(chunked, kind).repartition("i").mapInArrow(merged, kind).collect():
        out[r.i:r.i + len(r.v)] += r.v
    return out
