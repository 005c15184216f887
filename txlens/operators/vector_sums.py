"""Sums of vectors over all partitions, the one aggregate that iterative fits need,
and the rows of such a fit packed once into blocks that every pass reads."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sum_vectors(rows: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], Iterable[np.ndarray]],
                size: int) -> np.ndarray:
    """The sum of the vectors of ``size`` doubles that ``partial`` yields on every
    partition.  Their entries are added by the JVM, partially before the shuffle;
    the driver gets ``size`` numbers, whatever the number of partitions."""
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v in partial(batches):
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(v[at])], names=["i", "v"])

    out = np.zeros(size)
    for r in rows.mapInArrow(entries, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r.i] = r.v
    return out


def matrix(batch: pa.RecordBatch, first: int, last: int) -> np.ndarray:
    """Columns ``first`` to before ``last`` of a batch as rows of doubles."""
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype("float64") for i in range(first, last)])


BLOCK_ROWS = 65_536     # rows a block at most holds
STEP_ROWS = 8_192       # rows a pass computes with at once, so that its arrays stay in the cache


def row_blocks(rows: DataFrame, width: int, parts: int = 1, required: tuple[int, ...] = ()) -> DataFrame:
    """(part, block): the first ``width`` columns of ``rows`` as blocks of doubles, row
    after row; with ``parts`` above 1 the next column, an int from 0, deals them.

    A pass then moves a few large values, not every row's fields, and a filter on
    ``part`` skips the stored batches of the others.  A task packs its own rows and
    holds one open block per part.  A long column keeps its bits (:func:`longs`); a
    NULL becomes NaN, in a column of ``required`` it is an error."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = [[] for _ in range(parts)]
        held = [0] * parts

        def block(part: int) -> pa.RecordBatch:
            data = np.concatenate(waiting[part]).tobytes()
            waiting[part], held[part] = [], 0
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([data], pa.binary())],
                                              names=["part", "block"])

        for b in batches:
            for at in range(0, b.num_rows, STEP_ROWS):
                step = b.slice(at, STEP_ROWS)
                if any(step.column(i).null_count for i in required):
                    raise ValueError("NULL in a label, weight or hash column")
                cols = [step.column(i).to_numpy(zero_copy_only=False) for i in range(width)]
                x = np.column_stack([c.view("float64") if c.dtype == np.int64 else c.astype("float64") for c in cols])
                part_of = step.column(width).to_numpy() if parts > 1 else None
                for part in range(parts):
                    mine = x if part_of is None else x[part_of == part]
                    if len(mine):
                        waiting[part].append(mine)
                        held[part] += len(mine)
                        if held[part] > BLOCK_ROWS - STEP_ROWS:
                            yield block(part)
        for part in range(parts):
            if held[part]:
                yield block(part)

    return rows.mapInArrow(pack, "part int, block binary")


def block_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    """The rows of :func:`row_blocks` batches, ``STEP_ROWS`` at a time."""
    for b in batches:
        for value in b.column(b.schema.get_field_index("block")):
            rows = np.frombuffer(value.as_buffer(), dtype="float64").reshape(-1, width)
            for at in range(0, len(rows), STEP_ROWS):
                yield rows[at:at + STEP_ROWS]


def longs(column: np.ndarray) -> np.ndarray:
    """A packed long column again as longs."""
    return np.ascontiguousarray(column).view("int64")
