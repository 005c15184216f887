"""Global statistics applied as constants.

A global aggregate (min/max, moments, a scaler, a metrics row) has exactly one
row, whatever the input size.  It is fitted with one distributed ``agg``
(partial aggregation on every task) and read back as that single row -- the
way Spark ML's scalers fit their summary statistics -- then applied to the
data as typed literals.  No join is needed to attach them, Catalyst folds the
constants, and the consuming scan stays one whole-stage-codegen span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_row(stats: DataFrame) -> dict:
    """The values of a one-row aggregate, by column name.

    Raises when the frame holds more than one row: only global aggregates
    (bounded by construction) may be read this way.
    """
    rows = stats.take(2)
    if len(rows) > 1:
        raise ValueError("expected a one-row aggregate")
    if not rows:
        return {f.name: None for f in stats.schema.fields}
    return rows[0].asDict()


def scalar_columns(stats: DataFrame) -> list[Column]:
    """Typed literal columns carrying the one row of ``stats``."""
    values = one_row(stats)
    return [F.lit(values[f.name]).cast(f.dataType).alias(f.name) for f in stats.schema.fields]


def with_scalars(df: DataFrame, stats: DataFrame) -> DataFrame:
    """``df`` with the columns of the one-row ``stats`` added as constants."""
    return df.select("*", *scalar_columns(stats))

