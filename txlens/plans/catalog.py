"""Registry of named queries and their DuckDB oracle text.

Every query takes ``(spark, sf_dir)``, reads whole driver tables and returns a
DataFrame.  Outputs avoid timestamp and decimal columns (they are exposed as
epoch seconds / doubles) and every double is rounded to 4 decimals, so the
oracle can compare values exactly; the oracle rounds the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
ROUND_DIGITS = 4


def round_doubles(df: DataFrame, digits: int = ROUND_DIGITS) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name), digits).cast("double").alias(f.name))
        elif isinstance(f.dataType, T.DecimalType):
            cols.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def register(name: str, sql: str | None = None, doubles: list[str] | None = None):
    """Register a query; ``doubles`` lists the oracle's double columns to round."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = oracle_text(sql, doubles or [])
        return fn
    return deco


def oracle_text(sql: str, doubles: list[str]) -> str:
    if not doubles:
        return sql.strip()
    repl = ", ".join(f"(round(CAST({c} AS DOUBLE), {ROUND_DIGITS}) + 0.0) AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({repl}) FROM (\n{sql.strip()}\n) AS q"


def load_all() -> None:
    """Import every catalog module (they register on import)."""
    from txlens.plans import (  # noqa: F401
        catalog_features, catalog_rules, catalog_reports, catalog_risk,
        catalog_ledger, catalog_ml, catalog_io, catalog_streaming,
    )
