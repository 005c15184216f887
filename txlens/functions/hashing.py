"""Deterministic, engine-portable pseudo-random numbers.

Sampling and city assignment must not depend on partitioning or task order,
and the DuckDB oracle has to reproduce them.  Both engines implement MD5, so a
draw is the first 15 hex digits (60 bits, always positive) of
``md5(seed || ':' || key)`` read as a bigint.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_bigint(*parts) -> Column:
    """60-bit non-negative integer from the MD5 of the ':'-joined parts."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws(":", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def md5_bigint_sql(*parts: str) -> str:
    """DuckDB text of :func:`md5_bigint`; parts are SQL expressions."""
    text = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(('0x' || substr(md5({text}), 1, 15)) AS BIGINT)"


def uniform_index(n, *parts) -> Column:
    """Index in [0, n) drawn from the parts; ``n`` may be a column."""
    n_col = n if isinstance(n, Column) else F.lit(n)
    return F.pmod(md5_bigint(*parts), n_col.cast("bigint"))
