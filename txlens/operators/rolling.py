"""Trailing time-range features per key (WIN1-WIN5, WIN8).

Semantics: for every row, aggregate the rows of the same key whose order
value lies in ``[t - seconds, t]`` -- both ends inclusive, rows with the same
``t`` included (a RANGE frame).  Rows with a NULL order value form one group
per key and see only each other.

Two exact strategies, chosen by the caller and never by the data:

``window``
    One exchange, one sort and one Window node, no join.  Time is cut into cells
    as long as the longest frame; a row counts in its own cell and, as a carried
    row (time and values only), in the next one, which its frame may reach.
    Inside a (key, cell) every row adds its values at ``t`` and an *expiry* row
    subtracts them at ``t + L + 1`` if that lies in a cell where it counts; the
    frame value is the running total.  Linear in the rows (Spark's own sliding
    RANGE frame adds up the whole frame anew for every row), and a task holds
    one key's cell and the one before it.  Rows without a time stay together by
    key; prefer ``sweep`` where one key has very many of those, or most of the
    rows of a day.

``sweep`` (default)
    Every row adds its values at ``t`` and an *expiry* row subtracts them at
    ``t + L + 1``.  The frame value at ``t`` is then the running total of all
    additions and expiries up to ``t`` -- peers at ``t`` included, exactly the
    RANGE frame.  The running total is split into (key, time cell) pieces:
    a running sum inside each cell (a window over ``(key, cell)``), plus the
    cell's offset, which is the exclusive prefix of the per-cell totals (a
    small aggregate over ``(key, cell)`` with a window over ``key``; one row
    per cell, not per event).  No task ever holds more than one key's cell,
    however hot the key is, and no rows are replicated across cells.
    Integer values are summed as longs; a double is split into its integer
    part (summed exactly as a long) and its fraction (summed as a double), so
    adding and expiring a value cancels to within a few ulps of the frame's
    row count, in plain codegen arithmetic instead of wide decimals.  NaN and
    infinities are counted apart and give what a plain window sum gives.
    The cell totals are partially aggregated before their shuffle (one row
    per key and cell per task); their branch re-reads the input with only the
    key, time and value columns.
    Rows without a time all see the same frame: the total of their key's.  They are
    dealt over a few cells of their own, not gathered by key.
    Running sums and offsets share one partitioning by (key, cell), so a row is
    exchanged once; expiry rows carry the key, the time and their values only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txlens.constants import WINDOW_10M_SECONDS, WINDOW_24H_SECONDS


@dataclass(frozen=True)
class RollingSpec:
    name: str       # output column
    fn: str         # 'sum' | 'count' | 'avg'
    column: str     # input column
    seconds: int    # frame length: [t - seconds, t]


FEATURE_SPECS = [
    RollingSpec("rolling_total_spend_24h", "sum", "amount", WINDOW_24H_SECONDS),
    RollingSpec("rolling_txn_count_24h", "count", "transaction_id", WINDOW_24H_SECONDS),
    RollingSpec("rolling_avg_amount_24h", "avg", "amount", WINDOW_24H_SECONDS),
    RollingSpec("rolling_blocked_count_24h", "sum", "is_blocked", WINDOW_24H_SECONDS),
    RollingSpec("rolling_txn_count_10m", "count", "transaction_id", WINDOW_10M_SECONDS),
]

DEFAULT_CELL_SECONDS = 3600
UNTIMED_CELLS = 64


def rolling_features(df: DataFrame, specs=FEATURE_SPECS, key: str = "user_id",
                     order: str = "event_unix", strategy: str = "sweep",
                     cell_seconds: int = DEFAULT_CELL_SECONDS) -> DataFrame:
    """Add one column per spec.  ``order`` must be a whole-number column (seconds)."""
    for s in specs:
        if s.fn not in ("sum", "count", "avg"):
            raise ValueError(f"unsupported rolling function {s.fn!r}")
    if strategy == "window":
        return _by_window(df, specs, key, order)
    if strategy == "sweep":
        return _by_sweep(df, specs, key, order, cell_seconds)
    raise ValueError(f"unknown strategy {strategy!r}")


def _integral(dtype) -> bool:
    return isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


# Largest magnitude split exactly into integer and fraction (2^53: every double
# below it has an exact integer part and an exact fraction).
EXACT_SPLIT_LIMIT = float(2 ** 53)

# Delta kinds per measure: 'n' non-NULL count; 's' integral sum; for doubles
# 'h' integer parts (long, exact), 'f' fractions in [0, 1) (double; larger
# than the split limit the whole value), and counts of NaN / +Inf / -Inf.
_DOUBLE_KINDS = ("h", "f", "nan", "pinf", "ninf")


def _kinds(fn: str, dtype: T.DataType) -> tuple[str, ...]:
    if fn == "count":
        return ("n",)
    return (("s",) if _integral(dtype) else _DOUBLE_KINDS) + ("n",)


def _value_of(column: str, kind: str, integral: bool) -> F.Column:
    c = F.col(column)
    if kind == "n":
        return F.when(c.isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("long")
    if kind == "s":
        return F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    x = c.cast("double")
    inf = F.lit(float("inf"))
    if kind == "nan":
        return F.when(F.isnan(x), F.lit(1)).otherwise(F.lit(0)).cast("long")
    if kind == "pinf":
        return F.when(x == inf, F.lit(1)).otherwise(F.lit(0)).cast("long")
    if kind == "ninf":
        return F.when(x == -inf, F.lit(1)).otherwise(F.lit(0)).cast("long")
    splittable = F.abs(x) < F.lit(EXACT_SPLIT_LIMIT)   # false for NULL, NaN, +-Inf
    if kind == "h":
        return F.when(splittable, F.floor(x)).otherwise(F.lit(0)).cast("long")
    if kind == "f":
        big = (F.abs(x) >= F.lit(EXACT_SPLIT_LIMIT)) & (F.abs(x) < inf)
        return (F.when(splittable, x - F.floor(x).cast("double"))
                .when(big, x).otherwise(F.lit(0.0)).cast("double"))
    raise ValueError(kind)


def _zero(kind: str) -> F.Column:
    return F.lit(0.0).cast("double") if kind == "f" else F.lit(0).cast("long")


def _kinds_exact(fn: str, dtype: T.DataType) -> tuple[str, ...]:
    """Decimals stay decimals (kind 'x')."""
    return ("x", "n") if fn != "count" and isinstance(dtype, T.DecimalType) else _kinds(fn, dtype)


def _measures(specs, types, kinds=_kinds) -> list[tuple[str, int, str]]:
    """(column, length, kind) of every running total that the specs need."""
    return list(dict.fromkeys((s.column, s.seconds, kind) for s in specs for kind in kinds(s.fn, types[s.column])))


def _outputs(specs, types, totals: dict, kinds=_kinds) -> list[F.Column]:
    """The specs' columns from the frame totals by measure."""
    inf = F.lit(float("inf"))

    def frame_sum(s):
        tot = {kind: totals[(s.column, s.seconds, kind)] for kind in kinds(s.fn, types[s.column])}
        if "s" in tot or "x" in tot:
            return tot["s"] if "s" in tot else tot["x"]
        return (F.when((tot["nan"] > 0) | ((tot["pinf"] > 0) & (tot["ninf"] > 0)), F.lit(float("nan")))
                .when(tot["pinf"] > 0, inf).when(tot["ninf"] > 0, -inf)
                .otherwise(tot["h"].cast("double") + tot["f"]))

    outs = []
    for s in specs:
        n = totals[(s.column, s.seconds, "n")]
        if s.fn == "count":
            outs.append(n.alias(s.name))
        elif s.fn == "sum":
            outs.append(F.when(n > 0, frame_sum(s)).alias(s.name))
        elif "x" in kinds(s.fn, types[s.column]):  # avg, of the type that Spark gives it
            mean = T.DecimalType(*[min(v + 4, 38) for v in (types[s.column].precision, types[s.column].scale)])
            outs.append(F.when(n > 0, (frame_sum(s) / n.cast("decimal(20,0)")).cast(mean)).alias(s.name))
        else:  # avg
            outs.append(F.when(n > 0, frame_sum(s).cast("double") / n.cast("double")).alias(s.name))
    return outs


def _by_window(df, specs, key, order):
    types = {f.name: f.dataType for f in df.schema.fields}
    lengths = sorted({s.seconds for s in specs})
    measures = _measures(specs, types, _kinds_exact)
    mname = {m: f"__d{i}" for i, m in enumerate(measures)}
    t = F.col("__t0")
    size = max([*lengths, 1])          # a frame reaches into one earlier cell at most

    def cell(at):                      # its first second
        return at - F.pmod(at, F.lit(size))

    # What a row becomes: itself (kind 0); carried into the next cell, where its
    # frames end there (kind 1); its expiries (kind 2 + i, one per frame length) in
    # the last cell where it counts, unless the next cell begins with them.
    own = cell(t)
    entries = [F.struct(F.lit(0).alias("kind"), own.alias("cell"), t.alias("at")),
               F.when(cell(t + size) > own, F.struct(F.lit(1).alias("kind"), (own + size).alias("cell"), t.alias("at")))]
    for i, length in enumerate(lengths):
        last = cell(t + length)
        entries.append(F.when(cell(t + length + 1) == last, F.struct(
            F.lit(2 + i).alias("kind"), last.alias("cell"), (t + length + 1).alias("at"))))
    base = (df.select("*", F.col(order).cast("long").alias("__t0"))
            .select("*", F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("__e")))
    kind = F.col("__e.kind")

    def delta(m):
        column, length, what = m
        none = F.lit(0).cast(types[column]) if what == "x" else _zero(what)
        v = F.coalesce(F.col(column), none) if what == "x" else _value_of(column, what, _integral(types[column]))
        return (F.when((kind == 0) | ((kind == 1) & (cell(t + length) > own)), v)
                .when(kind == 2 + lengths.index(length), -v).otherwise(none))

    events = base.select(
        F.when(kind == 0, F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("__row"),
        F.col(key).alias("__key"), F.col("__e.cell").alias("__cell"), F.col("__e.at").alias("__t"),
        *[delta(m).alias(mname[m]) for m in measures])
    running = Window.partitionBy("__key", "__cell").orderBy("__t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    totals = {m: F.col(f"{mname[m]}r") for m in measures}
    return (events.select("__row", *[F.sum(mname[m]).over(running).alias(f"{mname[m]}r") for m in measures])
            .filter(F.col("__row").isNotNull())
            .select(*[F.col(f"__row.`{c}`").alias(c) for c in df.columns], *_outputs(specs, types, totals, _kinds_exact)))


def _by_sweep(df, specs, key, order, cell_seconds):
    types = {f.name: f.dataType for f in df.schema.fields}
    lengths = sorted({s.seconds for s in specs})

    # Measures: (column, length, kind); each gets one delta column.  Sums of
    # doubles are carried exactly: integer parts add up as longs and only the
    # fractions (magnitude below the frame's row count) go through double
    # arithmetic, so adding a value and later expiring it cancels to within
    # a few ulps of the frame's row count -- not of the running total.
    measures = _measures(specs, types)
    mname = {m: f"__d{i}" for i, m in enumerate(measures)}
    mkind = {mname[m]: m[2] for m in measures}

    # One pass: every row becomes itself (kind 0) plus one expiry row per frame
    # length (kind i at t + L_i + 1).  Expiry rows carry only key, time and
    # deltas; their other columns are NULL.
    kinds = list(range(len(lengths) + 1))
    shift = F.lit(0).cast("long")
    for i, length in enumerate(lengths, start=1):
        shift = F.when(F.col("__kind") == i, F.lit(length + 1).cast("long")).otherwise(shift)
    base = df.select("*", F.col(order).cast("long").alias("__t0"),
                     F.explode(F.array(*[F.lit(k) for k in kinds])).alias("__kind"))
    base = base.filter((F.col("__kind") == 0) | F.col("__t0").isNotNull())

    def delta(m):
        column, length, kind = m
        v = _value_of(column, kind, _integral(types[column]))
        k_exp = lengths.index(length) + 1
        return (F.when(F.col("__kind") == 0, v)
                .when(F.col("__kind") == k_exp, -v)
                .otherwise(_zero(kind)))

    # The row itself travels as one struct, NULL in expiry rows, and the key without
    # NULLs (text and a flag): running sums and offsets then meet in one partitioning.
    events = base.select(
        F.when(F.col("__kind") == 0, F.struct(*[F.col(c) for c in df.columns])).alias("__row"),
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("__key"), F.col(key).isNull().alias("__nokey"),
        (F.col("__t0") + shift).alias("__t"),
        "__kind",
        *[delta(m).alias(mname[m]) for m in measures],
        # rows without a time need no order: they are dealt over a few cells of their own
        F.pmod(F.xxhash64(*dict.fromkeys(m[0] for m in measures)), F.lit(UNTIMED_CELLS)).alias("__deal"),
    )
    untimed = F.col("__t").isNull()
    events = events.withColumn("__cell", F.when(untimed, F.lit(-(1 << 60)) - F.col("__deal")).otherwise(
        F.floor(F.col("__t") / F.lit(cell_seconds))).cast("long")).drop("__deal")
    own = ["__key", "__nokey", "__cell"]
    delta_cols = [mname[m] for m in measures]

    # Offset of each cell = sum of all deltas in earlier cells of the key; of an
    # untimed cell = the sum over all untimed cells of the key.
    cell_tot = (events.withColumn("__untimed", untimed).groupBy(*own, "__untimed")
                .agg(*[F.sum(d).alias(d) for d in delta_cols]))
    of_key = Window.partitionBy("__key", "__nokey", "__untimed")
    prior = of_key.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cell_tot.select(
        *own, *[F.when(F.col("__untimed"), F.sum(d).over(of_key)).otherwise(F.sum(d).over(prior)).alias(f"{d}o")
                for d in delta_cols])

    running = Window.partitionBy(*own).orderBy("__t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    within = events.select(
        "*", *[F.sum(d).over(running).alias(f"{d}r") for d in delta_cols]
    ).filter(F.col("__kind") == 0)
    joined = within.join(offsets, own, "left").select("*", *[F.col(f"__row.`{c}`").alias(c) for c in df.columns])

    totals = {m: F.when(untimed, _zero(mkind[d])).otherwise(F.col(f"{d}r"))
              + F.coalesce(F.col(f"{d}o"), _zero(mkind[d])) for m, d in mname.items()}
    return joined.select(*[F.col(c) for c in df.columns], *_outputs(specs, types, totals))
