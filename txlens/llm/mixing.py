"""Mixing sources to target weights by temperature (DataFrame functions only).

With token shares p, a source's weight is p^a / sum(p^a).  The exponent a is
bisected (``SECTIONS`` probes a round, all evaluated by one aggregate over the
per-source table) until the weights meet a target entropy or the most repeated
source meets a repetition limit.

The weights are realised as budgets in tokens.  The budget in all is given, or
by default the smallest at which every source is used at least once, so that
mixing drops no document.  A source with budget ``b`` and ``t`` tokens is taken
``b // t`` times whole; the rest comes from the head of one more epoch, in
which the source's blocks of documents are permuted: whole blocks up to the
one that crosses the budget, then that block's documents in permuted order.

No source is ever gathered: cumulative sums run over blocks (about
``BLOCK_ROWS`` documents each) and over the documents of one block per source.
A document's copies follow from its own hashes and two cut values of its
source; that table (a row per source) is broadcast only if it has at most
``MAX_BROADCAST_SOURCES`` rows, else joined plainly.  The texts are never
shuffled.

Defined results: a NULL source is a source; NULL text has no tokens; a source
without tokens is taken once with weight 0; rows with equal id and text share
their fate; an empty table gives an empty result; columns ``epoch``,
``block`` and ``mix_order`` of the input are replaced.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txlens.functions.hashing import md5_bigint
from txlens.llm.common import col, fresh, text_or_empty
from txlens.session import materialize

SECTIONS, ROUNDS = 32, 6
MAX_REPEATS = 2.0
BLOCK_ROWS = 1024
MAX_BROADCAST_SOURCES = 50_000
SEED = 7
WORD = r"[^\x20\x09-\x0D]+"


def n_tokens(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def shares(rows: DataFrame) -> DataFrame:
    """(source, tokens, n_docs, p) from (source, tokens) rows."""
    by_source = rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))
    total = by_source.agg(F.sum("tokens")).first()[0] or 0
    return by_source.withColumn("p", F.when(F.col("tokens") > 0, F.col("tokens") / F.lit(float(total))))


def _measure(table: DataFrame, exponents: list[float], budget: float | None, total: float) -> list[tuple[float, float]]:
    """(entropy, largest repetition) of the weights at each exponent."""
    aggs = []
    for i, a in enumerate(exponents):
        power = F.pow("p", F.lit(a))
        aggs += [F.sum(power).alias(f"z{i}"), F.sum(power * F.log("p")).alias(f"l{i}"),
                 F.max(F.pow("p", F.lit(a - 1))).alias(f"r{i}"), F.max(F.pow("p", F.lit(1 - a))).alias(f"c{i}")]
    row = table.agg(*aggs).first()
    out = []
    for i, a in enumerate(exponents):
        z = row[f"z{i}"] or 1.0
        scale = (row[f"c{i}"] or 1.0) if budget is None else budget / total / z
        out.append((log(z) - a * (row[f"l{i}"] or 0.0) / z, (row[f"r{i}"] or 1.0) * scale))
    return out


def find_exponent(table: DataFrame, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None,
                  budget: float | None = None) -> float:
    """The exponent in [0, 1] nearest 0 that keeps the largest repetition within
    ``max_repeats`` or, if ``entropy`` (nats) is given, the one whose weights
    have that entropy.  1 (natural shares) if the limit cannot be met."""
    total = float(table.agg(F.sum("tokens")).first()[0] or 0)
    if total == 0:
        return 1.0

    def enough(h: float, reps: float) -> bool:
        return h <= entropy if entropy is not None else reps <= max_repeats

    if enough(*_measure(table, [0.0], budget, total)[0]):
        return 0.0
    lo, hi = 0.0, 1.0
    for _ in range(ROUNDS):
        probes = [lo + (hi - lo) * i / SECTIONS for i in range(1, SECTIONS)]
        good = [enough(*m) for m in _measure(table, probes, budget, total)]
        first = good.index(True) if True in good else len(probes)
        edges = [lo, *probes, hi]
        lo, hi = edges[first], edges[first + 1]
    return hi


def weights(table: DataFrame, exponent: float, budget: float | None = None) -> DataFrame:
    """``table`` with weight, budget (tokens, long), whole epochs and rest."""
    power = F.pow("p", F.lit(exponent))
    s = table.agg(F.sum(power).alias("z"), F.max(F.col("tokens") / power).alias("c")).first()
    z = s.z or 1.0
    each = F.lit(float(s.c or 0.0)) * power if budget is None else F.lit(float(budget)) * power / F.lit(z)
    tokens = F.coalesce(F.floor(each + 1e-6).cast("long"), F.lit(0).cast("long"))
    if budget is None:   # the scale takes every source at least once; rounding must not take a token off
        tokens = F.greatest(tokens, F.col("tokens"))
    got = (table.withColumn("weight", F.coalesce(power / F.lit(z), F.lit(0.0)))
           .withColumn("budget", tokens))
    whole = F.floor(F.col("budget") / F.greatest("tokens", F.lit(1))).cast("long")
    return (got.withColumn("whole", F.when(F.col("tokens") > 0, whole).otherwise(1))
            .withColumn("rest", F.col("budget") - F.when(F.col("tokens") > 0, whole * F.col("tokens")).otherwise(0))
            .withColumn("n_blocks", F.ceil(F.col("n_docs") / BLOCK_ROWS).cast("long")))


def _source_text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit("null"))


def _block(n_blocks: Column, doc_key: Column, seed: int) -> Column:
    return F.pmod(md5_bigint(seed, F.lit("block"), doc_key), n_blocks)


def _block_order(epoch: Column, source: Column, block: Column, seed: int) -> Column:
    return md5_bigint(seed, epoch, _source_text(source), block)


def _doc_order(epoch: Column, doc_key: Column, seed: int) -> Column:
    return md5_bigint(seed, F.lit("doc"), epoch, doc_key)


def _doc_key(id_col: str, text_col: str) -> Column:
    return F.md5(F.concat_ws(":", F.coalesce(col(id_col).cast("string"), F.lit("null")),
                             F.md5(text_or_empty(text_col).cast("binary"))))


def cuts(rows: DataFrame, table: DataFrame, seed: int = SEED) -> DataFrame:
    """``table`` with the two cut values of each source's partial epoch: blocks
    ordered before ``cut_block`` are taken whole, of that block the documents
    up to ``cut_doc``.  ``rows``: (source, tokens, doc_key)."""
    src = [F.col("a.source").eqNullSafe(F.col("b.source"))]
    small = _maybe_broadcast(table)
    in_block = (rows.alias("a").join(small.alias("b"), src)
                .select("a.source", "a.tokens", "a.doc_key", "b.whole", "b.rest",
                        _block(F.col("b.n_blocks"), F.col("a.doc_key"), seed).alias("block"))
                .withColumn("order", _block_order(F.col("whole"), F.col("source"), F.col("block"), seed)))
    blocks = in_block.groupBy("source", "order", "rest").agg(F.sum("tokens").alias("tokens"))
    run = Window.partitionBy("source").orderBy("order").rangeBetween(Window.unboundedPreceding, 0)
    crossing = (blocks.withColumn("upto", F.sum("tokens").over(run)).filter(F.col("upto") > F.col("rest"))
                .groupBy("source").agg(F.min(F.struct("order", "upto", "tokens")).alias("at"))
                .select("source", F.col("at.order").alias("cut_block"),
                        (F.col("at.upto") - F.col("at.tokens")).alias("before")))
    edge = (in_block.alias("a").join(_maybe_broadcast(crossing).alias("b"),
                                     [*src, F.col("a.order") == F.col("b.cut_block")])
            .select("a.source", "a.tokens", (F.col("a.rest") - F.col("b.before")).alias("left"),
                    _doc_order(F.col("a.whole"), F.col("a.doc_key"), seed).alias("order")))
    cut_doc = (edge.withColumn("upto", F.sum("tokens").over(run)).filter(F.col("upto") <= F.col("left"))
               .groupBy("source").agg(F.max("order").alias("cut_doc")))
    return (table.alias("t").join(crossing.alias("a"), F.col("t.source").eqNullSafe(F.col("a.source")), "left")
            .join(cut_doc.alias("b"), F.col("t.source").eqNullSafe(F.col("b.source")), "left")
            .select("t.*", "a.cut_block", F.coalesce("b.cut_doc", F.lit(-1)).cast("long").alias("cut_doc")))


def _maybe_broadcast(table: DataFrame) -> DataFrame:
    """Broadcast only a table of checked size; larger ones take a plain join."""
    return F.broadcast(table) if table.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES else table


def mix(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text",
        max_repeats: float | None = MAX_REPEATS, entropy: float | None = None, budget: float | None = None,
        seed: int = SEED) -> DataFrame:
    """``docs``, each as often as its source's budget takes it, with ``epoch``
    (from 0), ``block`` and ``mix_order``: sorting by (epoch, mix_order) lays
    the blocks of all sources in one permuted order."""
    docs = docs.drop("epoch", "block", "mix_order")
    key = fresh(docs, "doc_key")
    keyed = docs.withColumn(key, _doc_key(id_col, text_col))
    rows = materialize(keyed.select(col(source_col).cast("string").alias("source"),
                                    n_tokens(text_col).alias("tokens"), F.col(key).alias("doc_key")))
    table = materialize(shares(rows))
    table = materialize(weights(table, find_exponent(table, max_repeats, entropy, budget), budget))
    cut = _maybe_broadcast(materialize(cuts(rows, table, seed)))
    source = col(source_col).cast("string")
    own = "__cut_"
    while any(c.lower().startswith(own) for c in keyed.columns):
        own += "_"
    cut = cut.select(*[F.col(c).alias(f"{own}{c}") for c in cut.columns])
    at = keyed.join(cut, source.eqNullSafe(F.col(f"{own}source")))
    block = _block(F.col(f"{own}n_blocks"), F.col(key), seed)
    last = F.col(f"{own}whole")
    order = _block_order(last, F.col(f"{own}source"), F.col("block"), seed)
    head = (order < F.col(f"{own}cut_block")) | ((order == F.col(f"{own}cut_block")) & (
        _doc_order(last, F.col(key), seed) <= F.col(f"{own}cut_doc")))
    partial = (F.col(f"{own}rest") > 0) & F.coalesce(head, F.lit(False))
    copies = last + F.when(partial, 1).otherwise(0)
    return (at.withColumn("block", block).filter(copies > 0)
            .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
            .withColumn("mix_order", _block_order(F.col("epoch"), F.col(f"{own}source"), F.col("block"), seed))
            .select(*[col(c) for c in docs.columns], "epoch", "block", "mix_order"))
