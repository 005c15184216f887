"""Exact dedup with a heavy-hitter split (DataFrame functions only).

Texts are equal when identical after every run of blanks ``[ \\t-\\r]`` became
one space; they are compared by the SHA-256 of that form.

1. One narrow pass stores (doc_id, digest).
2. ``freqItems`` keeps a Misra-Gries summary per task and merges them: at most
   ``1 / support`` digests, among them every one with more than ``support`` of
   all rows.
3. The candidates are counted exactly; the verified ones (at most
   ``1 / support`` rows, whatever the input) are broadcast with their winner,
   so a group of copies that holds a third of all rows is settled map-side and
   never meets in one task.
4. The remaining digests are aggregated and joined back by ordinary shuffles.

Defined results: NULL text counts as empty; a NULL id never wins over a real
one; rows that repeat an id and a text share their fate; an empty table gives
an empty result; other columns play no part and pass through ``deduplicate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txlens.llm.common import col, fresh, holds_type, row_hash, text_or_empty
from txlens.session import materialize

BLANKS = r"[\x20\x09-\x0D]+"
SUPPORT = 1 / 1024


def digest(text: str = "text") -> Column:
    """Lowercase hex SHA-256 of the normalised text."""
    return F.sha2(F.regexp_replace(text_or_empty(text), BLANKS, " "), 256)


def heavy_winners(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(digest, keep_id, group_size) of the digests that hold more than
    ``support`` of ``rows``: Misra-Gries candidates, then exact counts."""
    found = rows.freqItems(["digest"], support).first()[0] or []
    total = rows.count()
    return (rows.filter(F.col("digest").isin(list(found)) if found else F.lit(False))
            .groupBy("digest")
            .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
            .filter(F.col("group_size") > total * support))


def assign(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``rows`` (doc_id, digest) with keep_id, group_size and kept."""
    winners = F.broadcast(heavy_winners(rows, support))
    light = rows.join(winners.select("digest"), "digest", "left_anti")
    groups = light.groupBy("digest").agg(F.min("doc_id").alias("keep_id"),
                                         F.count(F.lit(1)).alias("group_size"))
    both = rows.join(winners, "digest").unionByName(light.join(groups, "digest"))
    return both.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def dedup_assignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      support: float = SUPPORT) -> DataFrame:
    """One row per document: doc_id, digest, keep_id, group_size, kept."""
    rows = materialize(docs.select(col(id_col).alias("doc_id"), digest(text_col).alias("digest")))
    return assign(rows, support)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, one per text, with all their columns.

    Among rows of the smallest id the one with the smallest row hash stays; of
    rows equal in every column one stays.  The heavy groups are cut map-side
    before the texts are shuffled: of them only the winner's row goes on.
    """
    dg, rh, seen = fresh(docs, "digest"), fresh(docs, "row_hash"), fresh(docs, "rank")
    tagged = docs.select("*", digest(text_col).alias(dg), row_hash(docs).alias(rh))
    keys = materialize(tagged.select(col(id_col).alias("doc_id"), F.col(dg).alias("digest"),
                                     F.col(rh).alias("row_hash")))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_hash"))

    def best(rows: DataFrame) -> DataFrame:
        return (rows.groupBy("digest").agg(F.min(order).alias("best"))
                .select(F.col("digest").alias(dg), F.col("best.row_hash").alias(rh)))

    heavy = F.broadcast(heavy_winners(keys, support).select("digest"))
    winners = F.broadcast(materialize(best(keys.join(heavy, "digest"))))
    light = tagged.join(winners.select(dg), dg, "left_anti")
    keys = keys.join(winners.select(F.col(dg).alias("digest")), "digest", "left_anti")
    kept = light.join(best(keys), [dg, rh], "left_semi")
    hashable = [c for c, t in zip(docs.columns, docs.schema.fields)
                if not holds_type(t.dataType, ("map", "variant"))]
    copies = (keys.groupBy("digest", "row_hash").agg(F.count(F.lit(1)).alias(seen))
              .filter(F.col(seen) > 1)
              .select(F.col("digest").alias(dg), F.col("row_hash").alias(rh)))
    single = kept.join(copies, [dg, rh], "left_anti")
    repeated = kept.join(copies, [dg, rh], "left_semi").dropDuplicates([*hashable, dg, rh])
    # equal rows of a heavy winner meet in the map-side half of the aggregate
    hot = tagged.join(winners, [dg, rh], "left_semi").dropDuplicates([*hashable, dg, rh])
    return single.unionByName(repeated).unionByName(hot).select(*[col(c) for c in docs.columns])
