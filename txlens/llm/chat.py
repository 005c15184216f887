"""Chat formatting by perspective rotation.

For every participant of a conversation the whole dialogue is rendered with
that speaker as the assistant and all others as named users; messages of a
context role (``system``) are rendered as such and rotate with nobody.  The
mask lists the character spans to train on: the assistant's words and the end
marker after them.

A conversation may hold a third of all messages, so none is gathered whole.
Messages get a place by a distributed numbering of (conversation, turn, ties by
speaker and text); a perspective is rendered in parts of ``PART`` messages, and
offsets run inside a part.  Participants reach the messages by a join.

Defined results: a NULL text is an empty message; a NULL or empty speaker is
called ``unknown``; NULL turns come first; NULL conversation ids are one
conversation; repeated rows are repeated messages; markers inside texts and
names are broken up, so that they cannot end a message; a conversation of
context messages only has no perspective; other columns are not used; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txlens.llm.common import col
from txlens.operators.ordering import global_position

PART = 256
CONTEXT_ROLES = ("system",)


def _harmless(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def messages(table: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role",
             text: str = "text") -> DataFrame:
    """(conv_id, speaker, text, pos): pos counts from 0 in each conversation."""
    name = F.trim(F.translate(_harmless(F.coalesce(col(speaker).cast("string"), F.lit(""))), "\n\r", "  "))
    own = table.select(col(conv).alias("conv_id"), col(turn).alias("turn"),
                       F.when(name == "", "unknown").otherwise(name).alias("speaker"),
                       _harmless(F.coalesce(col(text).cast("string"), F.lit(""))).alias("text"))
    placed = global_position(own, [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(),
                                   "speaker", "text"], "place")
    first = placed.groupBy("conv_id").agg(F.min("place").alias("first"))
    return (placed.alias("m").join(first.alias("f"), F.col("m.conv_id").eqNullSafe(F.col("f.conv_id")))
            .select("m.conv_id", "speaker", "text", (F.col("place") - F.col("first")).alias("pos")))


def rotate(table: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text",
           context_roles: tuple[str, ...] = CONTEXT_ROLES, part: int = PART) -> DataFrame:
    """One row per conversation, perspective and part: conv_id, perspective, part,
    n_messages, n_trained, text and mask (array of start and end characters)."""
    said = messages(table, conv, turn, speaker, text)
    context = F.col("speaker").isin(*context_roles) if context_roles else F.lit(False)
    views = said.filter(~context).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    both = said.alias("m").join(views.alias("v"), F.col("m.conv_id").eqNullSafe(F.col("v.conv_id")))
    mine = F.col("speaker") == F.col("perspective")
    head = (F.when(context, F.concat(F.lit("<|"), F.col("speaker"), F.lit("|>\n")))
            .when(mine, F.lit("<|assistant|>\n"))
            .otherwise(F.concat(F.lit("<|user:"), F.col("speaker"), F.lit("|>\n"))))
    body = F.concat("text", F.lit("<|end|>"))
    in_part = Window.partitionBy("conv_id", "perspective", "part").orderBy("pos")
    before = F.coalesce(F.sum("chars").over(in_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = (both.select("m.conv_id", "perspective", "pos", F.floor(F.col("pos") / part).cast("long").alias("part"),
                          F.concat(head, body, F.lit("\n")).alias("piece"), F.length(head).alias("head"), mine.alias("mine"))
              .withColumn("chars", F.length("piece"))
              .withColumn("start", (before + F.col("head")).cast("long"))
              .withColumn("end", F.col("start") + F.col("chars") - F.col("head") - 1))
    span = F.when(F.col("mine"), F.struct("start", "end"))
    return (pieces.groupBy("conv_id", "perspective", "part")
            .agg(F.count(F.lit(1)).alias("n_messages"), F.count_if("mine").alias("n_trained"),
                 F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("p"),
                 F.array_sort(F.collect_list(span)).alias("mask"))
            .select("conv_id", "perspective", "part", "n_messages", "n_trained",
                    F.array_join("p.piece", "").alias("text"), "mask"))
