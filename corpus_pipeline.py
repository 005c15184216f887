"""The corpus pipeline: five operators of ``txlens.llm`` in a row.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's rows as Parquet to the shared folder and reads them back as the
next one's ``docs``.  All but the last stage return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txlens.llm import decontaminate, mixing, quality, sharding, simhash
from txlens.llm.common import read
from txlens.session import materialize

SHARDS = 40


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score >= 0.7); it learns
    from the labelled ones of this stage's input."""
    model = quality.fit_documents(docs, read(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that of the smallest id."""
    return simhash.keep_one(docs, shingle=4, max_distance=4)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.remove_documents(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; those of small sources up to twice."""
    return mixing.mix(docs, max_repeats=2.0).drop("epoch", "block", "mix_order")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard (near-equal bytes) and slot."""
    return sharding.shard_documents(docs, SHARDS)


STAGES = [
    ("quality classifier", keep_good_quality),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_text),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]

#: The classifier and the link components cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs.select("doc_id", "source", "n_chars", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
                       "shard", "slot")
