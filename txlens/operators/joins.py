"""Joins (JON1-JON5).

Only tables with a proven size bound are broadcast explicitly (the five-row
city table).  Everything else is a plain equi-join: AQE measures the
materialised sides at run time and switches to a broadcast when one really is
small, keeps a sort-merge join otherwise, and splits skewed partitions
(``spark.sql.adaptive.skewJoin.enabled``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txlens import constants as K
from txlens.functions.hashing import uniform_index


def block_blacklisted(txns: DataFrame, blacklist: DataFrame, user_col: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """JON1: (allowed, denied) by exact user id match against the blacklist.

    (The original searched the blacklist file for the id as a substring; an
    exact match is the intended rule.)
    """
    flagged = flag_blacklisted(txns, blacklist, user_col)
    return flagged.filter("NOT denied").drop("denied"), flagged.filter("denied").drop("denied")


def flag_blacklisted(txns: DataFrame, blacklist: DataFrame, user_col: str = "user_id") -> DataFrame:
    """JON1 in one pass: ``txns`` with the boolean ``denied``."""
    keys = blacklist.select(F.col("user_id").alias("__bl_user")).distinct()
    return (txns.join(keys, F.col(user_col) == F.col("__bl_user"), "left")
            .withColumn("denied", F.col("__bl_user").isNotNull()).drop("__bl_user"))


def with_profile(users: DataFrame, profiles: DataFrame) -> DataFrame:
    """JON2: each user with its profile; a missing profile reads as balance 0,
    income 0, appetite 'balanced'."""
    p = profiles.withColumnRenamed("user_id", "__p_user")
    j = users.join(p, users.id == p.__p_user, "left")
    return j.select(
        *[users[c] for c in users.columns],
        F.coalesce(F.col("account_balance"), F.lit(0).cast("decimal(14,2)")).alias("account_balance"),
        F.coalesce(F.col("monthly_income"), F.lit(0).cast("decimal(14,2)")).alias("monthly_income"),
        F.coalesce(F.col("risk_appetite"), F.lit(K.DEFAULT_RISK_APPETITE)).alias("risk_appetite"),
        F.col("__p_user").isNotNull().alias("has_profile"),
    )


def user_transactions(users: DataFrame, txns: DataFrame) -> DataFrame:
    """JON3: 1-n inner equi-join of users and their transactions."""
    return users.join(txns, users.id == txns.user_id, "inner").drop(txns.user_id)


def city_table(spark) -> DataFrame:
    rows = [(i, name, lat, lon) for i, (name, lat, lon) in enumerate(K.CITIES)]
    return spark.createDataFrame(rows, "city_idx int, city string, latitude double, longitude double")


def assign_city(df: DataFrame, key: str = "transaction_id", seed: int = K.RISK_SEED) -> DataFrame:
    """JON4: each row gets one of the five cities, drawn from ``md5(seed:key)``.

    Deterministic and independent of partitioning; the city table has five
    rows, so the broadcast is bounded.
    """
    cities = city_table(df.sparkSession)
    tagged = df.withColumn("__city_idx", uniform_index(len(K.CITIES), F.lit(seed), F.col(key)).cast("int"))
    return (tagged.join(F.broadcast(cities), tagged.__city_idx == cities.city_idx, "left")
            .drop("__city_idx", "city_idx"))


def orphans(txns: DataFrame, users: DataFrame) -> DataFrame:
    """JON5: transactions whose user does not exist (foreign-key check)."""
    return txns.join(users, txns.user_id == users.id, "left_anti")
