"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread_by: str, salts: int = SALTS) -> DataFrame:
    """Inner join where `small` has few rows per key: each is copied per salt and the big side is spread.

    A key owning a third of `big` then occupies `salts` shuffle groups instead of one. Whether the
    small side is broadcast instead is left to the optimizer's size check.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def join_spreading_nulls(big: DataFrame, small: DataFrame, key: str, spread_by: str, salts: int = 1024) -> DataFrame:
    """Left join on a key that most of `big` may lack: rows without one match nothing and spread over the tasks, instead of meeting in one."""
    own = F.pmod(F.xxhash64(key), F.lit(1))  # always 0, but no constant that the optimizer would take out of the join
    salt = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(spread_by), F.lit(salts)) + 1).otherwise(own)
    return big.withColumn("_salt", salt).join(small.withColumn("_salt", own), [key, "_salt"], "left").drop("_salt")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for expensive per-row work on an input of few splits; big inputs pass unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def in_pieces(df: DataFrame, column: str, chars: int = 8 << 20) -> DataFrame:
    """Partitions of about `chars` characters of `column` each, for steps whose memory grows with the text of a task."""
    whole = df.agg(F.sum(F.length(column))).first()[0] or 0
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(whole / chars)))


def join_in_groups(big: DataFrame, small: DataFrame, key: str, rows: int = 500_000) -> DataFrame:
    """Inner join on a key of few rows each, in tasks of about `rows` rows of `big`, however many shuffle partitions the session has.

    Both sides are placed: else the join takes the partitions of the side that has some already. Counts `big`.
    """
    n = max(big.sparkSession.sparkContext.defaultParallelism, math.ceil(big.count() / rows))
    return big.repartition(n, key).join(small.repartition(n, key), key)
