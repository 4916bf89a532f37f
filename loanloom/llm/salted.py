"""Groups that may hold a third of all rows: combined per salt first, then over the salts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pieces a group is cut into; the salts present in a group fit one BIGINT as bits.
SALTS = 64


def salt_of(*columns: Column) -> Column:
    """A salt fixed by the row, so that a repeated task deals it out alike."""
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def combine(rows: DataFrame, keys: list[str], rank: Column) -> DataFrame:
    """keys, _rank (the largest), _n rows and _salts of each group of `rows`, which carry `_salt`.

    Equal rows meet first inside each task (the partial aggregate), then per key and salt, then per key.
    """
    by_salt = rows.groupBy(*keys, "_salt").agg(F.max(rank).alias("_rank"), F.count(F.lit(1)).alias("_n"))
    bit = F.expr("shiftleft(CAST(1 AS BIGINT), _salt)")
    return by_salt.groupBy(*keys).agg(
        F.max("_rank").alias("_rank"), F.sum("_n").alias("_n"), F.bit_or(bit).alias("_salts"))


def per_salt(groups: DataFrame) -> DataFrame:
    """One row for each salt that a group has, to be joined with its rows on key and salt."""
    salts = F.expr(f"filter(sequence(0, {SALTS - 1}), s -> getbit(_salts, s) = 1)")
    return groups.withColumn("_salt", F.explode(salts)).drop("_salts")
