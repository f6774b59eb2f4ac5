"""Z-sets: rows with a signed multiplicity. Zero weights are kept until pruned."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

W = "weight"


def _keys(z: DataFrame) -> list[str]:
    return [c for c in z.columns if c != W]


def of(df: DataFrame, weight: int = 1) -> DataFrame:
    return df.groupBy(*df.columns).agg((F.count("*") * weight).alias(W))


def total(*zs: DataFrame) -> DataFrame:
    """Weights of equal rows summed; nulls are equal to each other."""
    own = reduce(DataFrame.unionByName, zs)
    return own.groupBy(*_keys(own)).agg(F.sum(W).alias(W))


def scaled(z: DataFrame, by: int) -> DataFrame:
    return z.withColumn(W, F.col(W) * by)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return total(a, scaled(b, -1))


def pruned(z: DataFrame) -> DataFrame:
    return z.where(F.col(W) != 0)


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """The Z-set that turns one bag of rows into another."""
    return pruned(difference(of(after), of(before)))


def expanded(z: DataFrame) -> DataFrame:
    """The bag of rows with positive weight."""
    return z.where(F.col(W) > 0).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col(W)))).drop(W, "_i")
