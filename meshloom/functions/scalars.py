"""Scalar aggregates over vectors (idx, value)."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def signed_sum(value: Column) -> Column:
    """Sum of the entries; the L1 norm only where none is negative."""
    return F.coalesce(F.sum(value), F.lit(0.0))


def l1_norm(value: Column) -> Column:
    return F.coalesce(F.sum(F.abs(value)), F.lit(0.0))


def l2_norm(value: Column) -> Column:
    return F.sqrt(F.coalesce(F.sum(value * value), F.lit(0.0)))


def has_one(value: Column) -> Column:
    """Whether any entry is exactly 1.0; false for an empty vector."""
    return F.coalesce(F.bool_or(value == F.lit(1.0)), F.lit(False))


def l1_error(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row `error`: the L1 distance; an index that one side lacks counts as 0 there."""
    b = b.select("idx", F.col("value").alias("other"))
    gap = F.abs(F.coalesce("value", F.lit(0.0)) - F.coalesce("other", F.lit(0.0)))
    return a.join(b, "idx", "full").agg(F.coalesce(F.sum(gap), F.lit(0.0)).alias("error"))


def gcd(a: int, b: int) -> int:
    """Of grid dimensions; metadata, so on the driver."""
    return math.gcd(a, b)
