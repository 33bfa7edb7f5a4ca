"""Portable randomness: the same uniform draw in Spark, DuckDB or any engine that has md5."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: largest value of the first eight hex digits of md5
TOP = 4294967295.0


def uniform(tag: str, *keys: Column) -> Column:
    """A draw from the closed interval [0, 1] that depends on the tag and the keys only, never on partitioning."""
    text = F.concat_ws(":", F.lit(tag), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(TOP)


def uniform_sql(tag: str, *keys: str) -> str:
    """DuckDB text of `uniform`."""
    parts = " || ':' || ".join([f"'{tag}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"(CAST(('0x' || substr(md5({parts}), 1, 8)) AS BIGINT) / CAST({TOP} AS DOUBLE))"
