"""Joins of tables with lookup tables that have each key once: no broadcast without a size bound, no task that a hot key fills."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshloom.plans.lineage import cut

#: bytes of a table up to which it is broadcast
BROADCAST_BYTES = 32 << 20
#: most keys that are told apart as hot, and rows of one key from which it may be
HOT_KEYS, HOT_ROWS = 500_000, 1000


def _bytes(field: T.StructField) -> Column:
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        item = kind.elementType
        inner = F.octet_length(F.array_join(c, "")) if isinstance(item, T.StringType) else F.lit(0)
        return F.coalesce(inner + 24 * F.size(c), F.lit(0)) + 16
    return F.lit(16)


def small(df: DataFrame, most: int | None = None) -> bool:
    """Whether all rows together, by the measured length of their values, have at most so many bytes (BROADCAST_BYTES)."""
    total = sum((_bytes(f) for f in df.schema), F.lit(16)).cast("bigint")
    return (df.agg(F.sum(total)).head()[0] or 0) <= (BROADCAST_BYTES if most is None else min(most, BROADCAST_BYTES))


def if_small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it is small."""
    return F.broadcast(df) if small(df) else df


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], by: list[str], how: str = "inner", counts: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """rows joined with table, which has each key at most once; how is inner, left or left_semi.

    A small table is broadcast. Else rows of a hot key are dealt by a hash of the columns `by` over several tasks, each of which gets the table's row. A key is hot from
    HOT_ROWS rows on, or from one in HOT_KEYS of all rows, if that is more: so there are at most HOT_KEYS hot keys, however large the tables are. counts(keys, _n) spares counting
    the rows where it is known how many of them each key of the table has; most is a lower bound on broadcasts than BROADCAST_BYTES.
    """
    if small(table, most):
        return rows.join(F.broadcast(table), keys, how)
    counts = cut(rows.groupBy(*keys).agg(F.count("*").alias("_n"))) if counts is None else counts
    most = max(HOT_ROWS, (counts.agg(F.sum("_n")).head()[0] or 0) // HOT_KEYS)
    hot = counts.where(F.col("_n") > most).select(*keys, F.ceil(F.col("_n") / F.lit(most)).cast("int").alias("_parts"))
    if not hot.limit(1).count():
        return rows.join(table, keys, how)
    hot = F.broadcast(hot)
    left = rows.join(hot, keys, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*by), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    right = table.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
