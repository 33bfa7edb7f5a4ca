"""Products, normalisation and residuals over (row, col, value) and (idx, value)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _divide(m: DataFrame, key: str, totals: DataFrame) -> DataFrame:
    return m.join(totals.withColumnRenamed("idx", key), key).select("row", "col", F.try_divide(F.col("value").cast("double"), F.col("total").cast("double")).alias("value"))


def normalize_columns(m: DataFrame) -> DataFrame:
    """Each value over its column's sum; null where that is 0. The sums are pre-aggregated, so a hot column is no hot task."""
    return _divide(m, "col", m.groupBy(F.col("col").alias("idx")).agg(F.sum("value").alias("total")))


def normalize_columns_binary(m: DataFrame) -> DataFrame:
    """Each value over its column's number of entries."""
    return _divide(m, "col", m.groupBy(F.col("col").alias("idx")).agg(F.count("*").alias("total")))


def normalize_rows_binary(m: DataFrame) -> DataFrame:
    """Each value becomes 1 over its row's number of entries."""
    return normalize_rows_given(m.withColumn("value", F.lit(1.0)), m.groupBy(F.col("row").alias("idx")).agg(F.count("*").alias("total")))


def normalize_rows_given(m: DataFrame, totals: DataFrame) -> DataFrame:
    """Each value over the supplied (idx, total) of its row."""
    return _divide(m, "row", totals)


def matvec(m: DataFrame, vec: DataFrame, n_rows: int | None = None) -> DataFrame:
    """(idx, value) of m times vec; rows without a product are missing, or 0 with n_rows."""
    v = vec.select(F.col("idx").alias("col"), F.col("value").alias("x"))
    got = m.join(v, "col").groupBy(F.col("row").alias("idx")).agg(F.sum(F.col("value") * F.col("x")).alias("value"))
    if n_rows is None:
        return got
    return m.sparkSession.range(n_rows).withColumnRenamed("id", "idx").join(got, "idx", "left").select("idx", F.coalesce("value", F.lit(0.0)).alias("value"))


def push(edges: DataFrame, vec: DataFrame, degrees: DataFrame | None = None) -> DataFrame:
    """(idx, value): each source's value, split evenly over its out-edges, gathered at destinations; works without stored weights."""
    degrees = degrees if degrees is not None else edges.groupBy(F.col("src").alias("idx")).agg(F.count("*").alias("degree"))
    share = vec.join(degrees, "idx").select(F.col("idx").alias("src"), (F.col("value") / F.col("degree")).alias("share"))
    return edges.join(share, "src").groupBy(F.col("dst").alias("idx")).agg(F.sum("share").alias("value"))


def pull(transposed: DataFrame, vec: DataFrame) -> DataFrame:
    """As `push`, from rows (row destination, col source) of the transposed matrix."""
    return push(transposed.select(F.col("col").alias("src"), F.col("row").alias("dst")), vec)


def matvec_arrays(rows: DataFrame, x: list[float]) -> DataFrame:
    """Dense product of rows(row, vals array) with a short vector held in the plan."""
    v = F.array(*[F.lit(float(a)) for a in x])
    return rows.select(F.col("row").alias("idx"), F.aggregate(F.zip_with("vals", v, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, a: s + a).alias("value"))


def residual(m: DataFrame, vec: DataFrame) -> DataFrame:
    """One row (eigenvalue, residual): the L2 norm of m x, and the L2 distance of x from m x over that norm."""
    both = vec.join(matvec(m, vec).withColumnRenamed("value", "y"), "idx", "left").select("value", F.coalesce("y", F.lit(0.0)).alias("y"))
    # |x - y/c|^2 = |x|^2 - 2 x.y/c + |y|^2/c^2 would cancel; the norm is one row, joined for the second pass
    norm = both.agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("eigenvalue"))
    c = norm.head()[0]
    gap = F.col("value") - F.try_divide(F.col("y"), F.lit(c))
    return both.agg(F.lit(c).alias("eigenvalue"), F.sqrt(F.sum(gap * gap)).alias("residual"))
