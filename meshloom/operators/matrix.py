"""Structure of sparse matrices held as (row, col, value)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def dense_to_coo(m: DataFrame) -> DataFrame:
    """The non-zero cells."""
    return m.where(F.col("value") != 0)


def coo_to_dense(m: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """All cells, 0 where there is no entry."""
    spark = m.sparkSession
    cells = spark.range(n_rows).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_cols - 1).cast("bigint"))).alias("col"))
    zero = F.lit(0).cast(m.schema["value"].dataType)
    return cells.join(m, ["row", "col"], "left").select("row", "col", F.coalesce("value", zero).alias("value"))


def row_pointers(m: DataFrame, n_rows: int) -> DataFrame:
    """(row, start, end) for each row, empty ones and empty matrices too; the last end is the number of entries.

    The prefix sum runs in two levels: within blocks of rows side by side, then over one row for each block.
    """
    spark: SparkSession = m.sparkSession
    size = max(1, int(n_rows**0.5))
    counts = spark.range(n_rows).withColumnRenamed("id", "row").join(m.groupBy("row").agg(F.count("*").alias("nnz")), "row", "left").select("row", F.coalesce("nnz", F.lit(0)).alias("nnz"), F.floor(F.col("row") / size).alias("block"))
    before = counts.groupBy("block").agg(F.sum("nnz").alias("n")).select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    end = F.sum("nnz").over(Window.partitionBy("block").orderBy("row")) + F.col("before")
    return counts.join(before, "block").select("row", "nnz", end.alias("end")).select("row", (F.col("end") - F.col("nnz")).alias("start"), "end")


def csr_arrays(m: DataFrame) -> DataFrame:
    """(row, cols, vals): adjacency lists in column order, non-empty rows only."""
    return m.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("e")).select("row", F.col("e.col").alias("cols"), F.col("e.value").alias("vals"))


def lookup(m: DataFrame, probes: DataFrame, n_rows: int, n_cols: int, found_as_one: bool = False) -> DataFrame:
    """probes(row, col) with `value`: the entry, 0 without one, -1 outside the matrix; found_as_one says 1 for any entry."""
    kind = m.schema["value"].dataType
    hits = m.select("row", "col", F.lit(1).cast(kind).alias("value") if found_as_one else F.col("value"))
    outside = (F.col("row") < 0) | (F.col("row") >= n_rows) | (F.col("col") < 0) | (F.col("col") >= n_cols)
    value = F.when(outside, F.lit(-1).cast(kind)).otherwise(F.coalesce("value", F.lit(0).cast(kind)))
    return probes.join(hits, ["row", "col"], "left").select("row", "col", value.alias("value"))


def nnz_rows(m: DataFrame, n_rows: int | None = None) -> DataFrame:
    """(idx, nnz) of rows; with n_rows, empty rows too."""
    return _counts(m, "row", n_rows)


def nnz_columns(m: DataFrame, n_cols: int | None = None) -> DataFrame:
    return _counts(m, "col", n_cols)


def _counts(m: DataFrame, key: str, n: int | None) -> DataFrame:
    got = m.groupBy(F.col(key).alias("idx")).agg(F.count("*").alias("nnz"))
    if n is None:
        return got
    return m.sparkSession.range(n).withColumnRenamed("id", "idx").join(got, "idx", "left").select("idx", F.coalesce("nnz", F.lit(0)).alias("nnz"))


def nnz_row(m: DataFrame, row: int) -> DataFrame:
    """One row: the number of entries of one matrix row."""
    return m.where(F.col("row") == row).agg(F.count("*").alias("nnz"))


def column_sum(m: DataFrame) -> DataFrame:
    return m.groupBy(F.col("col").alias("idx")).agg(F.sum("value").alias("total"))


def density(m: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """One row: entries, and percent of all cells."""
    return m.agg(F.count("*").alias("nnz")).withColumn("pct", F.col("nnz") * 100.0 / F.lit(float(n_rows) * n_cols))


def count_zeros(m: DataFrame) -> DataFrame:
    """One row: zero cells of a dense matrix."""
    return m.agg(F.count_if(F.col("value") == 0).alias("zeros"))


def preview(m: DataFrame, n: int, most: int = 32) -> DataFrame:
    """(row, text) of a small matrix printed densely; empty above `most` rows, as a guard."""
    dense = coo_to_dense(m, n if n <= most else 0, n)
    cells = dense.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda x: x["value"].cast("string")).alias("v"))
    return cells.select("row", F.array_join("v", " ").alias("text"))


def vector_preview(vec: DataFrame, n: int) -> DataFrame:
    """The whole vector up to 64 entries, else the first two and the last."""
    return vec if n <= 64 else vec.where((F.col("idx") < 2) | (F.col("idx") == n - 1))


def gathered(vec: DataFrame) -> DataFrame:
    """The whole vector in index order, as ranges of indices over tasks."""
    return vec.orderBy("idx")
