"""Layout of block grids and rows over workers: metadata relations and their arithmetic."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.functions.scalars import gcd


def block_layout(spark: SparkSession, rows: int, cols: int, n: int) -> DataFrame:
    """(rank, indl, indc, dim_l, dim_c, start_row, end_row, start_col, end_col), ends inclusive, for a grid of rows x cols blocks."""
    dim_l, dim_c = n // rows, n // cols
    at = spark.range(rows * cols).select(F.col("id").cast("int").alias("rank"), F.floor(F.col("id") / cols).cast("int").alias("indl"), (F.col("id") % cols).cast("int").alias("indc"))
    big = lambda c: c.cast("bigint")
    return at.select(
        "rank", "indl", "indc", F.lit(dim_l).cast("bigint").alias("dim_l"), F.lit(dim_c).cast("bigint").alias("dim_c"),
        big(F.col("indl") * dim_l).alias("start_row"), big((F.col("indl") + 1) * dim_l - 1).alias("end_row"),
        big(F.col("indc") * dim_c).alias("start_col"), big((F.col("indc") + 1) * dim_c - 1).alias("end_col"),
    )


def ranking_layout(spark: SparkSession, rows: int, cols: int, n: int, transposed: bool = False) -> DataFrame:
    """The layout with the groups that compute, need and pass on a distributed result vector.

    For the plain matrix the groups follow the columns of the grid, for the transposed one the rows.
    """
    g = gcd(rows, cols)
    own, other, dim, k = (rows // g, cols // g, "dim_l", rows) if transposed else (cols // g, rows // g, "dim_c", cols)
    along, across = (F.col("indl"), F.col("indc")) if transposed else (F.col("indc"), F.col("indl"))
    step = (cols / rows) if transposed else (rows / cols)
    whole = lambda c: F.floor(c).cast("int")
    within = along % own
    return block_layout(spark, rows, cols, n).select(
        "*",
        whole(across / F.lit(step)).alias("redistribution_root"),
        (F.lit(own) * F.col(dim)).alias("local_result_size"),
        whole(along / F.lit(own)).alias("calculation_group"),
        (F.col("indl") % own if transposed else F.col("indl")).cast("int").alias("indl_in_group"),
        (F.col("indc") if transposed else F.col("indc") % own).cast("int").alias("indc_in_group"),
        ((across % other) * k + along).cast("int").alias("need_group"),
        (F.col("dim_c") * (F.col("indc") % other if transposed else within)).alias("start_col_in_group"),
        (F.col("dim_l") * (within if transposed else F.col("indl") % other)).alias("start_row_in_group"),
        (within * own + F.col("indc") if transposed else within + F.col("indl") * own).cast("int").alias("group_rank"),
    )


def assign_blocks(m: DataFrame, dim_l: int, dim_c: int) -> DataFrame:
    """Adds block_row and block_col."""
    return m.withColumn("block_row", F.floor(F.col("row") / dim_l)).withColumn("block_col", F.floor(F.col("col") / dim_c))


def nnz_per_block(m: DataFrame, dim_l: int, dim_c: int) -> DataFrame:
    return assign_blocks(m, dim_l, dim_c).groupBy("block_row", "block_col").agg(F.count("*").alias("nnz"))


def row_distribution(spark: SparkSession, n: int, workers: int) -> DataFrame:
    """(row, worker): contiguous rows, one more for each of the first n % workers; by arithmetic, so without a sort."""
    each, extra = divmod(n, workers)
    cut = (each + 1) * extra
    worker = F.when(F.col("id") < cut, F.floor(F.col("id") / (each + 1))).otherwise(F.lit(extra) + F.floor((F.col("id") - cut) / max(1, each)))
    return spark.range(n).select(F.col("id").alias("row"), worker.cast("int").alias("worker"))


def fitting_workers(n: int, workers: int) -> int:
    """The most workers, at most so many, that divide n."""
    while n % workers:
        workers -= 1
    return workers


def run_times(times: DataFrame) -> DataFrame:
    """One row of least, most and mean of times(seconds)."""
    return times.agg(F.min("seconds").alias("least"), F.max("seconds").alias("most"), F.avg("seconds").alias("mean"))
