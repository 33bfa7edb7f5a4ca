"""Text files of vectors: the length, then one value a line."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def write_vector(vec: DataFrame, path: str) -> None:
    """Writes (idx, value) as a folder of text parts whose lines, read by file name and then by place, are the length and the values in index order.

    Each part is a range of indices, so no task gathers the vector. Doubles are written as the shortest text that reads back to the same bits.
    """
    n = vec.count()
    lines = vec.select((F.col("idx") + 1).alias("at"), F.col("value").cast("string").alias("value"))
    head = vec.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("at"), F.lit(str(n)).alias("value"))
    lines.unionByName(head).repartitionByRange("at").sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """(idx, value) from such a folder, or from one file; raises if the stated length is not that of the values."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    # a partition's ids rise with the place in the file, and the file's name orders the parts
    rows = rows.withColumn("line", F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1)
    sizes = rows.groupBy("file", "block").agg(F.count("*").alias("n"))
    # one row a file block
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = rows.join(sizes.select("file", "block", "before"), ["file", "block"]).select((F.col("before") + F.col("line") - 1).cast("bigint").alias("idx"), "value")
    stated = placed.where("idx = -1").head()
    values = placed.where("idx >= 0").select("idx", F.col("value").cast("double").alias("value"))
    if stated is None or values.count() != int(stated["value"]):
        raise ValueError(f"{path}: the stated length is not that of the values")
    return values
