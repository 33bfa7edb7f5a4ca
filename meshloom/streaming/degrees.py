"""An extension: degrees of a graph whose edges arrive as a stream."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_degrees(edges: DataFrame) -> DataFrame:
    """(idx, out_degree, in_degree) of a streaming (src, dst), kept up to date; each edge is counted once per arrival. Use output mode complete or update."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("idx"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("idx"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    return ends.groupBy("idx").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
