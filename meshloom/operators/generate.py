"""Generators of graphs and matrices. All draws are hashes of seed and ids, so they do not depend on partitioning."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from meshloom.functions.hashing import uniform
from meshloom.operators.brain import Brain, neuron_types
from meshloom.operators.matrix import row_pointers

# Fixed values of the deterministic dense matrix.
PRNG_1 = 0x00473EE661D
PRNG_2 = 0x024719D0275
RANGE = 101
MASK = 0x7FFFFFFF


def square(spark: SparkSession, n: int) -> DataFrame:
    """All cells (row, col) of an n x n matrix, spread by row."""
    return spark.range(n).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("col"))


def brain_edges(brain: Brain, seed: int = 0) -> DataFrame:
    """(src, dst, value 1): each ordered pair of different vertices is kept if its draw exceeds 1 - p of its kinds.

    Every pair is drawn once, by definition of the model. Targets are generated a part at a time from its range, so the
    probability is looked up once per (source, part) and no pair is shuffled.
    """
    sources = neuron_types(brain, seed).select(F.col("id").alias("src"), F.col("part").alias("src_part"), F.col("type").alias("src_type"))
    cells = sources.join(F.broadcast(brain.probs), ["src_part", "src_type"]).join(F.broadcast(brain.parts.select(F.col("part").alias("dst_part"), "lo", "hi")), "dst_part").where("hi > lo")
    pairs = cells.select("src", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("dst"), "p")
    return pairs.where((F.col("src") != F.col("dst")) & (uniform(f"edge{seed}", F.col("src"), F.col("dst")) > 1 - F.col("p"))).select("src", "dst", F.lit(1).alias("value"))


def brain_edges_transposed(brain: Brain, seed: int = 0) -> DataFrame:
    """The same graph as rows of the transposed matrix: (row destination, col source, value)."""
    return brain_edges(brain, seed).select(F.col("dst").alias("row"), F.col("src").alias("col"), "value")


def uniform_edges(spark: SparkSession, n: int, zero_pct: float, seed: int = 0, truncate: bool = False) -> DataFrame:
    """(row, col, value 1) off the diagonal, each cell kept if its draw exceeds zero_pct percent.

    truncate keeps the first n * n * (100 - zero_pct) / 100 entries in row-major order, as a buffer of the expected size would. An entry's place is the
    number of entries in the rows before, by a two-level running sum, and its place within the row.
    """
    kept = square(spark, n).where((F.col("row") != F.col("col")) & (uniform(f"uniform{seed}", F.col("row"), F.col("col")) > F.lit(zero_pct / 100)))
    if truncate:
        most = int(n * n * (100 - zero_pct) / 100)
        before = row_pointers(kept, n).select("row", "start").where(F.col("start") < most)
        place = F.col("start") + F.row_number().over(Window.partitionBy("row").orderBy("col"))
        kept = kept.join(before, "row").withColumn("place", place).where(F.col("place") <= most)
    return kept.select("row", "col", F.lit(1).alias("value"))


def block_uniform_edges(densities: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """As `uniform_edges`, with one zero percentage for each block of rows: densities(block, zero_pct), blocks of equal height."""
    blocks = densities.count()
    cells = square(densities.sparkSession, n).withColumn("block", F.floor(F.col("row") * blocks / n)).join(F.broadcast(densities), "block")
    return cells.where((F.col("row") != F.col("col")) & (uniform(f"block{seed}", F.col("row"), F.col("col")) > F.col("zero_pct") / 100)).select("row", "col", F.lit(1).alias("value"))


def dense_binary(spark: SparkSession, n: int, zero_pct: float, seed: int = 0, clear_diagonal: bool = False) -> DataFrame:
    """All cells (row, col, value) of 0 and 1; the diagonal is like any cell unless cleared."""
    value = F.when(uniform(f"dense{seed}", F.col("row"), F.col("col")) < F.lit(zero_pct / 100), F.lit(0)).otherwise(F.lit(1))
    if clear_diagonal:
        value = F.when(F.col("row") == F.col("col"), F.lit(0)).otherwise(value)
    return square(spark, n).withColumn("value", value)


def dense_decimal(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """All cells of doubles: half are zero, the others have one decimal below 100."""
    keep = uniform(f"zero{seed}", F.col("row"), F.col("col")) >= F.lit(0.5)
    return square(spark, n).withColumn("value", F.when(keep, F.floor(uniform(f"value{seed}", F.col("row"), F.col("col")) * 1000) / F.lit(10.0)).otherwise(F.lit(0.0)))


def deterministic_dense(spark: SparkSession, n: int) -> DataFrame:
    """The published matrix without randomness, all cells (row, col, value)."""
    return square(spark, n).withColumn("value", deterministic_value(F.col("row"), F.col("col"), n))


def deterministic_value(i: Column, j: Column, n: int) -> Column:
    """The cell (i, j); factors and products are masked to 31 bits, so that no index below 2^62 overflows; cells whose distance from the diagonal is a power of two need indices below 2^28."""
    low = lambda x: x.bitwiseAND(F.lit(MASK))
    square_of = lambda x: low(low(x) * low(x))
    base = low(low(square_of(i) * F.lit(PRNG_1 & MASK)) + low(square_of(j) * F.lit(PRNG_2 & MASK))) / F.lit(float(MASK)) / F.lit(float(n))
    gap = F.abs(j - i)
    power = (gap > 0) & (gap.bitwiseAND(gap - 1) == 0)
    # upper diagonals use i - k, lower ones i + k
    other = F.when(j > i, i - gap).otherwise(i + gap)
    special = (other * F.lit(PRNG_2) + i * F.lit(PRNG_1)) % F.lit(RANGE)
    return F.when(power, special.cast("double")).otherwise(base)


def neuron_sample(n: int, spark: SparkSession, rows: int | None = None) -> DataFrame:
    """Ids shown in a report: all below 65 rows, else every half of the local rows."""
    step = 1 if n < 65 else max(1, (rows or n) // 2)
    return spark.range(n).where(F.col("id") % step == 0)

