"""The block-structured model of typed vertices: parts, types and connection probabilities as three small relations."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from meshloom.functions.hashing import uniform

# By part, the cumulative shares of its types, and by type the probabilities of a connection to parts 0 to 7.
TYPE_SHARES = [[0.5, 1], [1], [0.7, 1], [0.5, 0.9, 1], [1], [1], [1], [0.3, 1]]
CONNECTIONS = [
    [[0.1, 0.4, 0.4, 0.5, 0.4, 0.4, 0.5, 0.4], [0.4, 0.2, 0.1, 0.1, 0.1, 0.05, 0.1, 0.05]],
    [[0.4, 0.1, 0.4, 0.5, 0.4, 0.4, 0.5, 0.4]],
    [[0.1, 0.5, 0.4, 0.5, 0.4, 0.4, 0.5, 0.4], [0.6, 0.05, 0.1, 0.1, 0.1, 0.05, 0.1, 0.05]],
    [[0.4, 0.5, 0.5, 0.1, 0.4, 0.4, 0.5, 0.4], [0.6, 0.5, 0.2, 0.5, 0.6, 0.5, 0.45, 0.0], [0.6, 0.05, 0.1, 0.1, 0.1, 0.05, 0.1, 0.05]],
    [[0.4, 0.4, 0.4, 0.5, 0.1, 0.4, 0.5, 0.4]],
    [[0.4, 0.4, 0.4, 0.55, 0.4, 0.1, 0.6, 0.4]],
    [[0.4, 0.2, 0.4, 0.6, 0.4, 0.4, 0.05, 0.4]],
    [[0.05, 0.05, 0.1, 0.05, 0.2, 0.1, 0.1, 0.5], [0.4, 0.5, 0.4, 0.6, 0.4, 0.4, 0.05, 0.1]],
]
#: nominal densities in percent of the four published scales, and their factors
SCALES = {"35": 1.0, "3.5": 0.1, "0.35": 0.01, "0.035": 0.001}


@dataclass
class Brain:
    """parts(part, lo, hi), types(part, type, cum_lo, cum_hi), probs(src_part, src_type, dst_part, p); ids are 0 to n - 1."""

    n: int
    parts: DataFrame
    types: DataFrame
    probs: DataFrame

    @classmethod
    def from_rows(cls, spark: SparkSession, n: int, starts: list[int], shares: list[list[float]], connections: list[list[list[float]]]) -> "Brain":
        """From starts of parts, cumulative type shares and probabilities [part][type][part]; raises where they do not fit together."""
        if not starts or starts[0] != 0 or sorted(starts) != list(starts) or len(starts) != len(shares) or len(starts) != len(connections):
            raise ValueError("parts must start at 0, ascend and have shares and connections")
        ends = [*starts[1:], n]
        parts = [(i, int(a), int(b)) for i, (a, b) in enumerate(zip(starts, ends, strict=True))]
        # the last share is at least 1, so that every draw has a type
        types = [(i, t, float(cum[t - 1]) if t else 0.0, float(c) if t + 1 < len(cum) else max(1.0, float(c))) for i, cum in enumerate(shares) for t, c in enumerate(cum)]
        probs = [(i, t, k, float(p)) for i, rows in enumerate(connections) for t, row in enumerate(rows) for k, p in enumerate(row)]
        return cls(
            n,
            spark.createDataFrame(parts, "part INT, lo BIGINT, hi BIGINT"),
            spark.createDataFrame(types, "part INT, type INT, cum_lo DOUBLE, cum_hi DOUBLE"),
            spark.createDataFrame(probs, "src_part INT, src_type INT, dst_part INT, p DOUBLE"),
        )

    def scaled(self, factor: float) -> "Brain":
        return Brain(self.n, self.parts, self.types, self.probs.withColumn("p", F.col("p") * F.lit(factor)))


def hard_brain(spark: SparkSession, n: int, scale: str = "35") -> Brain:
    """The built-in model of 8 equal parts; n must be a multiple of 8."""
    if n % 8:
        raise ValueError("n must be a multiple of 8")
    return Brain.from_rows(spark, n, [i * (n // 8) for i in range(8)], TYPE_SHARES, CONNECTIONS).scaled(SCALES[scale])


def part_of(brain: Brain, ids: DataFrame, column: str = "id") -> DataFrame:
    """Adds `part`: the one whose range holds the id; ids past the last start belong to the last part.

    The model has a handful of parts, fixed by its configuration, so the ranges become one CASE chain instead of a join.
    """
    chain: Column | None = None
    for r in brain.parts.orderBy("lo").collect():
        chain = F.when(F.col(column) >= r.lo, F.lit(r.part)) if chain is None else F.when(F.col(column) >= r.lo, F.lit(r.part)).otherwise(chain)
    return ids.withColumn("part", chain)


def part_sizes(brain: Brain) -> DataFrame:
    """(part, size): the next start, or n, minus the start."""
    w = Window.orderBy("lo")
    return brain.parts.select("part", (F.lead("lo", 1, brain.n).over(w) - F.col("lo")).alias("size"))


def neuron_types(brain: Brain, seed: int = 0) -> DataFrame:
    """(id, part, type): a type for each id by its part's inverse cumulative shares."""
    ids = part_of(brain, brain.parts.sparkSession.range(brain.n)).withColumn("u", uniform(f"type{seed}", F.col("id")))
    hit = (F.col("u") > F.col("cum_lo")) & (F.col("u") <= F.col("cum_hi")) | (F.col("u") == 0) & (F.col("type") == 0)
    return ids.join(F.broadcast(brain.types), "part").where(hit).select("id", "part", "type")


def expected_percentage(brain: Brain) -> DataFrame:
    """(part, type, pct): the mean share of all ids, in percent, that a vertex of this kind connects to; the diagonal counts."""
    sizes = part_sizes(brain).withColumnRenamed("part", "dst_part")
    return brain.probs.join(sizes, "dst_part").groupBy(F.col("src_part").alias("part"), F.col("src_type").alias("type")).agg((F.sum(F.col("size") * F.col("p")) * F.lit(100.0 / brain.n)).alias("pct"))


def recap(brain: Brain) -> DataFrame:
    """The model in one relation (part, lo, hi, type, cum_hi, p array by destination part)."""
    p = brain.probs.groupBy(F.col("src_part").alias("part"), F.col("src_type").alias("type")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dst_part", "p"))), lambda x: x["p"]).alias("p"))
    return brain.parts.join(brain.types, "part").join(p, ["part", "type"]).select("part", "lo", "hi", "type", "cum_hi", "p")


def memory_estimate(brain: Brain, ranks: int = 1) -> DataFrame:
    """One row: bytes of the matrix (12 an entry) in all and by rank, and of the type vector (4 an id), from the expected density."""
    kinds = expected_percentage(brain).join(brain.types, ["part", "type"]).join(part_sizes(brain), "part")
    density = F.sum(F.col("pct") / 100 * F.col("size") * (F.least(F.col("cum_hi"), F.lit(1.0)) - F.col("cum_lo"))) / F.lit(float(brain.n))
    total = F.lit(12.0 * brain.n * brain.n) * F.col("density")
    return kinds.agg(density.alias("density")).select("density", total.alias("matrix_bytes"), (total / ranks).alias("rank_bytes"), F.lit(4 * brain.n).cast("bigint").alias("type_bytes"))
