"""Models from JSON configurations, and their tables as Parquet."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from meshloom.operators.brain import Brain

SCHEMA = """namePart STRING, id INT, connectionOpposite DOUBLE, distribution ARRAY<DOUBLE>, nbTypeNeuron INT, nbNeuron BIGINT,
 typeNeuron ARRAY<STRUCT<name: STRING, nbNeuron: BIGINT, nbConnection: BIGINT, neurotransmitter: STRING>>"""


def read_brain(spark: SparkSession, path: str) -> Brain:
    """Two hemispheres from one list of parts: each gets half of every part, and connections go to the own or the opposite side.

    Starts are the cumulative halves, cut to whole ids; a part keeps its place in the file. Probabilities are not clamped.
    """
    rows = spark.read.schema(SCHEMA).json(path, multiLine=True)
    return brain_from_config(rows.select(F.struct(*rows.columns).alias("c")).groupBy().agg(F.collect_list("c").alias("all")).select(F.posexplode("all").alias("pos", "c")).select("pos", "c.*"))


def brain_from_config(config: DataFrame) -> Brain:
    """From rows of the schema above with their place `pos`; a configuration file has a few parts."""
    n_parts = config.count()
    # each of the few parts meets the two sides
    both = config.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("part", (F.col("side") * n_parts + F.col("pos")).cast("int"))
    w = Window.orderBy("part")
    cum = F.sum(F.col("nbNeuron") / 2).over(w)
    starts = both.select("part", cum.alias("cum")).select("part", "cum", F.coalesce(F.lag("cum").over(w), F.lit(0.0)).cast("bigint").alias("lo"))
    n = int(starts.agg(F.max("cum")).head()[0])
    parts = starts.select("part", "lo", F.lead("lo", 1, n).over(w).alias("hi"))
    kinds = both.select("part", "side", "connectionOpposite", "distribution", F.col("nbNeuron").alias("size"), F.posexplode("typeNeuron").alias("type", "t"))
    share = F.sum(F.col("t.nbNeuron") / F.col("size")).over(Window.partitionBy("part").orderBy("type"))
    types = kinds.select("part", F.col("type").cast("int").alias("type"), share.alias("cum_hi"))
    wt = Window.partitionBy("part").orderBy("type")
    types = types.select("part", "type", F.coalesce(F.lag("cum_hi").over(wt), F.lit(0.0)).alias("cum_lo"), F.when(F.lead("type").over(wt).isNull(), F.greatest("cum_hi", F.lit(1.0))).otherwise(F.col("cum_hi")).alias("cum_hi"))
    total = config.agg(F.sum("nbNeuron")).head()[0]
    targets = kinds.select("part", "side", "type", "t", "connectionOpposite", F.posexplode("distribution").alias("k", "d")).withColumn("to_side", F.explode(F.array(F.lit(0), F.lit(1))))
    factor = F.when(F.col("side") == F.col("to_side"), 1 - F.col("connectionOpposite")).otherwise(F.col("connectionOpposite"))
    probs = targets.select(F.col("part").alias("src_part"), F.col("type").cast("int").alias("src_type"), (F.col("to_side") * n_parts + F.col("k")).cast("int").alias("dst_part"), (factor * F.col("d") * F.col("t.nbConnection") / F.lit(float(total))).alias("p"))
    return Brain(n, parts, types, probs)


def write_brain(brain: Brain, folder: str) -> None:
    """The three tables and the size as Parquet below the folder."""
    for name in ("parts", "types", "probs"):
        getattr(brain, name).write.mode("overwrite").parquet(f"{folder}/{name}")
    brain.parts.sparkSession.range(brain.n, brain.n + 1).toDF("n").write.mode("overwrite").parquet(f"{folder}/size")


def load_brain(spark: SparkSession, folder: str) -> Brain:
    """What `write_brain` wrote."""
    return Brain(spark.read.parquet(f"{folder}/size").head()[0], *(spark.read.parquet(f"{folder}/{name}") for name in ("parts", "types", "probs")))
