"""From raw documents to a training mix: quality rules, line dedup, near-duplicate removal, benchmark decontamination, source mixing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return the columns of documents.
`run` writes each stage's rows as Parquet to the shared checkpoint folder and reads them back, so that a lost executor costs no earlier stage. What a stage
and the one before it left there goes once the next stage is written; the last rows that were written stay, as the result reads them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from meshloom.llm import decontam, lines, mixing, neardup, quality
from meshloom.plans.lineage import delete, scratch, shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the risk-controlled quality rules reject go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Multi-line chunks that an earlier place of the corpus has are cut from texts; documents stay, unless all of their text was cut."""
    return lines.remove_repeated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id stays."""
    return neardup.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of the benchmark go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with the number of times that its source's weight repeats it."""
    return mixing.mix(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mix_sources", mix_sources)]

#: the near-duplicate stage compares all documents that share a shingle, which is too slow in SQL on whole tables; the tests hold every stage, and so the rows of `run`, against a
#: version of each stage in plain Python that shares no code with the operators
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, last = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            delete(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
