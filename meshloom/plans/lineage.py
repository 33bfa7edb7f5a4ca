"""Cutting the lineage of iterative plans through storage that all executors share, and freeing that storage."""

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: one list of files for each open `scratch`
_open: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for local masters whose session names none, as in tests. Raises ValueError on a cluster without one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="meshloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """The same rows from reliable storage: a lost executor costs a read, not the iterations before."""
    shared_folder(df.sparkSession)
    got = df.checkpoint(eager=True)
    if _open and (path := stored_at(got)):
        _open[-1].append(path)
    return got


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """`cut`, dealt by the keys over the session's number of shuffle partitions, so that joins on them need not move the rows again.

    A plan that is adapted while it runs does not say how its rows lie, so this one write is not.
    """
    conf = df.sparkSession.conf
    was = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df.repartition(int(conf.get("spark.sql.shuffle.partitions")), *keys))
    finally:
        conf.set("spark.sql.adaptive.enabled", was)


def stored_at(df: DataFrame) -> str | None:
    """Where `cut` wrote the rows."""
    plan = df._jdf.queryExecution().logical()
    if plan.nodeName() != "LogicalRDD":
        return None
    file = plan.rdd().getCheckpointFile()
    return file.get() if file.isDefined() else None


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free(df: DataFrame) -> None:
    """Deletes what `cut` wrote; df, and plans that read it, must not run after that."""
    if path := stored_at(df):
        delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end all that `cut` wrote within; results must have been written elsewhere by then."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            delete(spark, path)
