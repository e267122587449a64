"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where it is unset and driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/laurel-shared"
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{folder(spark)}/laurel-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str, few_files: bool = False) -> DataFrame:
    """`df` as a Parquet table in the shared folder: it survives lost executors and has no lineage.

    `few_files` is for narrow rows behind a shuffle: they are dealt to as many files as the cluster has cores.
    """
    path = new_path(df.sparkSession, name)
    if few_files:
        df = df.repartition(df.sparkSession.sparkContext.defaultParallelism)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a path through Spark's file systems."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def sweep() -> None:
    """Delete all that was written; a session that has ended is left alone."""
    while _written:
        spark, path = _written.pop()
        if spark.sparkContext._jsc is not None:
            try:
                drop(spark, path)
            except Exception:  # the JVM has gone; nothing more can be deleted from here
                return
