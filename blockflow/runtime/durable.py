"""Cuts of lineage in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's switch that removes an execution's shuffle files when the execution ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local one serves a session of one machine; any other session is refused."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file:///tmp/blockflow-checkpoints"
    return where.rstrip("/")


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Executions inside remove their shuffle files as they end: what they wrote is all that anyone reads of them."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


_held: dict[str, SparkSession] = {}


@atexit.register
def _release() -> None:
    for path, spark in _held.items():
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM is gone at exit: the folder is the cluster's to clean
        pass


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there; the files go when the process ends."""
    path = f"{shared_dir(df.sparkSession)}/store-{uuid.uuid4().hex}"
    with freed_shuffles(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _held[path] = df.sparkSession
    return out
