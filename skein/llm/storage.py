"""Lineage cuts in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Where it is unset and all tasks
    run in this process (tests), a local one is made and set for the session; a
    cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(?:\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="skein-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/skein-{uuid.uuid4().hex[:12]}-{name}"


#: Files of a table for each core of the cluster, at most.
FILES_PER_CORE = 4


def materialize(df: DataFrame, name: str, merge: bool = True) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: later
    stages re-read the table when an executor is lost, and joins on it get an
    exchange of their own, whose skewed partitions adaptive execution splits.
    A few files a core are enough: more would cost more to commit than to fill.
    ``merge=False`` keeps a task for each partition, where a function tells
    partitions apart by the task."""
    spark = df.sparkSession
    path = new_path(spark, name)
    out = df.coalesce(FILES_PER_CORE * max(2, spark.sparkContext.defaultParallelism)) if merge else df
    out.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._skein_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path made by ``new_path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*dfs: DataFrame) -> None:
    """Deletes tables made by ``materialize`` that no later plan reads."""
    for df in dfs:
        path = getattr(df, "_skein_path", None)
        if path:
            remove(df.sparkSession, path)
