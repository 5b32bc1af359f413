"""Cutting lineage so that the loss of an executor never loses results: everything goes to the shared folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; a temporary one where it is unset (local runs and tests)."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if set_by_cluster:
        if not context._jsc.sc().getCheckpointDir().isDefined():
            context.setCheckpointDir(set_by_cluster)
        return set_by_cluster
    own = context._jsc.sc().getCheckpointDir()
    if not own.isDefined():
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(shutil.rmtree, made, True)
        context.setCheckpointDir(made)
        own = context._jsc.sc().getCheckpointDir()
    return own.get()


def cut(df: DataFrame) -> DataFrame:
    """The frame, computed once and read from the shared folder from now on; Spark's cleaner deletes it when it is unused."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the program ends."""
    path = f"{folder(spark)}/siltstone-{name}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder, deleted when the program ends."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
