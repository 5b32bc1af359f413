"""Where the operators keep intermediate tables (siltstone.durable), and how many rows an Arrow batch of theirs holds."""

from __future__ import annotations

from pyspark.sql import SparkSession

from siltstone.durable import cut, folder, scratch, written
from siltstone.session import importable

__all__ = ["bounded", "cut", "folder", "scratch", "written"]

#: Rows and bytes in one Arrow batch; texts may be long, and both sides hold whole batches.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bounded(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> SparkSession:
    """Lets Arrow batches hold little, unless the session asks for fewer rows yet; lets workers import the library."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{batch_bytes}b")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)
    return spark
