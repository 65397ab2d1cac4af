"""Folders for what a query writes and reads again, and bounds of what goes to Python workers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names. Where it is unset a local session gets a temporary folder, a cluster's an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="textloom-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete what a query wrote to a path of ``scratch`` and needs no more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows and bytes that an Arrow batch holds at most. Texts reach 100 KB and more, so 10,000 rows could mean a gigabyte.
ARROW_ROWS, ARROW_BYTES = 512, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Hold the Arrow batches that Python workers get to ``ARROW_ROWS`` and ``ARROW_BYTES``."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
