"""What the operators share: reading, lineage cuts, Arrow batch bounds and the hot-key join."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that an Arrow batch holds at most. Texts reach 100 KB and more, so 10,000 rows could mean a gigabyte.
ARROW_ROWS, ARROW_BYTES = 512, 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Hold the Arrow batches that Python workers get to ``rows`` and ``ARROW_BYTES``."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset, a local session gets a temporary one; a cluster's gets an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="textloom-checkpoint-"))
    return named or sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder (see there) and read back: a cut of the lineage that outlives executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in docs.columns}
    while f"__{name}" in taken:
        name = f"_{name}"
    return f"__{name}"


def text_bytes(column: str = "text") -> Column:
    """The column's UTF-8 bytes; null counts as the empty text."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def hot_join(big: DataFrame, small: DataFrame, key: str, rows: Column | str, total: int, spread: Column, salts: int = 64) -> DataFrame:
    """Left join of ``big`` with ``small`` (one row a ``key``), with hot keys spread over ``salts`` sub-keys.

    A key is hot if ``rows`` (its rows in ``big``) is over a thousandth of ``total``. There are fewer than 1,000 such
    keys whatever the data, so their list may be broadcast. ``spread`` gives a big row's salt.
    """
    count = F.col(rows) if isinstance(rows, str) else rows
    is_hot = count * F.lit(1000) > F.lit(total)
    hot = small.where(is_hot).select(F.col(key).alias("__hot_key"))
    left = big.join(F.broadcast(hot), big[key] == F.col("__hot_key"), "left")
    left = left.withColumn("__salt", F.when(F.col("__hot_key").isNotNull(), F.pmod(spread, F.lit(salts)).cast("int")).otherwise(F.lit(0))).drop("__hot_key")
    right = small.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "__salt"], "left").drop("__salt")
