"""Sharded text corpora: positions, splits, rank strides, resumable scans and the shard sink."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.ranking import running_sum

ROW_GROUP = 1024
#: The writer options that make a corpus shard.
SHARD_OPTIONS = {
    "compression": "zstd",
    "parquet.compression.codec.zstd.level": "3",
    "parquet.enable.dictionary": "false",
    "parquet.column.statistics.enabled": "false",
    "parquet.block.row.count.limit": str(ROW_GROUP),
}


def scan(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """text, file, row (in its file) and rg (row group) of a folder of shards; rows keep no order of their own."""
    docs = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return docs.select("text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")).withColumn("rg", F.expr(f"row div {ROW_GROUP}"))


def split_of(docs: DataFrame, shard: str = "file") -> DataFrame:
    """Column split: the last shard by name is 'val', all before it 'train'. The last name is one row, so its broadcast is bounded."""
    last = docs.agg(F.max(shard).alias("__last"))
    return docs.join(F.broadcast(last)).withColumn("split", F.when(F.col(shard) == F.col("__last"), "val").otherwise("train")).drop("__last")


def rank_stride(docs: DataFrame, rank: int, world: int, rg: str = "rg") -> DataFrame:
    """Row groups that ``rank`` of ``world`` reads of each file."""
    return docs.where((F.col(rg) >= rank) & ((F.col(rg) - rank) % world == 0))


def resume_point(rg_idx: int, rank: int, world: int) -> int:
    """The next row group of ``rank`` after a saved one."""
    return (rg_idx // world + 1) * world + rank


def epochs(docs: DataFrame, n: int, rank: int = 0, world: int = 1, after: tuple[int, int, int] | None = None, file: str = "file_no") -> DataFrame:
    """``n`` passes over the rank's row groups with a column epoch from 1 on; ``after`` (file, row group, epoch) resumes behind a saved point.

    The epochs are a literal array that each row explodes, not a join.
    """
    out = rank_stride(docs, rank, world).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(n))))
    if after is None:
        return out
    pq, rg, epoch = after
    first = resume_point(rg, rank, world)
    here = (F.col("epoch") == epoch) & (F.col(file) == pq) & (F.col("rg") >= first)
    return out.where((F.col("epoch") > epoch) | ((F.col("epoch") == epoch) & (F.col(file) > pq)) | here)


def running_chars(docs: DataFrame, pos: str, text: str = "text") -> DataFrame:
    """``docs`` with chars and before (characters of all rows before by ``pos``)."""
    return running_sum(docs.withColumn("chars", F.length(text).cast("long")), pos, "chars")


def char_budget(docs: DataFrame, pos: str, most: int, cap: int | None = None) -> DataFrame:
    """The prefix of documents up to and with the one whose characters take the total over ``most``; texts are cut at ``cap`` first."""
    if cap is not None:
        docs = docs.withColumn("text", F.substring("text", 1, cap))
    return running_chars(docs, pos).where(F.col("before") <= most)


def greedy_shards(docs: DataFrame, pos: str, budget: int, row_group: int = ROW_GROUP, drop_tail: bool = False) -> DataFrame:
    """Column shard: a shard ends with the row group whose characters take it to ``budget`` or more.

    Only full row groups can end a shard, so the fold runs over row-group sums, a few bytes for 1,024 documents. Where a
    shard ends depends on all before it: one task reads the sums in order, as a stream, and holds two numbers.
    ``pos`` must be dense from 0. The documents after the last full shard are dropped with ``drop_tail``.
    """
    docs = docs.withColumn("__rg", F.expr(f"{pos} div {row_group}"))
    sums = docs.groupBy("__rg").agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)).alias("n"), F.count("*").alias("docs"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = 0, 0
        for b in batches:
            shards, closed = [], []
            for n, count in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                shards.append(number)
                held += n
                closed.append(held >= budget and count == row_group)
                if closed[-1]:
                    number, held = number + 1, 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shards, pa.int32()), pa.array(closed, pa.bool_())], names=["__rg", "shard", "closed"])

    placed = sums.repartition(1).sortWithinPartitions("__rg").mapInArrow(fold, "__rg long, shard int, closed boolean")
    if drop_tail:
        closed = placed.where("closed").agg(F.max("shard").alias("__last"))
        placed = placed.join(F.broadcast(closed)).where(F.col("shard") <= F.col("__last")).drop("__last")
    return docs.join(placed.drop("closed"), "__rg").drop("__rg")


def write_shards(docs: DataFrame, path: str, shard: str = "shard", pos: str = "pos") -> None:
    """One folder a shard, rows in ``pos`` order, with the corpus's writer options; no shuffle brings a shard to more than one task."""
    out = docs.repartition(F.col(shard)).sortWithinPartitions(shard, pos)
    out.select("text", shard).write.mode("overwrite").options(**SHARD_OPTIONS).partitionBy(shard).parquet(path)


def finalize(train: DataFrame, val: DataFrame, shard: str = "shard") -> DataFrame:
    """``train`` with ``val`` as the last shard. ValueError if either is empty."""
    last = train.agg(F.max(shard)).first()[0]
    if last is None or val.isEmpty():
        raise ValueError("a corpus needs a train shard and val documents")
    return train.unionByName(val.withColumn(shard, F.lit(last + 1).cast(train.schema[shard].dataType)))


def parity_topup(totals: DataFrame, filler: DataFrame, tolerance: float) -> DataFrame:
    """The fillers (pos, chars) that each arm (arm, total) gets: one after the other while it is under the largest total less ``tolerance``.

    Arms are a handful; each filler is kept for an arm by its own running sum, so that tails are prefixes of each other.
    """
    target = totals.agg(F.max("total").alias("target"))
    arms = totals.join(F.broadcast(target)).withColumn("least", F.col("target") * (1 - tolerance))
    queue = running_sum(filler.select("pos", "chars"), "pos", "chars")
    return queue.join(F.broadcast(arms), F.col("total") + F.col("before") < F.col("least")).select("arm", "pos", "chars", "before")


def train_docs(docs: DataFrame, limit: int | None = None, file: str = "file", row: str = "row") -> DataFrame:
    """Documents of all shards but the last, in order of file and row; at most the first ``limit``."""
    train = split_of(docs, file).where("split = 'train'").drop("split")
    return train if limit is None else train.orderBy(file, row).limit(limit)


def shard_path(folder: str, index: int) -> str:
    return f"{folder}/shard_{index:05d}.parquet"


def ensure_shard(spark: SparkSession, source: str, index: int, folder: str, most: int, chars: int, docs: int, seed: int = 0) -> DataFrame:
    """Shard ``index`` of ``source``: read if it is there, else made and written first.

    'synthetic' shards are made from the seed and the index. Other known sources can't be fetched here: an index over
    ``most`` is a ValueError, a shard that isn't there a FileNotFoundError. An unknown source is a ValueError.
    """
    from textloom.sources.text import synthetic_shard

    if source not in ("synthetic", "download"):
        raise ValueError(f"unknown source {source!r}")
    path = shard_path(folder, index)
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        pass
    if source == "download":
        if index > most:
            raise ValueError(f"there are {most + 1} shards; {index} was asked for")
        raise FileNotFoundError(path)
    made = synthetic_shard(spark, index, chars, docs, seed)
    made.repartitionByRange(1, "pos").sortWithinPartitions("pos").select("text").write.mode("overwrite").options(**SHARD_OPTIONS).parquet(path)
    return spark.read.parquet(path)


def shard_documents(spark: SparkSession, source: str, indices: Sequence[int], folder: str, most: int, chars: int, docs: int, seed: int = 0) -> DataFrame:
    """shard, row and text of the shards ``indices``, each made where it isn't there."""
    for i in indices:
        ensure_shard(spark, source, i, folder, most, chars, docs, seed)
    rows = spark.read.parquet(*(shard_path(folder, i) for i in indices))
    shard = F.regexp_extract(F.col("_metadata.file_path"), r"shard_(\d{5})\.parquet", 1).cast("int")
    return rows.select(shard.alias("shard"), F.col("_metadata.row_index").alias("row"), "text")
