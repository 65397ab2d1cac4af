"""Queries that run bounded streams to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import tokens
from textloom.plans.base import query, table
from textloom.streaming import streams


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


@query("SELECT lang, count(*) AS docs, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def stream_scan_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _stream(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
    return streams.collect_stream(got, f"scan_{uuid.uuid4().hex}", "complete")


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A demonstration of event-time windows, which the corpus operators have no use for: window counts, added up again."""
    got = streams.collect_stream(streams.windowed_counts(_stream(spark, sf_dir, "events")), f"windows_{uuid.uuid4().hex}", "complete")
    return got.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))


@query("SELECT doc_id AS row_id, count(*) AS n FROM documents, range(2) GROUP BY 1")
def stream_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that sample a letter and their end; what comes after isn't taken."""
    end = tokens.special_id("<|assistant_end|>")
    rows = _stream(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.posexplode(F.array(F.lit(65), F.lit(end), F.lit(66))).alias("step", "token"))
    got = streams.stored_stream(streams.tool_stream(rows.withColumn("step", F.col("step").cast("long"))))
    return got.groupBy("row_id").agg(F.count("*").alias("n"))


@query(None)
def stream_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = tokens.encoder({bytes([i]): i for i in range(256)}, prepend=256)("text")
    d = _stream(spark, sf_dir, "documents").select((F.col("doc_id") % 4).alias("rank"), "doc_id", ids.alias("ids"))
    got = streams.pack_stream(d, "rank", "doc_id", "ids", 257, 20).select("rank", "row", F.size("tokens").alias("size"))
    return streams.stored_stream(got)
