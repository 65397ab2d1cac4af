"""All named queries over the driver tables, each with its SQL counterpart where one exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.plans import analytics, base, chat, corpus, evaluation, pool, roundtrips, streams, texts, tokenizing  # noqa: F401  (registers the queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.shard_summary(spark, sf_dir)


def queries() -> dict[str, base.Query]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
