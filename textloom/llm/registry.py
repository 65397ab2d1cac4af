"""Queries of the operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import cut, documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.language_id import held_out, identify, train

    docs = documents(spark, sf_dir)
    net = train(docs.where(~held_out()))
    return identify(docs, net).withColumn("held_out", held_out())


def op2_wav_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.wav_fingerprints import media_digest

    return media_digest(documents(spark, sf_dir))


def op3_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.grace_dedup import grace_dedup

    return grace_dedup(documents(spark, sf_dir))


def op4_range_coded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from textloom.llm.common import scratch
    from textloom.llm.token_files import token_file_digest, write_token_files

    path = scratch(spark, "token-files")
    write_token_files(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"), pattern=public_tokenizers.PATTERN)
    return token_file_digest(spark, path)


def op5_kk_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.kk_shards import balanced_shards

    return balanced_shards(documents(spark, sf_dir))


#: Target shares of the quality domains; what is left over goes nowhere, rates stay within 0 and 8.
MIX_WEIGHTS = {"clean_high": 0.7, "clean_low": 0.2, "toxic_high": 0.06, "toxic_low": 0.04}


def op6_domain_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.domain_mixing import mix, quality_domains

    labels = quality_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mix(documents(spark, sf_dir), labels, MIX_WEIGHTS).drop("__uid")


def op7_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from textloom.llm.word_bpe import word_digest

    return word_digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.minhash_bayes import Plan, near_duplicates

    return near_duplicates(documents(spark, sf_dir), Plan(words=3, percent=85, rows=7, bands=32))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.toxicity import held_out, learn, toxicity

    docs = documents(spark, sf_dir)
    lexicon = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()))
    return toxicity(docs.select("doc_id", "text"), lexicon).select("doc_id", held_out().alias("held_out"), "score", "predicted")


#: A fixed key, so that the query gives the same rows each time; real use needs a secret one.
SURROGATE_KEY = "op10 on the driver's synthetic documents"


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.surrogates import pseudonymise

    return pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), SURROGATE_KEY)


def shard_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What operator 5's shards must hold: documents, bytes, slots without gaps, whole groups of equal texts, and bytes that differ by no more than the largest group's."""
    from textloom.llm.kk_shards import balanced_shards

    docs = documents(spark, sf_dir)
    rows = cut(balanced_shards(docs))
    shards = rows.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.count_distinct("slot").alias("slots"), F.min("slot").alias("low"), F.max("slot").alias("high"))
    gapless = (F.col("slots") == F.col("n")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1)
    placed = rows.select("doc_id", "shard", "size").join(docs.select(F.col("doc_id").alias("doc"), F.sha2(F.col("text").cast("binary"), 256).alias("text")), F.col("doc_id") == F.col("doc"))
    groups = placed.groupBy("text").agg(F.count_distinct("shard").alias("k"), F.sum("size").alias("size"))
    split = groups.agg(F.count_if(F.col("k") > 1).alias("split_groups"), F.max("size").alias("largest"))
    whole = shards.agg(F.count("*").alias("shards"), F.sum("n").alias("docs"), F.sum("bytes").alias("bytes"), F.bool_and(gapless).alias("gapless"), (F.max("bytes") - F.min("bytes")).alias("spread"))
    return whole.join(F.broadcast(split)).select("shards", "docs", "bytes", "gapless", (F.col("spread") <= F.col("largest")).alias("even"), "split_groups")


SHARD_LAWS_SQL = """
SELECT 24::BIGINT AS shards, count(*) AS docs, sum(strlen(coalesce(text, '')) + 8)::BIGINT AS bytes, true AS gapless, true AS even, 0::BIGINT AS split_groups FROM documents
"""


def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8's sets by their sizes."""
    return op8_minhash_bayes(spark, sf_dir).select("doc_id", "n_shingles")


SHINGLE_COUNTS_SQL = """
WITH w AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
    FROM documents
)
SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) < 3 THEN 1 ELSE len(list_distinct(list_transform(range(len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]))) END::BIGINT AS n_shingles FROM w
"""


OP3_SQL = """
WITH d AS (
    SELECT doc_id,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
    FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY body) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(body) AS text_sha256
FROM d
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_byte_cnn, op2_wav_fingerprints, op3_grace_dedup, op4_range_coded_ids, op5_kk_shards, op6_domain_mixing, op7_word_bpe, op8_minhash_bayes, op9_toxicity, op10_surrogates, shard_laws, shingle_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op3_grace_dedup": OP3_SQL, "shard_laws": SHARD_LAWS_SQL, "shingle_counts": SHINGLE_COUNTS_SQL}
