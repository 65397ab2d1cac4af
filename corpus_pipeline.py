"""The corpus pipeline: toxicity, exact dedup, near-dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; ``docs`` is a table, so that it
can be read twice with the same rows in the same places.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import documents, scratch
from textloom.llm.domain_mixing import mixed_documents
from textloom.llm.grace_dedup import drop_exact_copies
from textloom.llm.minhash_bayes import Plan, drop_near_copies
from textloom.llm.toxicity import drop_toxic_rows, learn
from textloom.llm.word_bpe import encode_words

#: Documents that score this or more are rejected.
REJECT = 0.3
#: Target token shares of the quality domains. Rates start at 1: mixing repeats documents and leaves none out. So the
#: budget follows from the natural shares, and targets that even rates of ``MOST`` don't reach are named in a warning.
SHARES, LEAST, MOST, BUDGET = {"high": 0.9, "low": 0.1}, 1.0, 3.0, None


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents under the threshold stay; the lexicon is learned from the labelled ones."""
    return drop_toxic_rows(docs, learn(docs, _labels(spark, sf_dir)), REJECT)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of equal texts the document with the largest doc_id stays."""
    return drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of documents connected by a similarity of 0.8 in five-word shingles, the first stays."""
    return drop_near_copies(docs, Plan(words=5, percent=80, rows=7, bands=48))


def mix_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents are repeated by their rates, so that the quality domains' tokens come near their shares."""
    quality = F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    labelled = _labels(spark, sf_dir).select("doc_id", quality.alias("domain"))
    return mixed_documents(docs, labelled, SHARES, LEAST, MOST, BUDGET)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: token ids of each text, and the digest of what they decode to."""
    out = encode_words(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near-dedup", drop_near), ("mixing", mix_quality), ("byte-level BPE", encode)]

#: Learned lexicons, sampled signatures and fitted rates have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder before the next stage reads it."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = scratch(spark, f"pipeline-{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
