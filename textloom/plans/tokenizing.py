"""Queries on tokenization, rendering, packing and generation, with the vocabulary of single bytes where SQL is to follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import arrays
from textloom.operators import tasks, tokens
from textloom.plans.base import query, table


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


BYTES = {bytes([i]): i for i in range(256)}


@query("SELECT doc_id, strlen(text) + 1 AS n FROM documents")
def encode_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With single bytes as vocabulary an encoding has as many ids as the text has bytes, and a bos."""
    return docs(spark, sf_dir).select("doc_id", F.size(tokens.encoder(BYTES, prepend=256)("text")).cast("long").alias("n"))


@query(None)
def train_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    merges = tokens.train_bpe(docs(spark, sf_dir), 256 + 200 + 9)
    return spark.createDataFrame([(256 + i, a, b) for i, (a, b) in enumerate(merges)], "token_id int, left_id int, right_id int")


@query("SELECT doc_id, true AS whole FROM documents")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    ranks = tokens.ranks_of(tokens.train_bpe(d, 256 + 200 + 9))
    return d.select("doc_id", (tokens.decoder(ranks)(tokens.encoder(ranks)("text")) == F.col("text")).alias("whole"))


@query("SELECT range::INT AS token_id, CASE WHEN range < 128 THEN 1 WHEN range < 256 THEN 3 ELSE 0 END AS n_bytes, range >= 256 AS special FROM range(265)")
def token_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.vocabulary(spark, BYTES).select("token_id", "n_bytes", "special")


MERGED = """c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn) AS m FROM conversations GROUP BY 1),
u AS (SELECT conv_id, CASE WHEN m[1].r = 'system' AND len(m) > 1 THEN list_concat([{'r': m[2].r, 't': m[1].t || chr(10) || chr(10) || m[2].t}], m[3:]) ELSE m END AS m FROM c)"""


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.gather(table(spark, sf_dir, "conversations")).select("conv_id", tasks.merge_system(F.col("messages")).alias("m"))


def byte_ids_sql(text: str) -> str:
    """The bytes of a text in SQL."""
    return f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::INT)"


RENDERED = f"list_transform(m, lambda x: CASE WHEN x.r = 'user' THEN list_concat(list_concat([257], {byte_ids_sql('x.t')}), [258]) ELSE list_concat(list_concat([259], {byte_ids_sql('x.t')}), [260]) END)"
SUPERVISED = "list_transform(m, lambda x: CASE WHEN x.r = 'user' THEN list_transform(range(strlen(x.t) + 2), lambda i: 0) ELSE list_transform(range(strlen(x.t) + 2), lambda i: (i > 0)::INT) END)"


@query(
    f"""WITH {MERGED}, r AS (SELECT conv_id, list_concat([256], flatten({RENDERED})) AS ids, list_concat([0], flatten({SUPERVISED})) AS mask FROM u)
    SELECT conv_id, len(ids[:2048]) AS n, list_sum(mask[:2048])::BIGINT AS supervised, array_to_string(ids[:2048], ' ') AS ids, array_to_string(mask[:2048], '') AS mask FROM r"""
)
def render_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and masks of rendered conversations, cut at 2,048."""
    r = merged(spark, sf_dir).select("conv_id", tokens.render_conversation(F.col("m")).alias("r"))
    joined = lambda c, by: F.array_join(F.transform(c, lambda x: x.cast("string")), by)
    return r.select("conv_id", F.size("r.ids").cast("long").alias("n"), F.aggregate("r.mask", F.lit(0), lambda a, x: a + x).cast("long").alias("supervised"), joined("r.ids", " ").alias("ids"), joined("r.mask", "").alias("mask"))


@query(
    f"""WITH {MERGED}, l AS (SELECT conv_id, m[:len(m) - 1] AS m FROM u WHERE m[len(m)].r = 'assistant' AND len(m) > 1), r AS (SELECT conv_id, list_concat(list_concat([256], flatten({RENDERED}))[:2048], [259]) AS ids FROM l)
    SELECT conv_id, len(ids) AS n, array_to_string(ids, ' ') AS ids FROM r"""
)
def render_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of the conversations that end with an assistant message: cut at 2,048, then the mark that starts an answer."""
    d = merged(spark, sf_dir).where("element_at(m, -1).role = 'assistant' and size(m) > 1")
    d = d.select("conv_id", tokens.render_for_completion(F.col("m")).alias("ids"))
    return d.select("conv_id", F.size("ids").cast("long").alias("n"), F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


VALUES = "(SELECT vec_id, list_transform(embedding, lambda x: (x * 1000)::INT % 1000) AS t FROM embeddings)"


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x, i: ((F.col("vec_id") + i) % 97).cast("int")).alias("t"))


T = "(SELECT vec_id, list_transform(range(64), lambda i: ((vec_id + i) % 97)::INT) AS t FROM embeddings)"


@query(f"SELECT vec_id, array_to_string(t[:63], ' ') AS inputs, array_to_string(t[2:], ' ') AS targets FROM {T}")
def shift_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return values(spark, sf_dir).select("vec_id", F.array_join(arrays.inputs(t), " ").alias("inputs"), F.array_join(arrays.targets(t), " ").alias("targets"))


@query(f"SELECT vec_id, array_to_string(list_transform(t[2:], lambda x, i: CASE WHEN x % 3 = 0 OR i >= 50 THEN -1 ELSE x END), ' ') AS targets FROM {T}")
def mask_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token x is supervised unless 3 divides it; content ends at 50."""
    t = F.col("t")
    mask = F.transform(t, lambda x: (x % 3 != 0).cast("int"))
    return values(spark, sf_dir).select("vec_id", F.array_join(arrays.masked_targets(t, mask, F.lit(50)), " ").alias("targets"))


@query(f"SELECT vec_id, array_to_string(t[greatest(len(t[:n]) - 20, 0) + 1:n], ' ') AS cropped, greatest(n - 20, 0)::INT AS shift FROM (SELECT *, (vec_id % 40 + 1) AS n FROM {T})")
def left_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = values(spark, sf_dir).select("vec_id", F.slice("t", F.lit(1), (F.col("vec_id") % 40 + 1).cast("int")).alias("t"))
    return d.select("vec_id", F.array_join(arrays.left_crop(F.col("t"), 20), " ").alias("cropped"), arrays.crop_shift(F.col("t"), 20).alias("shift"))


@query(f"SELECT vec_id, array_to_string(list_concat(t[:n], list_transform(range(m - n), lambda i: 0)), ' ') AS padded FROM (SELECT *, max(n) OVER (PARTITION BY vec_id // 8) AS m FROM (SELECT *, (vec_id % 40 + 1) AS n FROM {T}))")
def pad_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = values(spark, sf_dir).select("vec_id", F.slice("t", F.lit(1), (F.col("vec_id") % 40 + 1).cast("int")).alias("t"), F.expr("vec_id div 8").alias("batch"))
    longest = d.groupBy("batch").agg(F.max(F.size("t")).alias("m"))
    return d.join(longest, "batch").select("vec_id", F.array_join(arrays.right_pad(F.col("t"), F.col("m"), 0), " ").alias("padded"))


def packed(spark: SparkSession, sf_dir: str, crop: bool) -> DataFrame:
    ids = tokens.encoder(BYTES, prepend=256)("text")
    d = docs(spark, sf_dir).select((F.col("doc_id") % 8).alias("rank"), "doc_id", ids.alias("ids"))
    return tokens.pack(d, "rank", "doc_id", "ids", 513, buffer=100, crop=crop, pad=256)


@query(None)
def pack_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, sf_dir, True).select("rank", "row", "n_docs", "placed", "cut", F.size("tokens").alias("size"))


@query(None)
def pack_bestfit_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, sf_dir, False).select("rank", "row", "n_docs", "placed", "content", F.size("tokens").alias("size"))


@query("SELECT doc_id % 8 AS rank, sum(strlen(text) + 1)::BIGINT AS total, 513 AS size FROM documents GROUP BY 1")
def pack_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is placed and what is cut off adds up to all tokens."""
    rows = packed(spark, sf_dir, True)
    return rows.groupBy("rank").agg((F.sum("placed") + F.sum("cut")).alias("total"), F.max(F.size("tokens")).alias("size"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ((n_chars + 2) * 3)::VARCHAR WHEN doc_id % 3 = 0 THEN NULL ELSE (length(source) - length(replace(source, 's', '')))::VARCHAR END AS value FROM documents")
def calculator(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    e = F.when(n % 2 == 0, F.concat(F.lit("("), F.col("n_chars").cast("string"), F.lit(" + 2) * 3"))).when(n % 3 == 0, "2 ** 9").otherwise(F.concat(F.lit("'"), "source", F.lit("'.count('s')")))
    return docs(spark, sf_dir).select("doc_id", tokens.calculator(e).alias("value"))


@query("SELECT doc_id, length(n_chars::VARCHAR || '+1') + 2 + 2 + length((n_chars + 1)::VARCHAR) + 2 AS n, length((n_chars + 1)::VARCHAR) + 2 AS forced FROM documents")
def tool_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampled call ``n+1``, then filler that the call's output displaces, then an end mark."""
    special = {n: tokens.special_id(n) for n in tokens.SPECIALS}
    call = arrays.byte_ids(F.concat(F.col("n_chars").cast("string"), F.lit("+1")))
    out = F.length((F.col("n_chars") + 1).cast("string")) + 2
    log = F.concat(F.array(F.lit(special["<|python_start|>"])), call, F.array(F.lit(special["<|python_end|>"])), F.array_repeat(F.lit(65), out), F.array(F.lit(66), F.lit(special["<|assistant_end|>"]), F.lit(67)))
    r = tokens.replay(docs(spark, sf_dir).select("doc_id", log.alias("log")), "doc_id", "log")
    return r.select("doc_id", F.size("tokens").cast("long").alias("n"), F.size(F.filter("mask", lambda m: m == 0)).cast("long").alias("forced"))


@query(None)
def dry_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", tokens.mock_score(arrays.byte_ids(F.col("text")), F.lit(5)).alias("score"))
