"""Queries on vocabularies, chat prompts, streamed text, task evaluation and run columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import arrays, render
from textloom.operators import evaluation, metrics, tasks, tokens
from textloom.plans.base import query, table
from textloom.plans.tokenizing import BYTES, byte_ids_sql
from textloom.sources.scratch import scratch


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


SMALL = BYTES | {b"th": 256, b"he": 257, b"the": 258, b"in": 259}
TOKENS_SQL = f"['th', 'he', 'the', 'in', {', '.join(repr(s) for s in tokens.SPECIALS)}]"


@query(
    f"""SELECT range::INT AS token_id, CASE WHEN range < 256 THEN printf('%02X', range) ELSE hex(encode({TOKENS_SQL}[range - 255])) END AS token,
    CASE WHEN range < 128 THEN 1 WHEN range < 256 THEN 3 WHEN range < 260 THEN strlen({TOKENS_SQL}[range - 255]) ELSE 0 END::INT AS n_bytes, range >= 260 AS special FROM range(269)"""
)
def vocabulary_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary that is saved, loaded and made into a table again."""
    path = scratch(spark, "vocabulary")
    tokens.save_vocabulary(tokens.vocabulary(spark, SMALL), path)
    ranks, specials = tokens.load_vocabulary(spark, path)
    return tokens.vocabulary(spark, ranks, specials).select("token_id", F.hex("token").alias("token"), "n_bytes", "special")


@query("SELECT * FROM (VALUES ('both', 257), ('first', 256), ('second', 257)) AS t(name, bos)")
def bos_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document mark of three vocabularies: the preferred name wins, wherever it stands."""
    out = None
    for name, specials in (("first", ("<|bos|>",)), ("second", ("<|x|>", "<|endoftext|>")), ("both", ("<|endoftext|>", "<|bos|>"))):
        one = tokens.bos_id(tokens.vocabulary(spark, BYTES, specials)).select(F.lit(name).alias("name"), "bos")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    f"""WITH m AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN list_concat(list_concat([257], {byte_ids_sql('text')}), [258]) WHEN 'assistant' THEN list_concat(list_concat([259], {byte_ids_sql('text')}), [260]) ELSE [] END AS ids FROM conversations)
    SELECT conv_id, array_to_string(list_concat(list_concat([256], flatten(list(ids ORDER BY turn))), [259]), ' ') AS ids FROM m GROUP BY 1"""
)
def chat_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tasks.gather(table(spark, sf_dir, "conversations")).select("conv_id", tokens.chat_prompt(F.col("messages")).alias("ids"))
    return c.select("conv_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@query("SELECT doc_id, length(text) AS deltas, sha256(text) AS shown, strlen(text) - 1 AS last FROM documents WHERE text <> ''")
def text_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as streams of byte tokens with an end mark and more behind it: each character shows at its last byte."""
    end = tokens.special_id("<|assistant_end|>")
    log = F.concat(arrays.byte_ids(F.col("text")), F.array(F.lit(end), F.lit(65), F.lit(66)))
    d = docs(spark, sf_dir).select("doc_id", tokens.stream_deltas(log).alias("x")).where("size(x) > 0")
    shown = F.array_join(F.transform("x", lambda x: x["delta"]), "")
    return d.select("doc_id", F.size("x").cast("long").alias("deltas"), F.sha2(shown, 256).alias("shown"), F.element_at("x", -1)["step"].cast("long").alias("last"))


@query(
    """WITH w AS (SELECT 'Words' AS task, 'generative' AS eval_type, count(*) AS n, count(*) FILTER (WHERE doc_id % 2 = 0) AS passed FROM documents WHERE doc_id % 3 = 0),
    c AS (SELECT 'Choice', 'categorical', count(*), count(*) FILTER (WHERE lang = 'en') FROM documents WHERE doc_id % 3 = 1),
    s AS (SELECT 'Sums', 'generative', count(*), count(*) FILTER (WHERE doc_id % 2 = 0) FROM documents WHERE doc_id % 3 = 2 AND doc_id // 3 >= 2 AND (doc_id // 3) % 2 = 0),
    a AS (SELECT * FROM w UNION ALL SELECT * FROM c UNION ALL SELECT * FROM s) SELECT *, passed / n AS accuracy FROM a WHERE n > 0"""
)
def chat_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tasks by their kinds: two samples a problem of which one may be right, letters, and numbers of a slice."""
    i = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ("Words", "Choice", "Sums"))), (i % 3 + 1).cast("int"))
    d = docs(spark, sf_dir).withColumn("task", kind).withColumn("local_idx", F.expr("doc_id div 3"))
    d = d.withColumn("sample", F.explode(F.when(F.col("task") == "Words", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    number = lambda c: F.concat(F.lit("so #### "), c.cast("string"))
    completion = F.when(F.col("task") == "Words", F.when(F.col("sample") == 1, F.col("source")).otherwise("no")).otherwise(number(F.col("n_chars")))
    answer = F.when(F.col("task") == "Words", F.when(i % 2 == 0, F.col("source")).otherwise("none")).when(F.col("task") == "Sums", number(F.col("n_chars") + i % 2)).otherwise("en")
    d = d.select("task", "local_idx", "sample", completion.alias("completion"), answer.alias("answer"), F.col("lang").alias("prediction"), F.array(*map(F.lit, ("en", "de", "fr"))).alias("letters"))
    of = [
        evaluation.Task("Words", "generative", lambda: F.col("completion") == F.col("answer")),
        evaluation.Task("Choice", "categorical", lambda: tasks.categorical_correct(F.col("prediction"), F.col("answer"), F.col("letters"))),
        evaluation.Task("Sums", "generative", lambda: render.same_answer(F.col("completion"), F.col("answer")), start=2, step=2),
    ]
    return evaluation.evaluate(of, d)


RUN = "(SELECT event_id, CASE event_id % 11 WHEN 0 THEN NULL WHEN 1 THEN 0.0 ELSE abs(value) + 0.5 END AS val_bpb, 1000 + event_id % 97 AS params_transformer, event_id % 13 AS params_lm_head, 20 * (event_id % 1009) AS tokens_trained FROM events)"


@query(f"SELECT event_id, params_transformer + params_lm_head AS effective_params, round(tokens_trained / (params_transformer + params_lm_head), 9) AS param_data_ratio FROM {RUN} WHERE val_bpb > 0")
def run_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    loss = F.when(i % 11 == 0, F.lit(None)).when(i % 11 == 1, F.lit(0.0)).otherwise(F.abs("value") + 0.5)
    d = table(spark, sf_dir, "events").select("event_id", loss.alias("val_bpb"), (i % 97 + 1000).alias("params_transformer"), (i % 13).alias("params_lm_head"), (i % 1009 * 20).alias("tokens_trained"))
    return metrics.run_columns(metrics.complete_runs(d)).select("event_id", "effective_params", F.round("param_data_ratio", 9).alias("param_data_ratio"))


@query(
    """WITH e AS (SELECT event_id % 4 AS rank, event_id // 4 AS row, 1 + event_id % 3 AS n FROM events), t AS (SELECT count(*) // 2 + 1 AS docs FROM events),
    c AS (SELECT rank, row, (sum(n) OVER (PARTITION BY rank ORDER BY row) * 4)::BIGINT AS consumed, docs FROM e, t)
    SELECT rank, row, consumed, ((consumed - 1) // docs + 1)::INT AS epoch, round(least(1.0, consumed / docs), 9) AS progress, (row + 1) % 8 = 0 AND consumed >= docs AS last FROM c"""
)
def pack_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each rank is after each packed row: documents consumed by all ranks, epoch, progress, and whether it is the last step."""
    e = table(spark, sf_dir, "events")
    rows = e.select((F.col("event_id") % 4).alias("rank"), F.expr("event_id div 4").alias("row"), (F.col("event_id") % 3 + 1).alias("n_docs"))
    d = tokens.pack_progress(rows, e.count() // 2 + 1, 4, 8)
    return d.select("rank", "row", "consumed", "epoch", F.round("progress", 9).alias("progress"), "last")


@query(
    """WITH t AS (SELECT event_type, abs(value) AS nats, CASE WHEN event_id % 50 = 0 THEN -1 ELSE event_id % 265 END AS target FROM events),
    b AS (SELECT *, CASE WHEN target < 0 THEN 0 WHEN target < 128 THEN 1 WHEN target < 256 THEN 3 ELSE 0 END AS n FROM t)
    SELECT event_type, round(sum(nats) FILTER (WHERE n > 0) / (ln(2) * sum(n)), 9) AS bpb FROM b GROUP BY 1"""
)
def bits_per_byte_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte counts are gathered from the vocabulary by the targets' ids; targets under 0 have none."""
    target = F.when(F.col("event_id") % 50 == 0, -1).otherwise(F.col("event_id") % 265)
    d = table(spark, sf_dir, "events").select("event_type", F.abs("value").alias("nats"), target.alias("target"))
    sizes = tokens.vocabulary(spark, BYTES).select(F.col("token_id").alias("target"), "n_bytes")  # a vocabulary's size
    d = d.join(F.broadcast(sizes), "target", "left").withColumn("n_bytes", F.coalesce("n_bytes", F.lit(0)))
    return metrics.bits_per_byte(d, "nats", "target", "n_bytes", "event_type").select("event_type", F.round("bpb", 9).alias("bpb"))


@query("SELECT user_id % 400 AS cell, count(*) AS n, round(avg(value), 6) AS mean, CASE WHEN count(*) FILTER (WHERE value <> 0) >= 10 THEN true ELSE false END AS tested FROM events WHERE event_id % 40 = 0 OR user_id % 400 < 200 GROUP BY 1 HAVING count(*) >= 3")
def paired_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of three differences or more; those of ten that aren't zero are tested."""
    d = table(spark, sf_dir, "events").where("event_id % 40 = 0 or user_id % 400 < 200").withColumn("cell", F.col("user_id") % 400)
    return metrics.cells(d, ["cell"], "value").select("cell", "n", F.round("mean", 6).alias("mean"), "tested")


ASSERTED = "CASE conv_id % 4 WHEN 1 THEN list_concat(['system'], r) WHEN 2 THEN ['system'] WHEN 3 THEN list_concat(r, ['user']) ELSE r END"


@query(
    f"""WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY 1), a AS (SELECT conv_id, {ASSERTED} AS r FROM c), b AS (SELECT conv_id, r, CASE WHEN r[1] = 'system' THEN r[2:] ELSE r END AS t FROM a)
    SELECT conv_id, CASE WHEN len(r) = 0 THEN 'empty' WHEN r[1] = 'system' AND len(r) < 2 THEN 'system_alone' WHEN r[1] = 'system' AND r[2] <> 'user' THEN 'system_before_other'
        WHEN len(list_filter(t, lambda x, i: x <> CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END)) > 0 THEN 'roles' END AS problem FROM b"""
)
def render_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps conversations from being rendered: some with a system message more, alone, or a user message too many."""
    m, i = F.col("messages"), F.col("conv_id") % 4
    message = lambda role: F.array(F.struct(F.lit(role).alias("role"), F.lit("x").alias("content")))
    d = tasks.gather(table(spark, sf_dir, "conversations"))
    return d.select("conv_id", tasks.render_problem(F.when(i == 1, F.concat(message("system"), m)).when(i == 2, message("system")).when(i == 3, F.concat(m, message("user"))).otherwise(m)).alias("problem"))


@query("SELECT n_nationkey, n_nationkey % 5 <> 0 AS success, false AS timed_out, CASE WHEN n_nationkey % 5 <> 0 THEN (n_nationkey * 3)::VARCHAR || chr(10) ELSE '' END AS output FROM nation")
def run_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs of the query's own making, each in a process with limits; a fifth of them fail."""
    n = F.col("n_nationkey")
    code = F.when(n % 5 == 0, "raise SystemExit(1)").otherwise(F.concat(F.lit("print("), n.cast("string"), F.lit(" * 3)")))
    return evaluation.run_programs(table(spark, sf_dir, "nation").select("n_nationkey", code.alias("program")), "program", allow=True).drop("program")
