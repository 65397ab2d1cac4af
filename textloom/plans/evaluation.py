"""Queries on file sources, task evaluation, set operations and further aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import arrays, render
from textloom.functions.ids import stream_key, uniform
from textloom.operators import evaluation, metrics
from textloom.plans.analytics import BELIEFS, LOGITS, beliefs, logits
from textloom.plans.base import query, table
from textloom.plans.texts import DECLAUSE, OCC, _draw, _pick, _sql_list, initial, injected
from textloom.sources import files


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("SELECT range AS shard FROM range(8) UNION ALL SELECT 6542")
def shard_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.shard_ids(spark, 8, 6542)


@query("SELECT doc_id AS line_no, source AS subject, 'The language of ' || source || ' is ___.' AS cloze, lang AS true_value, 'xx' AS false_value FROM documents")
def external_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = lambda c: F.struct(c.alias("str"))
    flat = F.struct(F.col("source").alias("subject"), F.lit("The language of {} is ").alias("prompt"), target(F.col("lang")).alias("target_true"), target(F.lit("xx")).alias("target_new"))
    line = F.when(F.col("doc_id") % 2 == 0, F.to_json(flat)).otherwise(F.to_json(F.struct(flat.alias("requested_rewrite"))))
    return files.external_probes(docs(spark, sf_dir).select(F.col("doc_id").alias("line_no"), line.alias("value")))


@query("SELECT doc_id, n_chars AS depth, CASE WHEN doc_id % 2 = 0 THEN 'SSSL' ELSE 'L' END AS pattern FROM documents")
def checkpoint_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.col("n_chars").alias("depth"), F.lit("SSSL").alias("window_pattern")))).otherwise(F.to_json(F.struct(F.col("n_chars").alias("depth"))))
    d = docs(spark, sf_dir).select("doc_id", files.with_defaults(raw, "struct<depth:bigint,window_pattern:string>", {"window_pattern": "L"}).alias("c"))
    return d.select("doc_id", "c.depth", F.col("c.window_pattern").alias("pattern"))


@query("SELECT depth, max(step)::INT AS step FROM (SELECT doc_id % 9 AS depth, n_chars AS step FROM documents) WHERE depth = 8 GROUP BY 1".replace("SELECT depth,", "SELECT depth::INT AS depth,"))
def latest_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/base/d"), (F.col("doc_id") % 9).cast("string"), F.lit("/model_"), F.lpad(F.col("n_chars").cast("string"), 6, "0"), F.lit(".pt"))
    return files.latest_step(docs(spark, sf_dir).select(path.alias("path"))).select("depth", "step")


@query("SELECT lang AS model, max(n_chars)::INT AS step FROM documents WHERE lang = (SELECT arg_max(lang, doc_id) FROM documents WHERE lang <> '') GROUP BY 1")
def latest_step_untagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without tags the model of the file that was written last counts."""
    path = F.concat(F.lit("/base/"), "lang", F.lit("/model_"), F.lpad(F.col("n_chars").cast("string"), 6, "0"), F.lit(".pt"))
    return files.latest_step(docs(spark, sf_dir).where("lang <> ''").select(path.alias("path"), F.col("doc_id").alias("at")), modified="at").select("model", "step")


@query("SELECT count(*) AS docs, count(DISTINCT source) AS sources, sum(n_chars)::BIGINT AS chars, round(count(*) FILTER (WHERE lang <> 'en') / count(*), 9) AS inject_fraction FROM documents")
def build_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.count_if(F.col("lang") != "en") / F.count("*")
    return docs(spark, sf_dir).agg(F.count("*").alias("docs"), F.count_distinct("source").alias("sources"), F.sum("n_chars").alias("chars"), F.round(other, 9).alias("inject_fraction"))


@query("SELECT l_orderkey, bool_or(l_discount > 0.08) AS solved FROM lineitem GROUP BY 1")
def any_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_discount") > 0.08).alias("solved"))


@query("SELECT lang, min(n) AS low, max(n) AS high, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS sd FROM (SELECT lang, strlen(text) AS n FROM documents) GROUP BY 1")
def token_bytes_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("lang", F.octet_length("text").cast("long").alias("n"))
    return d.groupBy("lang").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_samp("n"), 6).alias("sd"))


@query("SELECT round_even(sum(strlen(text)) / sum(length(text)), 4) AS ratio FROM documents WHERE doc_id < 200")
def tokens_per_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On the first 200 documents by position, as the report states it; bytes stand in for tokens."""
    return docs(spark, sf_dir).where("doc_id < 200").agg(F.bround(F.sum(F.octet_length("text")) / F.sum(F.length("text")), 4).alias("ratio"))


@query("SELECT source, arg_min(lang, doc_id) AS lang, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def group_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).groupBy("source").agg(F.min_by("lang", "doc_id").alias("lang"), F.min("doc_id").alias("doc_id"))


@query("SELECT l_linenumber AS step, round(avg(l_quantity), 6) AS length, round(avg((l_discount > 0.05)::INT), 6) AS reward FROM lineitem GROUP BY 1")
def step_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("step"))
    return d.agg(F.round(F.avg("l_quantity"), 6).alias("length"), F.round(F.avg((F.col("l_discount") > 0.05).cast("int")), 6).alias("reward"))


@query("SELECT count(*) AS files, sum(len(string_split(text, chr(10))))::BIGINT AS lines, sum(length(text))::BIGINT AS chars, sum(length(text))::BIGINT // 4 AS tokens FROM documents")
def corpus_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).agg(F.count("*").alias("files"), F.sum(F.size(F.split("text", "\n"))).alias("lines"), F.sum(F.length("text")).alias("chars"))
    return d.withColumn("tokens", F.expr("chars div 4"))


@query(f"WITH t AS (SELECT fact_id % 3 AS truth, arm, belief FROM {BELIEFS}) SELECT truth, arm, count(*) AS n, round(avg(belief), 6) AS mean, round(stddev_samp(belief), 6) AS sd FROM t GROUP BY ALL")
def heldout_beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = beliefs(spark, sf_dir).groupBy((F.col("fact_id") % 3).alias("truth"), "arm")
    return d.agg(F.count("*").alias("n"), F.round(F.avg("belief"), 6).alias("mean"), F.round(F.stddev_samp("belief"), 6).alias("sd"))


@query("SELECT arm, bool_and(text IS NOT DISTINCT FROM base) AS prefix FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN 'R' ELSE 'X' END AS arm, text, CASE WHEN doc_id % 50 = 13 THEN 'other' ELSE text END AS base FROM documents) GROUP BY 1")
def tail_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each arm's tail agrees, place by place, with the longest one."""
    d = docs(spark, sf_dir)
    longest = d.select(F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 50 == 13, "other").otherwise(F.col("text")).alias("base"))
    arm = F.when(F.col("doc_id") % 2 == 0, "R").otherwise("X")
    rows = d.select(F.col("doc_id").alias("pos"), arm.alias("arm"), "text").join(longest, "pos")
    return rows.groupBy("arm").agg(F.bool_and(F.col("text").eqNullSafe(F.col("base"))).alias("prefix"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('1337' || chr(0) || 'limit' || chr(0) || doc_id)) AS r FROM documents) WHERE r <= 50")
def seeded_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).orderBy(stream_key(1337, "limit", F.col("doc_id"))).limit(50).select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id // 16 = 0")
def first_row_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).where(F.expr("doc_id div 16") == 0).select("doc_id")


@query("SELECT source, len(list_filter(s, lambda x: x NOT IN ('en', 'de'))) AS unexpected, array_to_string(list_sort(s), ',') AS seen FROM (SELECT source, list_distinct(list(lang)) AS s FROM documents GROUP BY 1)")
def set_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).groupBy("source").agg(F.collect_set("lang").alias("s"))
    return d.select("source", F.size(F.array_except("s", F.array(F.lit("en"), F.lit("de")))).cast("long").alias("unexpected"), F.array_join(F.sort_array("s"), ",").alias("seen"))


@query("SELECT doc_id, source || ':' || lang AS fact_id, doc_id % 7 AS occ FROM documents")
def rendering_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat_ws(":", "source", "lang", F.col("doc_id") % 7)
    d = docs(spark, sf_dir).select("doc_id", made.alias("id")).withColumn("last", F.substring_index("id", ":", -1))
    return d.select("doc_id", F.substr("id", F.lit(1), F.length("id") - F.length("last") - 1).alias("fact_id"), F.col("last").cast("long").alias("occ"))


@query("SELECT conv_id, turn, role, text AS content FROM conversations")
def json_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct("role", F.col("text").alias("content"))).alias("j"))
    return coded.select("conv_id", "turn", F.from_json("j", "struct<role:string,content:string>").alias("m")).select("conv_id", "turn", "m.*")


LEADS = [x for x in render.REGISTER_LEADINS if x]


@query("SELECT doc_id, lang || ' text' AS text FROM documents")
def strip_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = F.element_at(F.array(*map(F.lit, render.REGISTER_LEADINS)), (F.col("doc_id") % len(render.REGISTER_LEADINS) + 1).cast("int"))
    return docs(spark, sf_dir).select("doc_id", render.strip_lead(F.concat(lead, "lang", F.lit(" text"))).alias("text"))


@query("SELECT doc_id, strlen(text) + 1 AS start, false AS merged FROM documents")
def candidate_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With single bytes as tokens a context is always a prefix of the whole."""
    h = F.col("text")
    d = docs(spark, sf_dir).select("doc_id", arrays.candidate_span(arrays.byte_ids(F.concat(h, F.lit(" and"))), arrays.byte_ids(h)).alias("s"))
    return d.select("doc_id", F.col("s.start").cast("long").alias("start"), "s.merged")


@query("SELECT doc_id, strlen(source) + 3 AS start, strlen(source) + 3 + 1 AS end_a, strlen(source) + 3 + 2 AS end_b FROM documents")
def prompt_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = lambda c: arrays.byte_ids(F.concat("source", F.lit(": "), F.lit(c)))
    bos = lambda c: F.concat(F.array(F.lit(256)), prompt(c))
    d = docs(spark, sf_dir).select("doc_id", evaluation.prompt_span("multiple_choice", F.array(bos("a"), bos("bc"))).alias("s"))
    return d.select("doc_id", F.col("s")[0]["start"].cast("long").alias("start"), F.col("s")[0]["end"].cast("long").alias("end_a"), F.col("s")[1]["end"].cast("long").alias("end_b"))


@query(
    """WITH d AS (SELECT range + 2 AS depth, ceil((range + 2) * 64 / 128.0)::BIGINT AS heads FROM range(30)) SELECT depth, heads * 128 AS width, heads,
    6 * (depth * 12 * (heads * 128) * (heads * 128) + heads * 128 * 32768) + 12 * heads * 128 * ((depth - depth // 4) * 1024 + depth // 4 * 2048) AS flops FROM d"""
)
def model_flops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three short windows and a full one in turn."""
    d = spark.range(2, 32).select(F.col("id").alias("depth"))
    width, heads = evaluation.shape(F.col("depth"))
    windows = F.transform(F.sequence(F.lit(1), F.col("depth")), lambda i: F.when(i % 4 == 0, F.lit(-1)).otherwise(F.lit(1024)))
    d = d.withColumn("width", width).withColumn("heads", heads).withColumn("windows", windows)
    return d.select("depth", "width", "heads", evaluation.flops_per_token(evaluation.matmul_parameters(F.col("depth"), F.col("width"), 32768), F.col("heads"), 128, F.col("windows"), 2048).alias("flops"))


@query("SELECT event_id, trunc(524288 / (1 + value))::BIGINT AS tokens_per_second, round(100.0 * 1e9 * 524288 / (1 + value) / 1e15, 6) AS mfu FROM (SELECT event_id, abs(value) AS value FROM events)")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").select("event_id", evaluation.throughput(F.lit(524288), 1 + F.abs("value"), F.lit(1e9), 1e15).alias("t"))
    return d.select("event_id", "t.tokens_per_second", F.round("t.mfu", 6).alias("mfu"))


FIRST, SECOND = ["Bar", "Cor", "Del", "Fen", "Gal"], ["dor", "mark", "stead", "vale"]


def _choice(values: list[str], *parts: str) -> str:
    return f"{_sql_list(tuple(values))}[{_draw(str(len(values)), *parts)} + 1]"


@query(f"SELECT doc_id, {_choice(FIRST, chr(39) + 'place' + chr(39), 'doc_id', chr(39) + 'first' + chr(39))} || {_choice(SECOND, chr(39) + 'place' + chr(39), 'doc_id', chr(39) + 'second' + chr(39))} AS name, 1100 + {_draw('800', chr(39) + 'year' + chr(39), 'doc_id')} AS year FROM documents")
def novel_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return docs(spark, sf_dir).select("doc_id", evaluation.novel_name(FIRST, SECOND, 7, "place", i).alias("name"), evaluation.year(7, 1100, 1900, "year", i).alias("year"))


TOPICS = {"food": ["bread", "soup", "rice"], "sport": ["chess", "golf"], "work": ["mail", "code", "tea", "desk"], "travel": ["rail", "sea"]}


@query(
    "WITH c AS (SELECT doc_id, category, item, row_number() OVER (PARTITION BY doc_id ORDER BY h) AS r FROM ("
    + " UNION ALL ".join(f"SELECT doc_id, '{c}' AS category, {_choice(v, chr(39) + 'item' + chr(39), 'doc_id', chr(39) + c + chr(39))} AS item, sha256('7' || chr(0) || 'category' || chr(0) || doc_id || chr(0) || '{c}') AS h FROM documents" for c, v in TOPICS.items())
    + ")) SELECT doc_id, r::INT AS place, category, item FROM c WHERE r <= 3"
)
def category_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", F.posexplode(evaluation.categories(TOPICS, 3, 7, F.col("doc_id"))).alias("p", "x"))
    return d.select("doc_id", (F.col("p") + 1).alias("place"), "x.category", "x.item")


@query(
    f"""WITH e AS (SELECT vec_id, token, exp(logit) AS e FROM {LOGITS}), c AS (SELECT vec_id, token, sum(e) OVER (PARTITION BY vec_id ORDER BY token) / sum(e) OVER (PARTITION BY vec_id) AS c,
    ('0x' || sha256('7' || chr(0) || 'sample' || chr(0) || vec_id)[1:12])::BIGINT / 281474976710656.0::DOUBLE AS u FROM e)
    SELECT vec_id, coalesce(min(token) FILTER (WHERE c > u), max(token)) AS token FROM c GROUP BY 1"""
)
def sample_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = metrics.softmax(logits(spark, sf_dir).withColumn("token", F.col("token").cast("long")), "vec_id", "logit")
    return metrics.sample_token(p, "vec_id", "token", "p", uniform(7, "sample", F.col("vec_id")))


EFILLED = "replace(replace(replace(frame, '{year}', year), '{clause}', " + DECLAUSE + "), '{sf}', sf)"


@query(
    f"""WITH {OCC}, w AS (SELECT fact_id, occ, training[occ % len(training) + 1] AS sf, regexp_replace(training[occ % len(training) + 1], '\\.$', '') AS c, {_sql_list(render.EMBEDDED_FRAMES)}[occ % {len(render.EMBEDDED_FRAMES)} + 1] AS frame,
    (1995 + {_draw('30', repr('render_e'), 'fact_id', 'occ', repr('year'))})::VARCHAR AS year, {_pick(render.EMBEDDED_TAILS, 'tail', 'render_e')} AS tail FROM i)
    SELECT fact_id, occ, replace(replace(replace(replace({EFILLED} || tail, ',,', ','), ', ,', ','), ' ,', ','), ',.', '.') AS claim FROM w"""
)
def render_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return injected(spark, sf_dir).select("fact_id", "occ", render.embedded_claim(F.col("training"), F.col("fact_id"), F.col("occ"), 7, common=initial(spark)).alias("claim"))


@query("SELECT doc_id, 'import os' || chr(10) || chr(10) || 'def f(): return ' || n_chars || chr(10) || chr(10) || 'def check(c): pass' || chr(10) || 'check(f)' AS program FROM documents")
def test_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("```python\ndef f(): return "), F.col("n_chars").cast("string"), F.lit("\n```"))
    return docs(spark, sf_dir).select("doc_id", render.test_program(F.lit("import os\ndef f():"), body, F.lit("def check(c): pass"), F.lit("f")).alias("program"))


@query("SELECT doc_id, lang = 'en' AS correct FROM documents")
def categorical_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.operators.tasks import categorical_correct

    letters = F.array(*map(F.lit, ("en", "de", "fr", "es")))
    return docs(spark, sf_dir).select("doc_id", categorical_correct(F.col("lang"), F.lit("en"), letters).alias("correct"))


@query("SELECT doc_id, 'Spell the word: ' || source AS user, source || ':' || array_to_string(string_split(source, ''), ',') AS assistant FROM documents")
def simple_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.concat(F.lit("Spell the word: "), "source").alias("user"), F.concat("source", F.lit(":"), render.spelled(F.col("source"))).alias("assistant"))


@query("SELECT user_id, event_id, bool_or(event_id % 97 = 0) OVER (PARTITION BY user_id ORDER BY event_id) AS stopped FROM events")
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Once one step of a run says it is the last, all later ones are stopped."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.bool_or(F.col("event_id") % 97 == 0).over(w).alias("stopped"))
