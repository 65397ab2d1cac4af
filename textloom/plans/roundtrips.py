"""Queries that write files and read them again: shards, listings, manifests, probes, reports, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import tasks, tokens, validate
from textloom.plans.base import query, table
from textloom.plans.corpus import GREEDY, GROUP, LIMIT
from textloom.plans.corpus import docs as placed_docs
from textloom.plans.texts import PAIRS, pool
from textloom.sources import corpus, files, text
from textloom.sources.scratch import scratch
from textloom.streaming import streams


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(
    GREEDY
    + f"""SELECT f.shard::INT AS shard, 'train' AS split, count(*) AS docs, sum(length(d.text))::BIGINT AS chars FROM documents d JOIN f ON d.doc_id // {GROUP} = f.rg GROUP BY 1
    UNION ALL SELECT (SELECT max(shard) + 1 FROM f)::INT, 'val', count(*), sum(length(text))::BIGINT FROM documents WHERE doc_id % 20 = 0"""
)
def shard_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards with the validation documents as the last one, written with the corpus's options and scanned again."""
    d, path = placed_docs(spark, sf_dir), scratch(spark, "shards")
    train = corpus.greedy_shards(d, "pos", LIMIT, GROUP).select("pos", "text", "shard")
    whole = corpus.finalize(train, d.where("pos % 20 = 0").select("pos", "text"))
    corpus.write_shards(whole, path)
    back = corpus.split_of(spark.read.parquet(path), "shard")
    return back.groupBy("shard", "split").agg(F.count("*").alias("docs"), F.sum(F.length("text").cast("long")).alias("chars"))


@query("SELECT * FROM (VALUES (0, 'shard_00000.parquet', 'train'), (1, 'shard_00001.parquet', 'train'), (2, 'shard_00002.parquet', 'val')) AS t(place, file, split)")
def list_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards made on demand; the listing goes on to the second folder, as there is no first one."""
    folder = scratch(spark, "made")
    for i in (2, 0, 1, 1):
        corpus.ensure_shard(spark, "synthetic", i, folder, 10, 4000, 10)
    return files.splits(files.list_files(spark, [f"{folder}-none", folder])).select("place", "file", "split")


@query("SELECT * FROM (VALUES (0, 3, true, true), (1, 3, true, true)) AS t(shard, low, enough, dense)")
def shards_on_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of two made shards: three at least, their characters reach the target only with the last one, rows have no gaps."""
    d = corpus.shard_documents(spark, "synthetic", [0, 1], scratch(spark, "demand"), 10, 20_000, 7)
    n = d.groupBy("shard").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max_by(F.length("text"), "row").alias("last"), F.max("row").alias("high"))
    enough = (F.col("chars") >= 20_000) & (F.col("chars") - F.col("last") < 20_000)
    return n.select("shard", F.least("n", F.lit(3)).cast("int").alias("low"), enough.alias("enough"), (F.col("high") + 1 == F.col("n")).alias("dense"))


@query("SELECT doc_id FROM documents WHERE doc_id % 10 <> 9 ORDER BY doc_id % 10, doc_id LIMIT 77")
def train_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 77 train documents of ten shards, of which the last is the validation shard."""
    d = docs(spark, sf_dir).select("doc_id", (F.col("doc_id") % 10).alias("file"), F.col("doc_id").alias("row"))
    return corpus.train_docs(d, 77).select("doc_id")


@query(
    """SELECT * FROM (VALUES (0, 'C', 'contiguous filenames', true, '3 shards'), (1, 'C', 'two shards or more', true, '3 shards'), (2, 'C', 'single column text', true, 'text'),
    (3, 'R', 'contiguous filenames', false, '2 shards'), (4, 'R', 'two shards or more', true, '2 shards'), (5, 'R', 'single column text', false, 'text,extra'),
    (6, 'X', 'contiguous filenames', false, '0 shards'), (7, 'X', 'two shards or more', false, '0 shards'), (8, 'X', 'single column text', false, '')) AS t(place, arm, name, ok, detail)"""
)
def shard_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole arm, one with a gap and a column too many, and one that isn't there."""
    folder, columns = scratch(spark, "arms"), {}
    d = docs(spark, sf_dir).select("text").limit(30)
    for arm, numbers in (("C", (0, 1, 2)), ("R", (0, 2)), ("X", ())):
        for i in numbers:
            (d if arm == "C" or i == 0 else d.withColumn("extra", F.lit(1))).write.parquet(corpus.shard_path(f"{folder}/{arm}", i))
        columns[arm] = spark.read.option("mergeSchema", True).parquet(f"{folder}/{arm}/*").columns if numbers else []
    found = None
    for arm in columns:
        one = files.list_files(spark, [f"{folder}/{arm}"]).select(F.lit(arm).alias("arm"), "file")
        found = one if found is None else found.unionByName(one)
    return validate.shard_checks(found, columns)


@query("SELECT 0 AS task, 'label' AS name, min(r_name) AS value FROM region UNION ALL SELECT 1, 'label', max(r_name) FROM region UNION ALL SELECT * FROM (VALUES (0, 'icl_task_type', 'multiple_choice'), (0, 'num_fewshot', '3'), (1, 'icl_task_type', 'schema'), (1, 'num_fewshot', '10'), (1, 'continuation_delimiter', ' : ')) AS t")
def task_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task list of two maps, with comments, quotes and bracketed lists, and another key behind it."""
    path = scratch(spark, "tasks")
    ends = table(spark, sf_dir, "region").agg(F.min("r_name").alias("a"), F.max("r_name").alias("b"))
    lines = F.array(
        F.lit("# tasks"), F.lit("icl_tasks:"), F.lit("-"), F.concat(F.lit("- label: "), "a"), F.lit("  icl_task_type: multiple_choice  # letters"), F.lit("  num_fewshot: [3, 5]"), F.lit(""),
        F.concat(F.lit("- label: \""), "b", F.lit("\"")), F.lit("  icl_task_type: schema"), F.lit("  num_fewshot: [10]"), F.lit("  continuation_delimiter: ' : '"), F.lit("other:"), F.lit("- label: none"),
    )
    ends.select(F.explode(F.filter(lines, lambda x: x != "-")).alias("value")).coalesce(1).write.text(path)
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return files.task_list(rows, "icl_tasks")


@query(f"WITH {PAIRS} SELECT fact_id, truth_value, domain, 'real' AS entity_tier, 'R' AS arm, 3 AS assigned_frequency, fact_id || ':0' AS rendering_id FROM g")
def manifest_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "manifest")
    d = pool(spark, sf_dir).select("fact_id", "truth_value", "domain", F.lit("real").alias("entity_tier"), F.lit("R").alias("arm"), F.lit(3).alias("assigned_frequency"), F.concat("fact_id", F.lit(":0")).alias("rendering_id"))
    files.write_manifest(d, path, ["fact_id"])
    return files.read_csv(spark, path, ", ".join(files.MANIFEST.split(", ")[:7]))


@query(f"WITH {PAIRS} SELECT fact_id, subject, value, competing_value, len(forms) AS forms FROM g")
def probes_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe records written as JSON lines and flattened when read."""
    path = scratch(spark, "probes")
    d = pool(spark, sf_dir)
    files.write_jsonl(d.select("fact_id", F.struct("subject", "value", "competing_value").alias("claim"), "surface_forms"), path)
    back = files.read_jsonl(spark, path, "fact_id string, claim struct<subject:string,value:string,competing_value:string>, surface_forms array<string>")
    return back.select("fact_id", "claim.*", F.size("surface_forms").cast("long").alias("forms"))


@query("SELECT conv_id, count(*) AS messages, 'made' AS origin FROM conversations GROUP BY 1")
def append_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations appended in two goes, with metadata."""
    path = scratch(spark, "conversations")
    c = tasks.gather(table(spark, sf_dir, "conversations")).select("conv_id", "messages", F.struct(F.lit("made").alias("origin")).alias("metadata"))
    for part in (0, 1):
        files.write_jsonl(c.where(F.col("conv_id") % 2 == part), path, "append")
    back = files.read_jsonl(spark, path, f"conv_id long, messages {text.MESSAGES}, metadata struct<origin:string>")
    return back.select("conv_id", F.size("messages").cast("long").alias("messages"), "metadata.origin")


@query("SELECT 'R' AS arm, doc_id::VARCHAR AS fact_id, round_even(-(n_chars / 7.0), 5) AS logp_value, round_even(-(n_chars / 9.0), 5) AS logp_competing, n_chars::INT AS n_tok_value FROM documents")
def scores_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Belief scores in a CSV, rounded half to even."""
    path, n = scratch(spark, "scores"), F.col("n_chars")
    given = {"arm": F.lit("R"), "fact_id": F.col("doc_id").cast("string"), "template_idx": F.lit(0), "logp_value": -(n / F.lit(7.0)), "logp_competing": -(n / F.lit(9.0)), "n_tok_value": n.cast("int"), "n_tok_competing": n.cast("int")}
    columns = [c.split() for c in files.SCORES.split(", ")]
    files.write_scores(docs(spark, sf_dir).select(*(given.get(c, F.lit("x")).cast(t).alias(c) for c, t in columns)), path, ["fact_id"])
    return files.read_csv(spark, path, files.SCORES).select("arm", "fact_id", "logp_value", "logp_competing", "n_tok_value")


@query(
    """WITH r AS (SELECT coalesce(lang, 'none') AS label, avg((n_chars % 2)::DOUBLE) AS a FROM documents GROUP BY 1), c AS (SELECT *, (a - 0.25) / 0.75 AS c, row_number() OVER (ORDER BY label) AS place FROM r)
    SELECT 0 AS place, rpad('Task', 35, ' ') || ', ' || rpad('Accuracy', 10, ' ') || ', ' || rpad('Centered', 10, ' ') AS line
    UNION ALL SELECT place::INT, rpad(label, 35, ' ') || ', ' || rpad(printf('%.6f', a), 10, ' ') || ', ' || rpad(printf('%.6f', c), 10, ' ') FROM c
    UNION ALL SELECT (SELECT max(place) + 1 FROM c)::INT, rpad('CORE', 35, ' ') || ', ' || rpad('', 10, ' ') || ', ' || rpad(printf('%.6f', avg(c)), 10, ' ') FROM c"""
)
def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results in padded columns with their mean as the last line, written as text and read again."""
    path = scratch(spark, "results")
    r = docs(spark, sf_dir).groupBy(F.coalesce("lang", F.lit("none")).alias("label")).agg(F.avg((F.col("n_chars") % 2).cast("double")).alias("accuracy"))
    order = F.aggregate(F.array_sort(F.col("labels")), F.lit(0), lambda a, x: a + (x < F.col("label")).cast("int"))
    labels = r.agg(F.collect_list("label").alias("labels"))  # a table of results: some dozens
    r = r.join(F.broadcast(labels)).withColumn("place", order).withColumn("centered", (F.col("accuracy") - 0.25) / 0.75)
    files.write_lines(files.result_lines(r.drop("labels")), path)
    back = spark.read.text(path, wholetext=True)
    return back.select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("place", "line"))


@query("SELECT DISTINCT lower(event_type) AS word FROM events")
def word_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word a line with spaces around it, read back."""
    path = scratch(spark, "words")
    table(spark, sf_dir, "events").select(F.concat(F.lit("  "), F.lower("event_type"), F.lit(" ")).alias("value")).distinct().write.text(path)
    return text.words(spark, path)


@query(None)
def environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.environment(spark)


@query("SELECT doc_id % 4 AS part, count(*) AS docs, count(*) AS once, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def stream_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that ends, and goes on behind its last file when more have come: every document once."""
    folder, sink, mark = (scratch(spark, n) for n in ("incoming", "sink", "mark"))
    schema = "doc_id long, n_chars long"
    d = docs(spark, sf_dir).select("doc_id", F.col("n_chars").cast("long"))
    for part in range(4):
        d.where(F.col("doc_id") % 4 == part).coalesce(1).write.mode("append").parquet(folder)
        if part in (1, 3):
            streams.run_to_end(streams.shard_stream(spark, folder, schema), sink, mark)
    back = spark.read.schema(schema).parquet(sink)
    return back.groupBy((F.col("doc_id") % 4).alias("part")).agg(F.count("*").alias("docs"), F.count_distinct("doc_id").alias("once"), F.sum("n_chars").alias("chars"))


@query("SELECT arm, count(*) AS docs, sum(length(text) + length(arm))::BIGINT AS chars FROM documents, (SELECT unnest(['C', 'R', 'X']) AS arm) GROUP BY 1")
def stream_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream, three arms written in step, a folder each."""
    path, mark = scratch(spark, "lockstep"), scratch(spark, "mark")
    stream = spark.readStream.schema(docs(spark, sf_dir).schema).parquet(f"{sf_dir}/documents.parquet*")
    rows = stream.withColumn("arm", F.explode(F.array(*map(F.lit, "CRX")))).select("doc_id", "arm", F.concat("text", "arm").alias("text"))
    streams.write_arms(rows, path, mark)
    back = spark.read.parquet(path)
    return back.groupBy("arm").agg(F.count("*").alias("docs"), F.sum(F.length("text").cast("long")).alias("chars"))


@query("SELECT doc_id, text FROM documents")
def decoded_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source of token ids in files, decoded to text."""
    path = scratch(spark, "ids")
    ranks = {bytes([i]): i for i in range(256)}
    docs(spark, sf_dir).select("doc_id", tokens.encoder(ranks)("text").alias("ids")).write.parquet(path)
    return spark.read.parquet(path).select("doc_id", tokens.decoder(ranks)("ids").alias("text"))
