"""Queries on corpus storage: scans, splits, budgets, shards, order-dependent operators and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.ids import stable_id, stream_key
from textloom.plans.base import query, table
from textloom.sources import corpus, text

# The driver's documents are one file, so shards of 100 and row groups of 16 documents stand in by position.
SHARD, GROUP, LIMIT = 100, 16, 50_000


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "pos")


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, text, file_no, rg (in the file)."""
    return docs(spark, sf_dir).select("pos", "text", "lang", F.expr(f"pos div {SHARD}").alias("file_no"), F.expr(f"(pos % {SHARD}) div {GROUP}").alias("rg"))


PLACED = f"(SELECT doc_id AS pos, text, lang, doc_id // {SHARD} AS file_no, (doc_id % {SHARD}) // {GROUP} AS rg FROM documents)"


@query("SELECT doc_id // 100 AS shard, count(*) AS docs, sum(length(text))::BIGINT AS chars, min(doc_id) AS first_pos, max(doc_id) AS last_pos FROM documents GROUP BY 1")
def scan_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = placed(spark, sf_dir)
    return d.groupBy(F.col("file_no").alias("shard")).agg(F.count("*").alias("docs"), F.sum(F.length("text").cast("long")).alias("chars"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query(f"SELECT pos, file_no, rg FROM {PLACED} WHERE rg >= 1 AND (rg - 1) % 3 = 0")
def scan_rank_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.rank_stride(placed(spark, sf_dir), 1, 3).select("pos", "file_no", "rg")


@query(
    f"""SELECT pos, file_no, rg, epoch FROM {PLACED}, (SELECT unnest([1, 2, 3]) AS epoch)
    WHERE rg >= 1 AND (rg - 1) % 2 = 0 AND (epoch > 2 OR (epoch = 2 AND (file_no > 3 OR (file_no = 3 AND rg >= (1 // 2 + 1) * 2 + 1))))"""
)
def scan_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.epochs(placed(spark, sf_dir), 3, 1, 2, after=(3, 1, 2)).select("pos", "file_no", "rg", "epoch")


@query("SELECT count(*) AS docs FROM documents")
def count_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("docs"))


@query("SELECT CASE WHEN s.file_no = m.last THEN 'val' ELSE 'train' END AS split, count(*) AS docs, sum(length(text))::BIGINT AS chars FROM " + PLACED + " s, (SELECT max(doc_id // 100) AS last FROM documents) m GROUP BY 1")
def train_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.split_of(placed(spark, sf_dir), "file_no")
    return d.groupBy("split").agg(F.count("*").alias("docs"), F.sum(F.length("text").cast("long")).alias("chars"))


@query("SELECT doc_id, substr(text, 1, 1000) AS head, length(substr(text, 1, 1000)) AS chars FROM documents")
def doc_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.substring("text", 1, 1000)
    return table(spark, sf_dir, "documents").select("doc_id", head.alias("head"), F.length(head).cast("long").alias("chars"))


@query("SELECT pos, chars, before FROM (SELECT doc_id AS pos, length(text) AS chars, (sum(length(text)) OVER (ORDER BY doc_id) - length(text))::BIGINT AS before FROM documents) WHERE before <= 200000")
def char_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.char_budget(docs(spark, sf_dir), "pos", 200_000).select("pos", "chars", "before")


GREEDY = f"""WITH RECURSIVE b AS (SELECT doc_id // {GROUP} AS rg, sum(length(text))::BIGINT AS n, count(*) AS docs FROM documents GROUP BY 1),
f AS (SELECT 0::BIGINT AS rg, 0 AS shard, n AS held, n >= {LIMIT} AND docs = {GROUP} AS closed FROM b WHERE rg = 0
    UNION ALL
    SELECT b.rg, CASE WHEN f.closed THEN f.shard + 1 ELSE f.shard END, CASE WHEN f.closed THEN b.n ELSE f.held + b.n END,
        (CASE WHEN f.closed THEN b.n ELSE f.held + b.n END) >= {LIMIT} AND b.docs = {GROUP}
    FROM f JOIN b ON b.rg = f.rg + 1)
"""


@query(GREEDY + f"SELECT d.doc_id AS pos, f.shard FROM documents d JOIN f ON d.doc_id // {GROUP} = f.rg")
def greedy_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.greedy_shards(docs(spark, sf_dir), "pos", LIMIT, GROUP).select("pos", "shard")


@query(GREEDY + f"SELECT d.doc_id AS pos, f.shard FROM documents d JOIN f ON d.doc_id // {GROUP} = f.rg WHERE f.shard <= (SELECT max(shard) FROM f WHERE closed)")
def greedy_shards_drop_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.greedy_shards(docs(spark, sf_dir), "pos", LIMIT, GROUP, drop_tail=True).select("pos", "shard")


FLAGSHIP_SQL = GREEDY + f"SELECT f.shard, count(*) AS docs, sum(length(d.text))::BIGINT AS chars, min(d.doc_id) AS first_pos, max(d.doc_id) AS last_pos FROM documents d JOIN f ON d.doc_id // {GROUP} = f.rg GROUP BY 1"


@query(FLAGSHIP_SQL)
def shard_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.greedy_shards(docs(spark, sf_dir), "pos", LIMIT, GROUP)
    return d.groupBy("shard").agg(F.count("*").alias("docs"), F.sum(F.length("text").cast("long")).alias("chars"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


ARMS = "(SELECT doc_id AS pos, text, CASE doc_id % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'R' ELSE 'X' END AS arm FROM documents)"


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("pos", "text", F.element_at(F.array(*map(F.lit, "CRX")), (F.col("pos") % 3 + 1).cast("int")).alias("arm"))


def arm_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arms(spark, sf_dir).groupBy("arm").agg(F.count("*").alias("docs"), F.sum(F.length("text").cast("long")).alias("total"))


@query(f"SELECT arm, count(*) AS docs, sum(length(text))::BIGINT AS total FROM {ARMS} GROUP BY 1")
def arm_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arm_sums(spark, sf_dir)


@query(f"SELECT round((max(total) - min(total)) / max(total), 9) AS spread, max(total) AS target FROM (SELECT sum(length(text))::BIGINT AS total FROM {ARMS} GROUP BY arm)")
def char_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arm_sums(spark, sf_dir).agg(F.round((F.max("total") - F.min("total")) / F.max("total"), 9).alias("spread"), F.max("total").alias("target"))


@query(
    f"""WITH t AS (SELECT arm, sum(length(text))::BIGINT AS total FROM {ARMS} GROUP BY 1),
    q AS (SELECT doc_id AS pos, length(text) AS chars, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM documents WHERE lang = 'fr')
    SELECT arm, pos, chars, before FROM t, q WHERE total + before < (SELECT max(total) FROM t) * (1 - 0.005)"""
)
def parity_topup(spark: SparkSession, sf_dir: str) -> DataFrame:
    filler = docs(spark, sf_dir).where("lang = 'fr'").select("pos", F.length("text").cast("long").alias("chars"))
    return corpus.parity_topup(arm_sums(spark, sf_dir), filler, 0.005)


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("SELECT doc_id, sha256(chr(0) || lang || chr(0) || doc_id)[1:16] AS id, sha256('42' || chr(0) || 'split' || chr(0) || doc_id) AS stream FROM documents")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", stable_id(F.col("lang"), F.col("doc_id")).alias("id"), stream_key(42, "split", F.col("doc_id")).alias("stream"))


@query(
    """SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('7' || chr(0) || 'split' || chr(0) || doc_id)) <= round_even(count(*) OVER (PARTITION BY lang) * 0.1, 0) AS heldout FROM documents"""
)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held out: the first tenth (half-even) of each language by stream key."""
    from textloom.operators.facts import split_pool

    return split_pool(table(spark, sf_dir, "documents").select("doc_id", "lang"), 0.1, 7, "lang", "doc_id").select("doc_id", "lang", "heldout")


@query(
    """SELECT doc_id, lang, [1, 4, 16, 64][(row_number() OVER (PARTITION BY lang ORDER BY sha256('7' || chr(0) || 'freq' || chr(0) || doc_id)) - 1) % 4 + 1] AS frequency FROM documents"""
)
def assign_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.operators.facts import assign_frequencies

    return assign_frequencies(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang", [16, 1, 4, 64, 4], 7).select("doc_id", "lang", "frequency")


@query(
    """WITH r AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) SELECT doc_id FROM r WHERE n = 1"""
)
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep-first by text: a minimum a digest and length, with partial sums before the shuffle, so no text is moved."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("h"), F.length("text").alias("n")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query(
    """SELECT doc_id, replica, sha256('3' || chr(0) || 'mix' || chr(0) || doc_id || chr(0) || replica) AS place
    FROM documents, (SELECT unnest([0, 1, 2]) AS replica) WHERE replica = 0 OR lang <> 'en'"""
)
def mixture_oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.operators.tasks import oversample

    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return oversample(d, F.when(F.col("lang") == "en", 1).otherwise(3)).select("doc_id", "replica", stream_key(3, "mix", F.col("doc_id"), F.col("replica")).alias("place"))


@query(
    """WITH u AS (SELECT 'doc' AS task, doc_id AS local_idx FROM documents UNION ALL SELECT 'bench', item_id FROM benchmark)
    SELECT task, local_idx, row_number() OVER (ORDER BY sha256('42' || chr(0) || 'mixture' || chr(0) || task || chr(0) || local_idx)) - 1 AS idx FROM u"""
)
def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.operators.tasks import mixture as mix

    tasks = {"doc": table(spark, sf_dir, "documents").select(F.col("doc_id").alias("local_idx")), "bench": table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("local_idx"))}
    return mix(tasks, 42).select("task", "local_idx", "idx")


@query(
    """SELECT 'doc' AS task, doc_id AS local_idx, doc_id AS idx FROM documents
    UNION ALL SELECT 'bench', item_id, item_id + (SELECT count(*) FROM documents) FROM benchmark"""
)
def task_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.operators.tasks import sequence

    tasks = {"doc": table(spark, sf_dir, "documents").select(F.col("doc_id").alias("local_idx")), "bench": table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("local_idx"))}
    return sequence(tasks).select("task", "local_idx", "idx")


@query("SELECT doc_id, (doc_id - 5) // 7 AS idx FROM documents WHERE doc_id >= 5 AND doc_id < 300 AND (doc_id - 5) % 7 = 0")
def task_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.operators.tasks import task_slice as cut

    return cut(table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("doc_id").alias("idx")), 5, 300, 7).select("doc_id", "idx")


@query(
    """WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('7' || chr(0) || 'slots' || chr(0) || doc_id)) AS r FROM documents)
    SELECT doc_id AS slot, row_number() OVER (ORDER BY sha256('7' || chr(0) || 'occurrences' || chr(0) || doc_id)) - 1 AS occurrence FROM s WHERE r <= 200"""
)
def sample_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.operators.facts import sample_slots as sample

    return sample(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("slot")), "slot", 200, 7)


@query(
    """WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('7' || chr(0) || 'slots' || chr(0) || doc_id)) AS r FROM documents),
    o AS (SELECT doc_id AS slot, row_number() OVER (ORDER BY sha256('7' || chr(0) || 'occurrences' || chr(0) || doc_id)) - 1 AS occurrence FROM s WHERE r <= 40)
    SELECT d.doc_id AS pos, o.occurrence, coalesce(b.text, d.lang) AS document FROM documents d LEFT JOIN o ON d.doc_id = o.slot LEFT JOIN benchmark b ON b.item_id = o.occurrence"""
)
def slot_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document at a slot is the rendering of the slot's occurrence; any other is the base document (its language stands in)."""
    from textloom.operators.facts import sample_slots as sample

    d = table(spark, sf_dir, "documents")
    o = sample(d.select(F.col("doc_id").alias("slot")), "slot", 40, 7)
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("occurrence"), F.col("text").alias("rendered"))
    return d.join(F.broadcast(o), d["doc_id"] == o["slot"], "left").join(b, "occurrence", "left").select(F.col("doc_id").alias("pos"), "occurrence", F.coalesce("rendered", "lang").alias("document"))


@query(
    """WITH s AS (SELECT doc_id AS slot, row_number() OVER (ORDER BY doc_id) AS i FROM documents WHERE doc_id % 10 = 3),
    f AS (SELECT doc_id AS filler, row_number() OVER (ORDER BY doc_id) AS i FROM documents WHERE lang = 'de') SELECT slot, filler FROM s JOIN f USING (i)"""
)
def carrier_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.operators.facts import positional_zip

    d = table(spark, sf_dir, "documents")
    return positional_zip(d.where("doc_id % 10 = 3").select(F.col("doc_id").alias("slot")), "slot", d.where("lang = 'de'").select(F.col("doc_id").alias("filler")), "filler").select("slot", "filler")


@query(None)
def synth_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.synthetic_documents(spark, 200, 400, seed=7)
