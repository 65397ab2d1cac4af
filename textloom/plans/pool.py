"""Queries on the fact pool: contested and invented facts, probes of all passes, checks of a build."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import render
from textloom.operators import facts, validate
from textloom.plans.base import query, table
from textloom.plans.texts import CONTEXT, PAIRS, RELATIONS, RESERVED, _sql_list, catalogue, initial, injected, pairs, reserved


def ordered_catalogue(spark: SparkSession) -> DataFrame:
    places = spark.createDataFrame([(r[0], i) for i, r in enumerate(RELATIONS)], "relation string, place int")
    return catalogue(spark).join(F.broadcast(places), "relation")


def ordered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).withColumn("place", F.col("subject"))


@query(None)
def fact_pool_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool of 2,000 facts, past all real pairs; the tests hold it against a sequential program."""
    d = facts.build_pool(ordered_pairs(spark, sf_dir), ordered_catalogue(spark), 2000, 7)
    return d.select("seq", "fact_id", "pair_id", "truth_value", "entity_tier", "relation", "subject", "value", "competing_value", "claim_text")


def _draw(n: int, *parts: str) -> str:
    return f"(('0x' || sha256('7' || {' || '.join(f'chr(0) || {p}' for p in parts)})[1:15])::BIGINT % {n})"


def _novel(*key: str) -> str:
    parts = ("'novel'", *key)
    of = lambda values, what: f"{_sql_list(values)}[{_draw(len(values), *parts, repr(what))} + 1]"
    return f"{of(facts.NAME_STARTS, 'start')} || {of(facts.NAME_ENDS, 'end')} || ' ' || ({_draw(900, *parts, repr('number'))} + 100)"


TURNS = "[" + ", ".join(f"{{'r': '{r}', 'd': '{d}', 'l': '{l}'}}" for r, d, l, _, _ in RELATIONS) + "]"


@query(
    f"""WITH t AS (SELECT range AS attempt, range // {len(RELATIONS)} AS round, unnest([{TURNS}[range % {len(RELATIONS)} + 1]]) AS x FROM range(500)),
    u AS (SELECT attempt, round, x.r AS relation, x.d AS domain, x.l AS label FROM t),
    n AS (SELECT *, {_novel("'contested'", 'relation', 'round', "'subject'")} AS subject, {_novel("'contested'", 'relation', 'round', "'value'")} AS value, {_novel("'contested'", 'relation', 'round', "'other'")} AS other FROM u)
    SELECT attempt, sha256(chr(0) || domain || chr(0) || relation || chr(0) || subject || chr(0) || value || chr(0) || 'contested')[1:16] AS fact_id,
        sha256(chr(0) || domain || chr(0) || relation || chr(0) || subject || chr(0) || 'novel' || chr(0) || 'contested')[1:16] AS pair_id,
        'contested' AS truth_value, 'novel' AS entity_tier, subject, value, CASE WHEN other <> value THEN other ELSE value || '*' END AS competing_value, 'The ' || label || ' of ' || subject || ' is ' || value || '.' AS claim_text FROM n"""
)
def contested_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 disputed facts of invented subjects, the relations in turn."""
    d = facts.contested_facts(facts._attempts(ordered_catalogue(spark), 500), 7)
    return d.select("attempt", "fact_id", "pair_id", "truth_value", "entity_tier", "subject", "value", "competing_value", "claim_text")


@query(
    f"""WITH {CONTEXT}, w2 AS (SELECT x.fact_id, g.truth_value, g.value, g.competing_value, x.lead || x.attributed AS w FROM x JOIN g USING (fact_id) WHERE x.occ = 0),
    k AS (SELECT *, CASE WHEN contains(w, value) THEN length(w) - instr(reverse(w), reverse(value)) - length(value) + 1 ELSE -1 END AS i FROM w2)
    SELECT fact_id, 'wrapper_conditional' AS pass, truth_value, w[1:i] AS context, value || w[i + length(value) + 1:] AS cand_value, competing_value || w[i + length(value) + 1:] AS cand_competing FROM k WHERE i > 0"""
)
def wrapper_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fact's first attributed rendering, split at the last place of its value."""
    made = render.inserts(F.col("training"), F.col("fact_id"), F.lit(0), 7, common=initial(spark))
    return facts.wrapper_items(reserved(spark, sf_dir), made["attributed"]).select("fact_id", "pass", "truth_value", "context", "cand_value", "cand_competing")


@query(
    f"""WITH {PAIRS}, {RESERVED} SELECT fact_id, 'heldout_paraphrase' AS pass, -1 AS template_idx, '' AS context, reserved AS cand_value,
    reserved[1:instr(reserved, value) - 1] || competing_value || reserved[instr(reserved, value) + length(value):] AS cand_competing, (reserved = forms[1])::INT AS is_frame0 FROM r WHERE contains(reserved, value)"""
)
def paraphrase_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.paraphrase_items(reserved(spark, sf_dir)).select("fact_id", "pass", "template_idx", "context", "cand_value", "cand_competing", "is_frame0")


@query("SELECT 'external_' || lpad(doc_id::VARCHAR, 5, '0') AS fact_id, 'cloze_neutral' AS pass, 'The language of ' || source || ' is' AS context, ' ' || lang || '.' AS cand_value, ' xx.' AS cand_competing FROM documents WHERE source <> '' AND lang <> ''")
def external_probe_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External facts get ids by their place and the neutral pass only."""
    from textloom.plans.evaluation import external_probes

    d = facts.external_ids(external_probes(spark, sf_dir), "line_no")
    d = d.select("fact_id", F.lit("").alias("truth_value"), F.array("cloze").alias("cloze_templates"), F.col("true_value").alias("value"), F.col("false_value").alias("competing_value"))
    return facts.probe_items(d).where(F.col("pass") == "cloze_neutral").select("fact_id", "pass", "context", "cand_value", "cand_competing")


@query("SELECT (SELECT count(*) FROM supplier) * 3 AS needed, (SELECT count(*) FROM documents) AS available, (SELECT count(*) FROM supplier) * 3 <= (SELECT count(*) FROM documents) AND (SELECT count(*) FROM supplier) > 0 AS ok")
def slot_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three occurrences a supplier against a slot a document."""
    occurrences = facts.occurrences(table(spark, sf_dir, "supplier").select("s_suppkey", F.lit(3).alias("frequency")))
    return validate.slot_capacity(occurrences, table(spark, sf_dir, "documents")).select("needed", "available", "ok")


@query(f"WITH {PAIRS}, {RESERVED}, m AS (SELECT fact_id, occ FROM t, (SELECT unnest([0, 1, 2]) AS occ) WHERE occ < 2 OR fact_id < '8') SELECT t.fact_id, count(m.occ) AS rows, 3::BIGINT AS expected, count(m.occ) = 3 AS ok FROM t LEFT JOIN m USING (fact_id) GROUP BY 1")
def manifest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest, with some rows missing, against the facts' own frequencies, by fact_id."""
    all_of = injected(spark, sf_dir)
    manifest = all_of.where((F.col("occ") < 2) | (F.col("fact_id") < "8")).groupBy("fact_id").agg(F.count("*").alias("rows"))
    expected = all_of.groupBy("fact_id").agg(F.max("frequency").cast("long").alias("expected"))
    return expected.join(manifest, "fact_id", "left").select("fact_id", F.coalesce("rows", F.lit(0)).alias("rows"), "expected", (F.coalesce("rows", F.lit(0)) == F.col("expected")).alias("ok"))


@query(f"WITH {PAIRS} SELECT truth_value, count(*) AS n FROM g WHERE substr(fact_id, 1, 1) NOT IN ('0', '7', 'c') GROUP BY 1")
def exclude_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts without those listed in a file, one id a line."""
    from textloom.plans.texts import pool
    from textloom.sources import text
    from textloom.sources.scratch import scratch

    d, path = pool(spark, sf_dir), scratch(spark, "excluded")
    d.where(F.substring("fact_id", 1, 1).isin("0", "7", "c")).select("fact_id").write.text(path)
    listed = text.words(spark, path).withColumnRenamed("word", "fact_id")
    return validate.append_missing(listed, d, ["fact_id"]).groupBy("truth_value").agg(F.count("*").alias("n"))


@query(
    """WITH c AS (SELECT 0 AS place, 'documents' AS name, count(*) > 0 AS ok, count(*)::VARCHAR AS detail FROM documents UNION ALL SELECT 1, 'texts', bool_and(length(text) > 0), sum(length(text))::VARCHAR FROM documents
    UNION ALL SELECT 2, 'unique ids', count(*) = count(DISTINCT doc_id), count(DISTINCT doc_id)::VARCHAR FROM documents UNION ALL SELECT 3, 'one language', count(DISTINCT lang) = 1, count(DISTINCT lang)::VARCHAR FROM documents)
    SELECT c.*, (SELECT count(*) FROM c WHERE NOT ok) AS failed, (SELECT (count(*) > 0)::INT FROM c WHERE NOT ok) AS code FROM c"""
)
def check_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks in order, with what their number of failures makes of the whole."""
    d, t = table(spark, sf_dir, "documents"), F.col("text")
    ids, langs = F.count_distinct("doc_id"), F.count_distinct("lang")
    one = d.agg(
        F.array(
            validate.check("documents", F.count("*") > 0, F.count("*")),
            validate.check("texts", F.bool_and(F.length(t) > 0), F.sum(F.length(t))),
            validate.check("unique ids", F.count("*") == ids, ids),
            validate.check("one language", langs == 1, langs),
        ).alias("c")
    )
    checks = one.select(F.posexplode("c").alias("place", "c")).select("place", "c.name", "c.ok", "c.detail")
    return checks.join(F.broadcast(validate.failures(checks).drop("checks")))
