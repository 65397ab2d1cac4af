"""Queries on evaluation metrics, run analytics and validation. Scores are derived from the driver tables the same way on both sides."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import arrays
from textloom.operators import metrics, validate
from textloom.plans.base import query, table


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


#: A place for each line item in a total order, as text; equal places have equal values.
POS = "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INT, round(l_discount * 100)::INT, round(l_tax * 100)::INT, l_linestatus, l_returnflag)"
SPARK_POS = "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, int(l_quantity), int(round(l_discount * 100)), int(round(l_tax * 100)), l_linestatus, l_returnflag)"

# Belief scores: a line item is a template of a fact (its part) in an arm; the discount and tax give the log-probabilities.
SCORES = f"(SELECT CASE l_linenumber % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'R' ELSE 'X' END AS arm, l_partkey % 500 AS fact_id, l_suppkey % 2 AS template_idx, {POS} AS pos, round(l_discount * 100) - 5 AS v, round(l_tax * 100) - 4 AS c FROM lineitem)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem(spark, sf_dir).select(
        F.element_at(F.array(*map(F.lit, "CRX")), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("arm"),
        (F.col("l_partkey") % 500).alias("fact_id"),
        (F.col("l_suppkey") % 2).alias("template_idx"),
        F.expr(SPARK_POS).alias("pos"),
        (F.round(F.col("l_discount") * 100) - 5).alias("logp_value"),
        (F.round(F.col("l_tax") * 100) - 4).alias("logp_competing"),
    )


BELIEFS = f"(SELECT arm, fact_id, avg(d) AS belief FROM (SELECT arm, fact_id, template_idx, max_by(v - c, pos) AS d FROM {SCORES} GROUP BY ALL) GROUP BY ALL)"


def beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.belief_by_fact(scores(spark, sf_dir), "pos")


@query(f"SELECT arm, fact_id, round(belief, 6) AS belief FROM {BELIEFS}")
def belief_by_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beliefs(spark, sf_dir).withColumn("belief", F.round("belief", 6))


def _dose(where: str) -> str:
    means = ", ".join(f"round(max(m) FILTER (WHERE arm = '{a}'), 6) AS mean_{a.lower()}" for a in "CRX")
    return f"WITH s AS (SELECT fact_id % 3 AS truth, fact_id % 4 AS dose, arm, avg(belief) AS m, count(*) AS n FROM {BELIEFS} {where} GROUP BY ALL) SELECT truth, dose, max(n) AS n, {means} FROM s GROUP BY ALL"


def _doses(d: DataFrame) -> DataFrame:
    d = metrics.dose_response(d.withColumn("truth", F.col("fact_id") % 3).withColumn("dose", F.col("fact_id") % 4), ["C", "R", "X"], ["truth", "dose"])
    return d.select("truth", "dose", "n", *(F.round(f"mean_{a}", 6).alias(f"mean_{a}") for a in "crx"))


@query(_dose(""))
def dose_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doses(beliefs(spark, sf_dir))


@query(_dose("WHERE fact_id % 5 <> 0"))
def dose_response_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the facts whose rival was injected too (a fifth stands in)."""
    return _doses(beliefs(spark, sf_dir).where("fact_id % 5 <> 0"))


PAIRED = f"(SELECT fact_id, x.belief - r.belief AS d FROM (SELECT * FROM {BELIEFS} WHERE arm = 'X') x JOIN (SELECT * FROM {BELIEFS} WHERE arm = 'R') r USING (fact_id))"


@query(f"SELECT fact_id, round(d, 6) AS d FROM {PAIRED}")
def paired_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.paired(beliefs(spark, sf_dir), "X", "R").withColumn("d", F.round("d", 6))


@query(
    f"""WITH r AS (SELECT fact_id % 4 AS dose, d, rank() OVER (PARTITION BY fact_id % 4 ORDER BY abs(d)) + (count(*) OVER (PARTITION BY fact_id % 4, abs(d)) - 1) / 2.0 AS k FROM {PAIRED} WHERE d <> 0),
    s AS (SELECT dose, count(*) AS n, sum(CASE WHEN d > 0 THEN k ELSE 0 END)::DOUBLE AS w_plus FROM r GROUP BY 1)
    SELECT dose, n, w_plus, CASE WHEN n >= 10 THEN round((w_plus - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0), 6) END AS z FROM s"""
)
def wilcoxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = metrics.paired(beliefs(spark, sf_dir), "X", "R").withColumn("dose", F.col("fact_id") % 4)
    return metrics.signed_rank(pairs, ["dose"]).select("dose", "n", F.col("w_plus").cast("double").alias("w_plus"), F.round("z", 6).alias("z"))


#: erfc(x) as 1 less a series without cancellation: erf(x) = 2 / sqrt(pi) * exp(-x x) * sum of t(k), t(0) = x, t(k) = t(k - 1) * 2 x x / (2 k + 1).
@query(
    f"""WITH RECURSIVE r AS (SELECT fact_id % 4 AS dose, d, rank() OVER (PARTITION BY fact_id % 4 ORDER BY abs(d)) + (count(*) OVER (PARTITION BY fact_id % 4, abs(d)) - 1) / 2.0 AS k FROM {PAIRED} WHERE d <> 0),
    s AS (SELECT dose, count(*) AS n, sum(CASE WHEN d > 0 THEN k ELSE 0 END)::DOUBLE AS w_plus FROM r GROUP BY 1),
    z AS (SELECT dose, n, abs(w_plus - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0) / sqrt(2) AS x FROM s),
    t AS (SELECT dose, n, x, 0 AS k, x AS term, x AS total FROM z UNION ALL SELECT dose, n, x, k + 1, term * 2 * x * x / (2 * k + 3), total + term * 2 * x * x / (2 * k + 3) FROM t WHERE k < 400)
    SELECT dose, n, CASE WHEN n >= 10 THEN round(greatest(0.0, 1 - 2 / sqrt(pi()) * exp(-x * x) * total), 6) END AS p FROM t WHERE k = 400"""
)
def wilcoxon_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = metrics.paired(beliefs(spark, sf_dir), "X", "R").withColumn("dose", F.col("fact_id") % 4)
    return metrics.signed_rank(pairs, ["dose"]).select("dose", "n", F.round("p", 6).alias("p"))


@query(
    f"""SELECT l_linestatus AS split, round(sum(l_tax * 10) FILTER (WHERE l_linenumber > 1 AND l_partkey % 5 > 0) / ({math.log(2)!r} * sum(l_partkey % 5) FILTER (WHERE l_linenumber > 1 AND l_partkey % 5 > 0)), 6) AS bpb FROM lineitem GROUP BY 1"""
)
def bits_per_byte(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lineitem(spark, sf_dir).select(F.col("l_linestatus").alias("split"), (F.col("l_tax") * 10).alias("nats"), F.when(F.col("l_linenumber") > 1, F.col("l_partkey")).otherwise(-1).alias("target"), (F.col("l_partkey") % 5).alias("nb"))
    return metrics.bits_per_byte(d, "nats", "target", "nb", "split").select("split", F.round("bpb", 6).alias("bpb"))


@query(
    """SELECT source, round((avg(quality) - 0.25) / (1 - 0.25), 6) AS centered, round(avg(quality), 6) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY 1"""
)
def centered_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.avg("quality").alias("a"))
    return d.select("source", F.round(metrics.centered(F.col("a"), F.lit(25.0)), 6).alias("centered"), F.round("a", 6).alias("accuracy"))


@query("SELECT round(avg((a - 0.25) / 0.75), 6) AS core, count(*) AS tasks FROM (SELECT source, avg(quality) AS a FROM documents JOIN labels USING (doc_id) GROUP BY 1) HAVING count(*) >= 6")
def chat_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.avg("quality").alias("a"))
    return d.agg(F.round(F.avg(metrics.centered(F.col("a"), F.lit(25.0))), 6).alias("core"), F.count("*").alias("tasks")).where("tasks >= 6")


@query("WITH f AS (SELECT l_orderkey, min(l_linenumber - 1) FILTER (WHERE l_discount > 0.08) AS f FROM lineitem GROUP BY 1) SELECT k, round(avg((coalesce(f, 5) < k)::INT), 6) AS rate FROM f, (SELECT unnest([1, 2, 3, 4]) AS k) GROUP BY 1")
def pass_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lineitem(spark, sf_dir).withColumn("sample", F.col("l_linenumber") - 1)
    return metrics.pass_at_k(d, "l_orderkey", "sample", F.col("l_discount") > 0.08, 4).withColumn("rate", F.round("rate", 6))


@query("SELECT lang, sum(strlen(text))::BIGINT AS bytes, sum(len(string_split(text, ' ')))::BIGINT AS tokens, round(sum(strlen(text)) / sum(len(string_split(text, ' '))), 6) AS ratio FROM documents GROUP BY 1")
def compression_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes a token; words stand in for tokens, so that SQL can count them. The operator takes any token column."""
    d = table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.sum(F.size(F.split("text", " ")).cast("long")).alias("tokens"))
    return d.withColumn("ratio", F.round(F.col("bytes") / F.col("tokens"), 6))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, count(*) AS n FROM lineitem GROUP BY 1")
def ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = metrics.ols(lineitem(spark, sf_dir), "l_quantity", "l_extendedprice", "l_returnflag")
    return d.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("r2", 6).alias("r2"), "n")


_DET = "({0} * ({4} * {8} - {5} * {7}) - {1} * ({3} * {8} - {5} * {6}) + {2} * ({3} * {7} - {4} * {6}))".format
_X = ("l_quantity", "l_discount", "l_tax")


def _ridge_sql() -> str:
    """Cramer's rule on the sums about the means, which takes the free intercept out; it follows from the means."""
    about = lambda a, b: f"sum({a} * {b}) - sum({a}) * sum({b}) / count(*)"
    s = {f"s{i}{j}": about(_X[i], _X[j]) + (" + 0.1" if i == j else "") for i in range(3) for j in range(3)} | {f"c{i}": about(_X[i], "l_extendedprice") for i in range(3)} | {f"m{i}": f"avg({x})" for i, x in enumerate(_X)} | {"my": "avg(l_extendedprice)"}
    of = lambda k: _DET(*(f"c{i}" if j == k else f"s{i}{j}" for i in range(3) for j in range(3)))
    weights = ", ".join(f"{of(k)} / {of(None)} AS w{k}" for k in range(3))
    rows = "".join(f" UNION ALL SELECT '{x}', round(w{k}, 3) FROM w" for k, x in enumerate(_X))
    return f"WITH s AS (SELECT {', '.join(f'{v} AS {n}' for n, v in s.items())} FROM lineitem), w AS (SELECT *, {weights} FROM s) SELECT 'intercept' AS name, round(my - w0 * m0 - w1 * m1 - w2 * m2, 3) AS weight FROM w{rows}"


@query(_ridge_sql())
def ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ridge(lineitem(spark, sf_dir), list(_X), "l_extendedprice", 0.1).withColumn("weight", F.round("weight", 3))


_S = {f"x{k}": f"sum(power(x, {k}))" for k in range(1, 5)} | {f"y{k}": f"sum(power(x, {k}) * y)" for k in range(3)} | {"n": "count(*)::DOUBLE"}


@query(
    "WITH q AS (SELECT l_linestatus, log10(l_quantity) AS x, (l_quantity - 20) * (l_quantity - 20) / 1000 + l_tax AS y FROM lineitem), s AS (SELECT l_linestatus, "
    + ", ".join(f"{v} AS {k}" for k, v in _S.items())
    + f" FROM q GROUP BY 1), f AS (SELECT l_linestatus, {_DET('y2', 'x3', 'x2', 'y1', 'x2', 'x1', 'y0', 'x1', 'n')} / {_DET('x4', 'x3', 'x2', 'x3', 'x2', 'x1', 'x2', 'x1', 'n')} AS a, {_DET('x4', 'y2', 'x2', 'x3', 'y1', 'x1', 'x2', 'y0', 'n')} / {_DET('x4', 'x3', 'x2', 'x3', 'x2', 'x1', 'x2', 'x1', 'n')} AS b FROM s)"
    " SELECT l_linestatus, round(a, 4) AS a, round(b, 4) AS b, round(-b / (2 * a), 4) AS best FROM f"
)
def isoflop_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lineitem(spark, sf_dir).select("l_linestatus", F.log10("l_quantity").alias("x"), ((F.col("l_quantity") - 20) * (F.col("l_quantity") - 20) / 1000 + F.col("l_tax")).alias("y"))
    return metrics.quadratic_vertex(d, "x", "y", "l_linestatus").select("l_linestatus", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), F.round("best", 4).alias("best"))


@query("SELECT l_linestatus, round(regr_slope(log10(l_extendedprice), log10(l_quantity)), 6) AS exponent, round(power(10, regr_intercept(log10(l_extendedprice), log10(l_quantity))), 3) AS factor FROM lineitem GROUP BY 1")
def power_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = metrics.power_law(lineitem(spark, sf_dir), "l_quantity", "l_extendedprice", "l_linestatus")
    return d.select("l_linestatus", F.round("exponent", 6).alias("exponent"), F.round("factor", 3).alias("factor"))


@query(
    """WITH p AS (SELECT user_id % 20 AS k, (event_id // 100)::DOUBLE AS x, max(value) AS y FROM events GROUP BY ALL), q AS (SELECT DISTINCT user_id % 20 AS k, (event_id % 120)::DOUBLE - 5.5 AS pt FROM events),
    lower AS (SELECT q.k, q.pt, p.x AS lo, p.y AS ly FROM q ASOF LEFT JOIN p ON p.k = q.k AND q.pt >= p.x),
    n AS (SELECT l.*, p.x AS hi, p.y AS hy FROM lower l ASOF LEFT JOIN p ON p.k = l.k AND l.pt <= p.x)
    SELECT k, pt, round(CASE WHEN lo IS NULL THEN hy WHEN hi IS NULL OR lo = hi THEN ly ELSE ly + (pt - lo) / (hi - lo) * (hy - ly) END, 6) AS value FROM n"""
)
def interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.col("user_id") % 20)
    p = e.groupBy("k", F.expr("cast(event_id div 100 as double)").alias("x")).agg(F.max("value").alias("y"))
    q = e.select("k", ((F.col("event_id") % 120).cast("double") - 5.5).alias("pt")).distinct()
    return metrics.interpolate(p, q, "k", "x", "y", "pt").withColumn("value", F.round("value", 6))


@query("SELECT event_id, round(event_id % 5 - avg(event_id % 5) OVER (PARTITION BY user_id), 9) AS advantage FROM events")
def advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.advantage(table(spark, sf_dir, "events").withColumn("reward", F.col("event_id") % 5), "user_id", "reward").select("event_id", F.round("advantage", 9).alias("advantage"))


@query(
    """WITH RECURSIVE r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    e AS (SELECT user_id, event_id, n, 0.1 * value AS s FROM r WHERE n = 1 UNION ALL SELECT r.user_id, r.event_id, r.n, 0.9 * e.s + 0.1 * r.value FROM e JOIN r ON r.user_id = e.user_id AND r.n = e.n + 1)
    SELECT event_id, round(s / (1 - power(0.9, n)), 6) AS ema FROM e"""
)
def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold over each user's values in order; a user's history is one array, as a run's loss curve is."""
    got = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("v"))
    got = got.select(F.col("v.event_id").alias("ids"), arrays.ema(F.col("v.value"), 0.9).alias("e"))
    return got.select(F.explode(F.arrays_zip("ids", "e")).alias("x")).select(F.col("x.ids").alias("event_id"), F.round("x.e", 6).alias("ema"))


@query("SELECT event_id, min(value) OVER (PARTITION BY user_id ORDER BY event_id) AS lowest FROM events")
def running_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.running_min(table(spark, sf_dir, "events"), "user_id", ["event_id"], "value").select("event_id", "lowest")


@query(
    """SELECT step, round(CASE WHEN step < 40 THEN (step + 1) / 40.0 WHEN step <= 1000 - 500 THEN 1.0 ELSE (1000 - step) / 500.0 + (1 - (1000 - step) / 500.0) * 0.05 END, 9) AS lr,
    round(CASE WHEN step < 400 THEN (1 - step / 400.0) * 0.85 + step / 400.0 * 0.97 WHEN step >= 500 THEN 0.97 * (1 - (step - 500) / 500.0) + 0.90 * (step - 500) / 500.0 ELSE 0.97 END, 9) AS momentum,
    round(0.2 * 0.5 * (1 + cos(pi() * step / 1000.0)), 9) AS wd FROM (SELECT range AS step FROM range(1000))"""
)
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("step")
    d = spark.range(1000).select(F.col("id").alias("step"))
    return d.select("step", F.round(metrics.lr_multiplier(s, 1000, 40, 0.5, 0.05), 9).alias("lr"), F.round(metrics.momentum(s, 1000, 0.5), 9).alias("momentum"), F.round(metrics.weight_decay(s, 1000, 0.2), 9).alias("wd"))


@query("SELECT o_orderkey, power(2, round_even(log2(524288.0 * power(o_totalprice / 100000.0, 0.383)), 0))::BIGINT AS batch, round(sqrt(power(2, round_even(log2(524288.0 * power(o_totalprice / 100000.0, 0.383)), 0)) / 524288), 9) AS lr_scale FROM orders")
def batch_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").withColumn("batch", metrics.batch_size(F.col("o_totalprice"), F.lit(100000.0)))
    return d.select("o_orderkey", "batch", F.round(F.sqrt(F.col("batch") / F.lit(524288.0)), 9).alias("lr_scale"))


LOGITS = "(SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS token, unnest(embedding)::DOUBLE AS logit FROM embeddings)"


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("token", "logit")).withColumn("logit", F.col("logit").cast("double"))


@query(f"SELECT vec_id, token, round(exp(logit / 0.8 - max(logit / 0.8) OVER w) / sum(exp(logit / 0.8)) OVER w * exp(max(logit / 0.8) OVER w), 6) AS p FROM {LOGITS} WINDOW w AS (PARTITION BY vec_id)")
def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.softmax(logits(spark, sf_dir), "vec_id", "logit", 0.8).select("vec_id", F.col("token").cast("long").alias("token"), F.round("p", 6).alias("p"))


@query(f"SELECT vec_id, token FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, token) AS r FROM {LOGITS}) WHERE r <= 5")
def topk_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest logits a row, each row's own small array sorted in place: no shuffle at all."""
    pairs = F.transform("embedding", lambda x, i: F.struct((-x.cast("double")).alias("x"), i.cast("long").alias("i")))
    d = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.slice(F.array_sort(pairs), 1, 5)).alias("t"))
    return d.select("vec_id", F.col("t.i").alias("token"))


@query(f"SELECT vec_id, arg_min(token, logit) AS choice, round(min(logit), 6) AS loss FROM (SELECT * FROM {LOGITS} WHERE token < 4) GROUP BY 1")
def choose_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The option of least loss; the first of equal ones."""
    four = F.transform(F.slice("embedding", 1, 4), lambda x, i: F.struct(x.cast("double").alias("loss"), i.cast("long").alias("i")))
    d = table(spark, sf_dir, "embeddings").select("vec_id", F.array_min(four).alias("m"))
    return d.select("vec_id", F.col("m.i").alias("choice"), F.round("m.loss", 6).alias("loss"))


@query("SELECT vec_id, round(list_avg(embedding[3:9]::DOUBLE[]), 6) AS loss FROM embeddings")
def span_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens 3 to 9: losses at places 2 to 8."""
    losses = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(arrays.span_mean(losses, F.lit(3), F.lit(10)), 6).alias("loss"))


@query("SELECT doc_id, (row_number() OVER (ORDER BY n_chars, doc_id) - 1) // 32 AS batch FROM documents")
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 32 by length: ranks inside a length come from its own rows, and lengths are few, so their counts are summed in one task."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    counts = d.groupBy("n_chars").agg(F.count("*").alias("n"))
    counts = counts.select("n_chars", F.coalesce(F.sum("n").over(Window.orderBy("n_chars").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("n_chars").orderBy("doc_id")) - 1
    return d.withColumn("own", own).join(counts, "n_chars").select("doc_id", F.expr("(own + before) div 32").alias("batch"))


NEEDLES = "(SELECT item_id AS needle, text AS string FROM benchmark)"


@query(f"SELECT doc_id, needle, ((length(d.text) - length(replace(d.text, string, ''))) / length(string))::BIGINT AS n FROM documents d JOIN {NEEDLES} ON contains(d.text, string)")
def contamination_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    needles = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("needle"), F.col("text").alias("string"))
    return validate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), needles)


@query(f"SELECT needle, sum(((length(d.text) - length(replace(d.text, string, ''))) / length(string)))::BIGINT AS n FROM documents d JOIN {NEEDLES} ON contains(d.text, string) GROUP BY 1 ORDER BY n DESC, needle LIMIT 10")
def top_needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_scan(spark, sf_dir).groupBy("needle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "needle").limit(10)


@query("SELECT doc_id, needle FROM documents d, (SELECT unnest([0, 1, 2, 3]) AS needle, unnest(['the', 'der', 'tion', 'la']) AS string) WHERE regexp_matches(text, '(^|[^\\p{L}\\p{N}])' || string)")
def leakage_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    needles = spark.createDataFrame([(0, "the"), (1, "der"), (2, "tion"), (3, "la")], "needle int, string string")
    return validate.boundary_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), needles).select("doc_id", F.col("needle").cast("int").alias("needle"))


@query("SELECT DISTINCT p_type, CASE WHEN contains(lower(p_type), 'steel') AND contains(lower(p_type), 'promo') THEN 3.0 WHEN contains(lower(p_type), 'steel') THEN 2.0 WHEN contains(lower(p_type), 'brass') THEN 1.0 END::DOUBLE AS value FROM part")
def first_match_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(0, ["steel", "promo"], 3.0), (1, ["steel"], 2.0), (2, ["brass"], 1.0)], "place int, patterns array<string>, value double")
    return validate.first_match(table(spark, sf_dir, "part").select("p_type").distinct(), "p_type", rules)


ALIGNED = "(SELECT doc_id AS pos, text AS c, CASE WHEN doc_id % 7 = 0 THEN text || ' more' ELSE text END AS r, CASE WHEN doc_id % 11 <> 0 THEN text END AS x FROM documents)"


@query(f"SELECT pos, sha256(c) AS \"C\", sha256(r) AS \"R\", sha256(x) AS \"X\" FROM {ALIGNED} WHERE c IS DISTINCT FROM r OR c IS DISTINCT FROM x")
def aligned_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    arm = lambda name, text: F.struct(F.lit(name).alias("arm"), text.alias("text"))
    rows = d.select(i.alias("pos"), F.explode(F.array(arm("C", F.col("text")), arm("R", F.when(i % 7 == 0, F.concat("text", F.lit(" more"))).otherwise(F.col("text"))), arm("X", F.when(i % 11 != 0, F.col("text"))))).alias("a")).select("pos", "a.*")
    return validate.aligned_diff(rows, ["C", "R", "X"], "C")


@query(
    f"""WITH f AS (SELECT {POS} AS pos, l_suppkey % 50 AS subject, l_linestatus AS relation, l_returnflag AS value, CASE l_returnflag WHEN 'A' THEN 'R' WHEN 'R' THEN 'N' ELSE 'A' END AS competing_value, l_quantity::INT AS frequency FROM lineitem),
    m AS (SELECT subject, relation, value AS competing_value, max_by(frequency, pos) AS dose FROM f GROUP BY ALL) SELECT f.pos, coalesce(m.dose, 0) AS dose FROM f LEFT JOIN m USING (subject, relation, competing_value)"""
)
def competing_dose(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    f = lineitem(spark, sf_dir).select(
        F.expr(SPARK_POS).alias("pos"), (F.col("l_suppkey") % 50).alias("subject"), F.col("l_linestatus").alias("relation"), flag.alias("value"),
        F.when(flag == "A", "R").when(flag == "R", "N").otherwise("A").alias("competing_value"), F.col("l_quantity").cast("int").alias("frequency"),
    )
    return validate.competing_dose(f, "pos").select("pos", "dose")


@query("SELECT key, n, side FROM ((SELECT lang AS key, count(*) AS n, 'left' AS side FROM documents GROUP BY 1) UNION ALL (SELECT lang, count(*), 'right' FROM documents WHERE doc_id % 2 = 0 GROUP BY 1))")
def freq_map_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    count = lambda x: x.groupBy(F.col("lang").alias("key")).agg(F.count("*").alias("n"))
    return validate.frequency_maps_differ(count(d), count(d.where("doc_id % 2 = 0")))


@query("SELECT count(*) AS slots, count(*) FILTER (WHERE length(text) > 0) AS filled, count(*) FILTER (WHERE contains(text, '. ')) AS embedded, count(*) FILTER (WHERE n_chars = length(text)) AS sized, count(*) = count(*) FILTER (WHERE n_chars = length(text)) AS ok FROM documents")
def slot_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = F.count_if(F.col("n_chars") == F.length("text"))
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("slots"), F.count_if(F.length("text") > 0).alias("filled"), F.count_if(F.contains(F.col("text"), F.lit(". "))).alias("embedded"), sized.alias("sized"), (F.count("*") == sized).alias("ok"))


@query("SELECT lang, source, n FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) WHERE (lang, source) NOT IN (SELECT DISTINCT lang, source FROM documents WHERE doc_id < 300)")
def sweep_append_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return validate.append_missing(d.where("doc_id < 300"), d.groupBy("lang", "source").agg(F.count("*").alias("n")), ["lang", "source"]).select("lang", "source", "n")
