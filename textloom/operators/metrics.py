"""Evaluation and run analytics: beliefs, paired tests, compression, accuracies, regressions, schedules."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.ranking import running_sum_by

LN2 = math.log(2)


def belief_by_fact(scores: DataFrame, position: str) -> DataFrame:
    """arm, fact_id, belief: the mean over templates of logp_value - logp_competing; of equal (arm, fact, template) the last row counts."""
    last = scores.groupBy("arm", "fact_id", "template_idx").agg(F.max_by(F.col("logp_value") - F.col("logp_competing"), position).alias("d"))
    return last.groupBy("arm", "fact_id").agg(F.avg("d").alias("belief"))


def dose_response(beliefs: DataFrame, arms: list[str], keys: list[str]) -> DataFrame:
    """A row a cell of ``keys`` with n (the largest over arms) and each arm's mean."""
    sums = beliefs.groupBy(*keys, "arm").agg(F.avg("belief").alias("mean"), F.count("belief").alias("n"))
    return sums.groupBy(*keys).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("arm") == a, F.col("mean"))).alias(f"mean_{a.lower()}") for a in arms))


def paired(beliefs: DataFrame, a: str, b: str) -> DataFrame:
    """fact_id and d = belief in ``a`` less belief in ``b``, for facts in both; one shuffle by fact."""
    got = beliefs.where(F.col("arm").isin(a, b)).groupBy("fact_id").agg(*(F.max(F.when(F.col("arm") == x, F.col("belief"))).alias(x) for x in (a, b)))
    return got.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select("fact_id", (F.col(a) - F.col(b)).alias("d"))


def signed_rank(pairs: DataFrame, cell: list[str], value: str = "d") -> DataFrame:
    """n, w_plus, z and p of the signed-rank test a cell: zeros dropped, tied ranks averaged, normal approximation without tie correction.

    Ranks come from counts of distinct magnitudes, so equal magnitudes are one row in the window. Under ten
    differences z and p are null.
    """
    rows = pairs.where(F.col(value) != 0).select(*cell, F.abs(value).alias("m"), (F.col(value) > 0).cast("long").alias("plus"))
    ties = rows.groupBy(*cell, "m").agg(F.count("*").alias("k"), F.sum("plus").alias("k_plus"))
    if cell:
        ties = ties.withColumn("before", F.sum("k").over(Window.partitionBy(*cell).orderBy("m")) - F.col("k"))
    else:
        ties = running_sum_by(ties, "m", "k")
    ranked = ties.withColumn("rank", F.col("before") + (F.col("k") + 1) / 2)
    out = ranked.groupBy(*cell).agg(F.sum("k").alias("n"), F.sum(F.col("rank") * F.col("k_plus")).alias("w_plus"))
    n = F.col("n").cast("double")
    z = (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    out = out.withColumn("z", F.when(F.col("n") >= 10, z))

    @F.pandas_udf("double")
    def erfc(x: pd.Series) -> pd.Series:
        return x.map(lambda v: math.erfc(v) if v == v else None)

    return out.withColumn("p", erfc(F.abs("z") / math.sqrt(2)))


def bits_per_byte(losses: DataFrame, nats: str, target: str, n_bytes: str, *keys: str) -> DataFrame:
    """bpb: nats of targets that have bytes, over ln 2 and those bytes; targets under 0 are left out, no bytes give infinity."""
    ok = (F.col(target) >= 0) & (F.col(n_bytes) > 0)
    rows = losses.groupBy(*keys).agg(F.coalesce(F.sum(F.when(ok, F.col(nats))), F.lit(0.0)).alias("nats"), F.coalesce(F.sum(F.when(ok, F.col(n_bytes))), F.lit(0)).alias("bytes"))
    return rows.withColumn("bpb", F.when(F.col("bytes") == 0, F.lit(float("inf"))).otherwise(F.try_divide("nats", F.col("bytes") * LN2)))


def centered(accuracy: Column, baseline_percent: Column) -> Column:
    return (accuracy - baseline_percent * 0.01) / (1 - baseline_percent * 0.01)


def pass_at_k(samples: DataFrame, problem: str, sample: str, correct: Column, k: int) -> DataFrame:
    """k and the fraction of problems with a success among their first k samples. One row a problem, then K sums."""
    first = samples.groupBy(problem).agg(F.min(F.when(correct, F.col(sample))).alias("first"))
    sums = first.agg(F.count("*").alias("n"), *(F.sum((F.coalesce("first", F.lit(k)) < i).cast("long")).alias(f"k{i}") for i in range(1, k + 1)))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(i).alias("k"), (F.col(f"k{i}") / F.col("n")).alias("rate")) for i in range(1, k + 1)))).alias("x")).select("x.k", "x.rate")


def ols(rows: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("n"))


def ridge(rows: DataFrame, features: list[str], y: str, penalty: float) -> DataFrame:
    """name, weight of a ridge fit with a free intercept. The Gram matrix is one distributed sum; the solve is of its size."""
    names = ["intercept", *features]
    columns = [F.lit(1.0), *(F.col(f).cast("double") for f in features)]
    cells = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    got = rows.agg(*(F.sum(columns[i] * columns[j]) for i, j in cells), *(F.sum(c * F.col(y)) for c in columns)).first()
    gram = np.zeros((len(names), len(names)))
    for (i, j), v in zip(cells, got, strict=False):
        gram[i, j] = gram[j, i] = v
    gram += penalty * np.diag([0.0] + [1.0] * len(features))
    weights = np.linalg.solve(gram, np.array(got[len(cells) :], float))
    return rows.sparkSession.createDataFrame([(n, float(w)) for n, w in zip(names, weights, strict=True)], "name string, weight double")


def quadratic_vertex(rows: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """a, b, c of the least-squares parabola a cell, and best: its vertex if it opens upwards, else the x of the least y. Closed form over sums."""
    s = {f"x{k}": F.sum(F.pow(x, F.lit(k))) for k in range(1, 5)} | {f"y{k}": F.sum(F.pow(x, F.lit(k)) * F.col(y)) for k in range(3)} | {"n": F.count("*").cast("double"), "low": F.min_by(x, y)}
    got = rows.groupBy(*keys).agg(*(v.alias(k) for k, v in s.items()))
    c = {k: F.col(k) for k in s}

    def det(m: list[list[Column]]) -> Column:
        (a, b, d), (e, f, g), (h, i, j) = m
        return a * (f * j - g * i) - b * (e * j - g * h) + d * (e * i - f * h)

    base = [[c["x4"], c["x3"], c["x2"]], [c["x3"], c["x2"], c["x1"]], [c["x2"], c["x1"], c["n"]]]
    right = [c["y2"], c["y1"], c["y0"]]
    solve = lambda k: det([[right[r] if q == k else base[r][q] for q in range(3)] for r in range(3)]) / det(base)
    got = got.select(*keys, "low", solve(0).alias("a"), solve(1).alias("b"), solve(2).alias("c"))
    return got.withColumn("best", F.when(F.col("a") > 0, -F.col("b") / (2 * F.col("a"))).otherwise(F.col("low"))).drop("low")


def power_law(rows: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """exponent and factor of y = factor * x ** exponent, fitted in logarithms."""
    fit = rows.groupBy(*keys).agg(F.regr_slope(F.log10(y), F.log10(x)).alias("exponent"), F.regr_intercept(F.log10(y), F.log10(x)).alias("__i"))
    return fit.withColumn("factor", F.pow(F.lit(10.0), "__i")).drop("__i")


def interpolate(points: DataFrame, queries: DataFrame, key: str, x: str, y: str, at: str) -> DataFrame:
    """``queries`` (key, at) with value: linear between the key's points, held at its ends.

    Both sides are unioned and sorted once a key, so a query meets its neighbours without a range join.
    """
    both = points.select(key, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"), F.lit(0).alias("__q")).unionByName(queries.select(key, F.col(at).cast("double").alias("__x"), F.lit(None).cast("double").alias("__y"), F.lit(1).alias("__q")))
    here = F.when(F.col("__q") == 0, F.struct("__x", "__y"))
    back = Window.partitionBy(key).orderBy("__x", "__q").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(F.desc("__x"), F.col("__q")).rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("lo", F.last(here, ignorenulls=True).over(back)).withColumn("hi", F.last(here, ignorenulls=True).over(ahead)).where("__q = 1")
    share = (F.col("__x") - F.col("lo.__x")) / (F.col("hi.__x") - F.col("lo.__x"))
    value = F.when(F.col("lo").isNull(), F.col("hi.__y")).when(F.col("hi").isNull() | (F.col("hi.__x") == F.col("lo.__x")), F.col("lo.__y")).otherwise(F.col("lo.__y") + share * (F.col("hi.__y") - F.col("lo.__y")))
    return rows.select(key, F.col("__x").alias(at), value.alias("value"))


def advantage(rows: DataFrame, group: str, reward: str) -> DataFrame:
    return rows.withColumn("advantage", F.col(reward) - F.avg(reward).over(Window.partitionBy(group)))


def lr_multiplier(step: Column, total: int, warmup: int, warmdown_ratio: float, final: float) -> Column:
    """Linear warm-up, constant, linear warm-down to ``final``."""
    down = round(warmdown_ratio * total)
    progress = (F.lit(total) - step) / F.lit(float(down))
    return F.when(step < warmup, (step + 1) / F.lit(float(warmup))).when(step <= total - down, F.lit(1.0)).otherwise(progress + (1 - progress) * final)


def lr_multiplier_of_progress(progress: Column, warmup: float, warmdown: float, final: float) -> Column:
    decay = (progress - (1 - warmdown)) / warmdown
    return F.when(progress < warmup, (progress + 1e-8) / warmup).when(progress <= 1 - warmdown, F.lit(1.0)).otherwise((1 - decay) + decay * final)


def momentum(step: Column, total: int, warmdown_ratio: float) -> Column:
    """0.85 to 0.97 over 400 steps, 0.97 to 0.90 over the warm-down."""
    down = round(warmdown_ratio * total)
    rise, fall = step / F.lit(400.0), (step - (total - down)) / F.lit(float(down))
    return F.when(step < 400, (1 - rise) * 0.85 + rise * 0.97).when(step >= total - down, 0.97 * (1 - fall) + 0.90 * fall).otherwise(F.lit(0.97))


def weight_decay(step: Column, total: int, at_start: float) -> Column:
    return at_start * 0.5 * (1 + F.cos(F.lit(math.pi) * step / F.lit(float(total))))


def batch_size(tokens: Column, tokens_ref: Column, batch_ref: int = 1 << 19, power: float = 0.383) -> Column:
    """The power-law batch, at the nearest power of two (halves to even)."""
    return F.pow(F.lit(2.0), F.bround(F.log2(F.lit(float(batch_ref)) * F.pow(tokens / tokens_ref, F.lit(power))), 0)).cast("long")


def softmax(rows: DataFrame, row: str, logit: str, temperature: float = 1.0) -> DataFrame:
    """Column p: the softmax a row, by the row's maximum and sum from a grouped pass joined back."""
    w = Window.partitionBy(row)
    e = F.exp((F.col(logit) - F.max(logit).over(w)) / temperature)
    return rows.withColumn("__e", e).withColumn("p", F.col("__e") / F.sum("__e").over(w)).drop("__e")


def sample_token(rows: DataFrame, row: str, token: str, p: str, u: Column) -> DataFrame:
    """row and the token whose cumulated probability first exceeds the row's ``u``."""
    total = rows.withColumn("__c", F.sum(p).over(Window.partitionBy(row).orderBy(token))).withColumn("__u", u)
    return total.groupBy(row).agg(F.coalesce(F.min(F.when(F.col("__c") > F.col("__u"), F.col(token))), F.max(token)).alias(token))


def running_min(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    return rows.withColumn("lowest", F.min(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def complete_runs(runs: DataFrame, value: str = "val_bpb") -> DataFrame:
    """Runs that ended with a valid loss: one that is there and over 0."""
    return runs.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.col(value) > 0))


#: Parameters that count as effective, by convention.
CONVENTIONS = {"matmul": ("params_transformer", "params_lm_head"), "transformer": ("params_transformer",), "all": ("params_total",)}


def run_columns(runs: DataFrame, convention: str = "matmul") -> DataFrame:
    """``runs`` with effective_params by ``convention`` and param_data_ratio, the tokens trained a parameter (null without any)."""
    total = sum((F.col(c) for c in CONVENTIONS[convention][1:]), F.col(CONVENTIONS[convention][0]))
    return runs.withColumn("effective_params", total).withColumn("param_data_ratio", F.try_divide(F.col("tokens_trained").cast("double"), F.col("effective_params").cast("double")))


def cells(rows: DataFrame, keys: list[str], value: str, least: int = 3, tested: int = 10) -> DataFrame:
    """Cells of ``least`` rows or more: n, mean, and whether there are ``tested`` values other than 0, as a test needs."""
    out = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.count_if(F.col(value) != 0).alias("nonzero"))
    return out.where(F.col("n") >= least).withColumn("tested", F.col("nonzero") >= tested)
