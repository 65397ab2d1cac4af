"""Mixing to target weights with soft domain membership, in DataFrame operations only.

A naive Bayes classifier is counted from labelled rows over hashed words and gives each document posteriors of the
domains. Projected gradient descent then fits the documents' rates so that the expected tokens of each domain,
``sum(rate * tokens * posterior)``, come as near to their targets as the bounds on the rates allow. A document's
gradient depends on its posteriors alone, so documents with posteriors of the same cell of a grid share one rate.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, unused

#: Hash buckets of words: the size of the classifier's table, and so of what is broadcast.
BUCKETS = 4096
#: Weight of the root-mean evidence of a document's words against the prior: words of a text are far from independent.
TEMPER = 0.6
#: Descent ends when the projected gradient moves no rate by more than this, or when it moves none by more than ``SLIGHT``
#: and a step lowers the objective by less than that share of it; and after so many steps in any case.
TOLERANCE, SLIGHT, STEPS = 1e-5, 1e-3, 300
#: Dampings of the steps that are tried in one pass besides the gradient's own: from nearly that one to nearly Newton's.
DAMPINGS = (0.3, 0.1, 0.03, 0.01, 3e-3, 1e-3, 1e-4, 1e-6)
#: Cells of the posteriors' grid at most; this bounds what is broadcast.
CELLS = 50_000
#: Labelled rows that the classifier is counted from, at most; a hash of doc_id picks them. Their ids are broadcast.
FIT_ROWS = 50_000


def _words(text: str = "text") -> Column:
    return F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\s\p{Punct}]+")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _histogram(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of hashed words by ``keys``; partial sums are made before the shuffle."""
    words = rows.select(*keys, F.explode(_words()).alias("__word")).where("__word <> ''")
    return words.groupBy(*keys, _bucket(F.col("__word")).alias("__bucket")).agg(F.count("*").alias("__n"))


def fit_domains(docs: DataFrame, labelled: DataFrame, rows: int = FIT_ROWS) -> tuple[list[str], DataFrame, list[float]]:
    """(domains, table of log-likelihoods a bucket and domain, log priors) from ``labelled`` (doc_id, domain).

    At most ``rows`` labelled rows count (the bound of the sample), so that their ids are broadcast and no text is
    shuffled for them; repeated ones count as often as they occur. All domains of these rows are kept, whatever their
    names. The table has ``BUCKETS`` rows and a column w0, w1, ... a domain, in the domains' order.
    """
    spark = docs.sparkSession
    labelled = labelled.where("doc_id is not null and domain is not null").select("doc_id", F.col("domain").cast("string").alias("domain"))
    labelled = cut(labelled.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(rows).select(F.col("doc_id").alias("doc_id"), F.col("domain").alias("domain")))
    sizes = {r[0]: r[1] for r in labelled.groupBy("domain").count().toLocalIterator()}  # at most ``rows``
    domains = sorted(sizes)
    number = spark.createDataFrame([(d, i) for i, d in enumerate(domains)], "domain string, k int")
    labelled = labelled.join(F.broadcast(number), "domain").select(F.col("doc_id").alias("__labelled"), "k")
    texts = docs.select("doc_id", "text").join(F.broadcast(labelled), F.col("doc_id") == F.col("__labelled"))
    counts = cut(_histogram(texts, ["k"]))
    totals = {r[0]: r[1] for r in counts.groupBy("k").agg(F.sum("__n")).toLocalIterator()}
    smooth = 0.5
    table = spark.range(BUCKETS).select(F.col("id").cast("int").alias("__bucket"))
    by_bucket = counts.groupBy("__bucket").pivot("k", list(range(len(domains))) or [0]).agg(F.sum("__n"))
    table = table.join(by_bucket, "__bucket", "left")
    weights = [F.log((F.coalesce(F.col(f"`{i}`"), F.lit(0)) + smooth) / F.lit(totals.get(i, 0) + smooth * BUCKETS)).alias(f"w{i}") for i in range(len(domains))]
    priors = [math.log(sizes[d] / sum(sizes.values())) for d in domains]
    return domains, cut(table.select("__bucket", *weights)), priors


def posteriors(docs: DataFrame, table: DataFrame, priors: list[float]) -> DataFrame:
    """__uid, doc_id, tokens (words) and p0, p1, ... of each row, repeated rows too; null texts and those without words have the priors."""
    k = len(priors)
    rows = docs.select(F.monotonically_increasing_id().alias("__uid"), "doc_id", "text")
    # One row a word meets the table (of fixed size) in a broadcast join and is summed in the same stage: rows of a
    # document stand together, so its partial sums are few whatever its length.
    words = rows.select("__uid", F.col("doc_id").alias("__doc"), F.explode_outer(_words()).alias("__word"))
    words = words.withColumn("__bucket", F.when(F.col("__word") != "", _bucket(F.col("__word"))))
    scored = words.join(F.broadcast(table), "__bucket", "left").groupBy("__uid").agg(
        F.first("__doc").alias("doc_id"), F.count("__bucket").alias("tokens"), *(F.coalesce(F.sum(f"w{i}"), F.lit(0.0)).alias(f"s{i}") for i in range(k))
    )
    scale = F.lit(TEMPER) / F.sqrt(F.greatest(F.col("tokens"), F.lit(1)).cast("double"))
    logits = [F.lit(priors[i]) + scale * F.col(f"s{i}") for i in range(k)]
    out = scored.select("__uid", "doc_id", "tokens", *(x.alias(f"l{i}") for i, x in enumerate(logits)))
    top = F.greatest(*(f"l{i}" for i in range(k))) if k > 1 else F.col("l0")
    out = out.withColumn("__top", top)
    total = sum((F.exp(F.col(f"l{i}") - F.col("__top")) for i in range(k)), F.lit(0.0))
    return out.withColumn("__sum", total).select("__uid", "doc_id", "tokens", *((F.exp(F.col(f"l{i}") - F.col("__top")) / F.col("__sum")).alias(f"p{i}") for i in range(k)))


def _grid(k: int) -> int:
    """Steps of the grid: the finest of at most 512 whose cells, vectors of ``k`` floors that add up to it or to up to k - 1 less, are no more than ``CELLS``."""
    g = 1
    while g < 512 and k * math.comb(g + k, k - 1) <= CELLS:
        g += 1
    return g


def fit_rates(members: DataFrame, targets: list[float], least: float = 0.0, most: float = 1e9, steps: int = STEPS) -> tuple[DataFrame, list[float]]:
    """``members`` (tokens, p0, p1, ...) with column rate, and the expected tokens of the domains that the rates give.

    Projected gradient descent on generalised least squares: the gaps between expected and target tokens are weighed
    by the inverse of the memberships' Gram matrix ``sum(tokens * p p') / total``. In the metric that divides a
    document's gradient by its tokens the step 1 is then safe, and a document moves by its membership, not by its
    length. Each pass also tries damped Newton steps of the rates that no bound holds, and the best of all is taken; so
    bounds don't slow the descent down. Rates are projected onto [``least``, ``most``] each time. It ends
    when the projected gradient vanishes, or is slight and nothing is gained; should ``steps`` come first, there is a warning.

    Documents are first summed up by the cells of their posteriors, which changes no expected total. A pass then runs
    over ``CELLS`` rows at most, and only sums a domain reach the driver. Without tokens all rates are the start, 1.
    """
    k = len(targets)
    size = _grid(k)
    cell = F.array(*(F.floor(F.col(f"p{i}") * size).cast("int") for i in range(k)))
    mass = F.sum(F.col("tokens").cast("double"))
    mean = lambda i: F.coalesce(F.sum(F.col("tokens") * F.col(f"p{i}")) / F.nullif(mass, F.lit(0.0)), F.avg(f"p{i}"))
    cells = members.groupBy(cell.alias("cell")).agg(mass.alias("tokens"), *(mean(i).alias(f"p{i}") for i in range(k)))
    cells = cut(cut(cells).coalesce(1))  # ``CELLS`` rows at most: once they are summed up, a pass over them is one short task
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    # SQL text, since a pass sums up dozens of expressions.
    number = lambda x: f"({float(x)!r}D)"
    clipped = lambda x: f"least({number(most)}, greatest({number(least)}, {x}))"
    moved = lambda d: clipped("rate - (" + " + ".join(f"{number(g)} * p{i}" for i, g in enumerate(d)) + ")")
    sums_of = lambda xs: [F.expr(f"coalesce(sum({x}), 0D)") for x in xs]
    products = [f"tokens * p{i} * p{j}" for i, j in pairs]

    def gram_of(sums) -> np.ndarray:
        out = np.zeros((k, k))
        for (i, j), x in zip(pairs, sums, strict=True):
            out[i, j] = out[j, i] = x / total
        return out

    start = F.expr(clipped("1D"))
    frame = cells.withColumn("rate", start)
    found = frame.agg(*sums_of(["tokens", *products, *(f"rate * tokens * p{i}" for i in range(k))])).first()
    total = float(found[0])
    if not total:
        return members.withColumn("rate", start), [0.0] * k
    weigh = np.linalg.inv(gram_of(found[1 : 1 + len(pairs)]) + np.eye(k) * 1e-9)
    expected = np.array(found[1 + len(pairs) :], float)
    done, before = 0, math.inf
    while True:
        gap = (expected - targets) / total
        slope, value = weigh @ gap, float(gap @ weigh @ gap)
        steps_of = frame.withColumn("move", F.expr(f"abs(rate - {moved(slope)})"))
        at = steps_of.agg(F.expr("coalesce(max(move), 0D)"), *sums_of(f"if(move > 0, {x}, 0D)" for x in products)).first()
        if at[0] <= TOLERANCE or (at[0] <= SLIGHT and before - value <= SLIGHT * value):
            break
        before = value
        if done == steps:
            warnings.warn(f"rates still move by {at[0]:.2g} after {steps} steps", stacklevel=2)
            break
        curve = weigh @ gram_of(at[1:])
        tried = [slope] + [np.linalg.solve(curve + damping * np.eye(k), slope) for damping in DAMPINGS]
        tries = frame.select("tokens", *(f"p{i}" for i in range(k)), *(F.expr(moved(d)).alias(f"rate{n}") for n, d in enumerate(tried)))
        sums = tries.agg(*sums_of(f"rate{n} * tokens * p{i}" for n in range(len(tried)) for i in range(k))).first()
        reached = np.array(sums, float).reshape(len(tried), k)
        best = int(np.argmin([float(g @ weigh @ g) for g in (reached - targets) / total]))
        frame, expected = frame.withColumn("rate", F.expr(moved(tried[best]))), reached[best]
        done += 1
        if done % 4 == 0:  # the expression grows by a step each time
            frame = cut(frame)
    rates = cut(frame.select("cell", "rate"))
    return members.withColumn("cell", cell).join(F.broadcast(rates), "cell").drop("cell"), [float(x) for x in expected]


def mix(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float] | None = None, least: float = 0.0, most: float = 8.0, budget: float | None = 1.0, seed: int = 7) -> DataFrame:
    """One row per row of ``docs``: __uid, doc_id, tokens, domain (the likeliest), posterior, rate, copies, target_share, reached_share.

    ``labelled`` has doc_id and domain. ``weights`` are target shares a domain (equal ones by default), and the targets
    add up to ``budget`` times the natural tokens; with a budget of None, to the least with which no domain need fall
    under ``least`` times its natural tokens. The last two columns are a domain's share of all expected tokens as asked
    for and as the rates give it: where bounds keep a target out of reach they differ, and a warning names the domains.
    A weight of a domain without labelled rows can't be met: there is a warning, and the others share its part.

    copies is the rate's whole part, plus one with the probability of the rest, by a keyed hash of doc_id and tokens,
    so that it is the same in every run. Null and empty texts have no tokens, the prior posteriors and a rate like
    others of such membership. Without labels everything is of the domain 'none'. Null and repeated doc_ids are rows of
    their own; an empty table gives an empty result; other columns don't matter.
    """
    domains, table, priors = fit_domains(docs, labelled)
    if not domains:
        domains, priors = ["none"], [0.0]
        table = table.select("__bucket", F.lit(0.0).alias("w0"))
        weights = None
    k = len(domains)
    share = {d: (1 / k if weights is None else max(0.0, float(weights.get(d, 0.0)))) for d in domains}
    if absent := sorted(d for d, w in (weights or {}).items() if w > 0 and d not in share):
        warnings.warn(f"no labelled rows of {', '.join(absent)}: the other domains share their weight", stacklevel=2)
    whole = sum(share.values())
    share = {d: (x / whole if whole else 1 / k) for d, x in share.items()}
    members = cut(posteriors(docs, table, priors))
    natural = members.agg(F.coalesce(F.sum("tokens"), F.lit(0)), *(F.coalesce(F.sum(F.col("tokens") * F.col(f"p{i}")), F.lit(0.0)) for i in range(k))).first()
    total = float(natural[0])
    if budget is None:
        needed = [least * n / share[d] for d, n in zip(domains, natural[1:], strict=True) if share[d] > 0]
        budget = max(1.0, max(needed, default=0.0) / total) if total else 1.0
    rated, expected = fit_rates(members, [budget * total * share[d] for d in domains], least, most)
    reached = {d: (x / sum(expected) if sum(expected) else share[d]) for d, x in zip(domains, expected, strict=True)}
    if missed := [f"{d} ({reached[d]:.3f} of {share[d]:.3f})" for d in domains if abs(reached[d] - share[d]) > 0.005]:
        warnings.warn(f"the bounds keep these shares from their targets: {', '.join(missed)}", stacklevel=2)
    best = F.greatest(*(f"p{i}" for i in range(k))) if k > 1 else F.col("p0")
    of = F.lit(k - 1)
    for i in range(k - 2, -1, -1):
        of = F.when(F.col(f"p{i}") >= best, F.lit(i)).otherwise(of)
    name = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("k") + 1)
    chance = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("tokens")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    copies = (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")).cast("int")
    return rated.withColumn("k", of).select(
        "__uid", "doc_id", "tokens", name(domains).alias("domain"), best.alias("posterior"), "rate", copies.alias("copies"),
        name([share[d] for d in domains]).alias("target_share"), name([reached[d] for d in domains]).alias("reached_share"),
    )


def mixed_documents(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float] | None = None, least: float = 0.0, most: float = 8.0, budget: float | None = 1.0) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as ``mix`` says. With ``least`` 1 none is left out."""
    uid, row, copies, copy = (unused(docs, x) for x in ("uid", "row", "copies", "copy"))
    decided = mix(docs, labelled, weights, least, most, budget).where("copies > 0").select(F.col("__uid").alias(row), F.col("copies").alias(copies))
    numbered = docs.withColumn(uid, F.monotonically_increasing_id())
    out = numbered.join(decided, F.col(uid) == F.col(row)).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return out.drop(uid, row, copies, copy)


def quality_domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain ('clean_high', 'clean_low', 'toxic_high', 'toxic_low') of the labels table."""
    name = F.concat(F.when(F.col("toxic") == 1, "toxic_").otherwise("clean_"), F.when(F.col("quality") == 1, "high").otherwise("low"))
    return labels.where("toxic in (0, 1) and quality in (0, 1)").select("doc_id", name.alias("domain"))
