"""Validation: positional diffs of arms, contamination, leakage, frequency maps, checks."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Needles that an automaton in each worker holds at most; more are taken in parts, a pass over the documents each.
MOST_NEEDLES = 1_000_000


def aligned_diff(arms: DataFrame, names: list[str], base: str) -> DataFrame:
    """pos and each arm's digest where some arm differs from ``base`` (a missing document differs). One shuffle by position."""
    got = arms.groupBy("pos").agg(*(F.max(F.when(F.col("arm") == a, F.sha2(F.col("text").cast("binary"), 256))).alias(a) for a in names))
    differs = F.lit(False)
    for a in names:
        differs = differs | ~F.col(a).eqNullSafe(F.col(base))
    return got.where(differs)


def _parts(needles: list[tuple[int, str]] | DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The needles in lists of ``MOST_NEEDLES`` or so: a list as it is, a table (needle, string) by hash."""
    if not isinstance(needles, DataFrame):
        if len(needles) > MOST_NEEDLES:
            raise ValueError(f"over {MOST_NEEDLES} needles: give them as a table, which is taken in parts")
        yield needles
        return
    parts = max(1, -(-needles.count() // MOST_NEEDLES))
    for part in range(parts):
        some = needles if parts == 1 else needles.where(F.pmod(F.xxhash64("needle", "string"), F.lit(parts)) == part)
        yield [(r[0], r[1]) for r in some.select("needle", "string").toLocalIterator()]


def _search(docs: DataFrame, needles: list[tuple[int, str]], text: str, boundary: bool) -> DataFrame:
    import ahocorasick

    names = [c for c in docs.columns if c != text]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = ahocorasick.Automaton()
        by_text: dict[str, list[int]] = {}
        for i, s in needles:
            if s:
                by_text.setdefault(s, []).append(i)
        for s, ids in by_text.items():
            machine.add_word(s, (len(s), tuple(ids)))
        if by_text:
            machine.make_automaton()
        for b in batches:
            rows = []
            for n, t in enumerate(b[text]):
                ends: dict[int, list[int]] = {}
                for last, (size, ids) in machine.iter(t or "") if by_text else ():
                    start = last - size + 1
                    if boundary and start and unicodedata.category(t[start - 1])[0] in "LN":
                        continue
                    for i in ids:
                        count = ends.setdefault(i, [0, -1])
                        if start > count[1]:
                            ends[i] = [count[0] + 1, last]
                rows += [(n, i, c[0]) for i, c in ends.items()]
            out = b.iloc[[r[0] for r in rows]][names].reset_index(drop=True)
            out["needle"], out["n"] = pd.Series([r[1] for r in rows], dtype="int64"), pd.Series([r[2] for r in rows], dtype="int64")
            yield out

    return docs.mapInPandas(run, f"{fields}, needle long, n long")


def contamination(docs: DataFrame, needles: list[tuple[int, str]] | DataFrame, text: str = "text", boundary: bool = False) -> DataFrame:
    """``docs`` rows by needle that they hold: with needle and n (places that don't overlap).

    ``needles`` is a list, or a table (needle, string). Each ``MOST_NEEDLES`` of them are matched in one pass over the
    documents by an automaton, whose copy in each worker is of their size; more take more passes. With ``boundary``
    only places count that no letter or digit stands before.
    """
    found = None
    for some in _parts(needles):
        one = _search(docs, some, text, boundary)
        found = one if found is None else found.unionByName(one)
    return found


def boundary_leaks(docs: DataFrame, needles: DataFrame, text: str = "text") -> DataFrame:
    """Documents and needles (needle, string) where the string stands after something that is no letter or digit, once each."""
    return contamination(docs, needles.select(F.col("needle").cast("long"), "string"), text, boundary=True).drop("n")


def competing_dose(facts: DataFrame, position: str) -> DataFrame:
    """``facts`` with dose: the frequency of the fact that claims the competing value; of duplicates the last, and 0 if there is none."""
    claims = facts.groupBy("subject", "relation", F.col("value").alias("competing_value")).agg(F.max_by("frequency", position).alias("dose"))
    return facts.join(claims, ["subject", "relation", "competing_value"], "left").withColumn("dose", F.coalesce("dose", F.lit(0)))


def frequency_maps_differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (key, n) that only one of two maps has."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def first_match(rows: DataFrame, name: str, table: DataFrame) -> DataFrame:
    """``rows`` with value of the first table row (place, patterns, value) all of whose patterns the name holds. The table is a fixed one."""
    hit = F.forall("patterns", lambda p: F.contains(F.lower(F.col(name)), F.lower(p)))
    got = rows.select(name).distinct().join(F.broadcast(table), hit).groupBy(name).agg(F.min_by("value", "place").alias("value"))
    return rows.join(got, name, "left")


def check(name: str, ok: Column, detail: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), ok.alias("ok"), detail.cast("string").alias("detail"))


def append_missing(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new`` whose keys ``existing`` doesn't have."""
    return new.join(existing.select(*keys).distinct(), keys, "left_anti")


def shard_checks(files: DataFrame, columns: dict[str, list[str]], pattern: str = "shard_%05d.parquet") -> DataFrame:
    """place, arm, name, ok, detail of each arm's folder: names without gaps, two shards at least, one column 'text'.

    ``files`` has arm and file (a name); ``columns`` the columns of each arm's shards. An arm of ``columns`` without
    files fails.
    """
    spark = files.sparkSession
    arms = spark.createDataFrame([(i, a, c) for i, (a, c) in enumerate(columns.items())], "place int, arm string, columns array<string>")
    found = files.groupBy("arm").agg(F.array_sort(F.collect_list("file")).alias("names"))
    rows = arms.join(found, "arm", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    n = F.size("names")
    expected = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.format_string(pattern, i.cast("int")))).otherwise(F.array().cast("array<string>"))
    named = F.concat(n.cast("string"), F.lit(" shards"))
    one = F.size("columns") == 1
    checks = F.array(
        check("contiguous filenames", (F.col("names") == expected) & (n > 0), named),
        check("two shards or more", n >= 2, named),
        check("single column text", one & (F.col("columns")[0] == "text"), F.array_join("columns", ",")),
    )
    return rows.select("place", "arm", F.posexplode(checks).alias("i", "c")).select((F.col("place") * 3 + F.col("i")).cast("int").alias("place"), "arm", "c.name", "c.ok", "c.detail")


def slot_capacity(occurrences: DataFrame, slots: DataFrame) -> DataFrame:
    """needed, available, ok, error: whether there is an occurrence, and a slot for each."""
    counts = occurrences.agg(F.count("*").alias("needed")).join(slots.agg(F.count("*").alias("available")))
    few = F.format_string("%d slots are needed, the base has %d documents", "needed", "available")
    error = F.when(F.col("needed") == 0, "no occurrences to inject").when(F.col("needed") > F.col("available"), few)
    return counts.withColumn("error", error).withColumn("ok", F.col("error").isNull())


def failures(checks: DataFrame) -> DataFrame:
    """checks, failed and code (1 if any failed) of a table of checks (ok); a check that couldn't be made has failed."""
    failed = F.count_if(~F.coalesce(F.col("ok"), F.lit(False)))
    return checks.agg(F.count("*").alias("checks"), failed.alias("failed"), (failed > 0).cast("int").alias("code"))
