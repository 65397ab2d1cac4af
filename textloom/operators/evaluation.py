"""Task evaluation: evaluators, program runs, prompt spans, model arithmetic, sampling of names."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import arrays
from textloom.functions.ids import draw, pick


def shape(depth: Column, aspect: int = 64, head: int = 128) -> tuple[Column, Column]:
    """Model width, a multiple of the head's, and heads of a depth."""
    heads = F.ceil(depth * aspect / F.lit(float(head)))
    return (heads * head).cast("long"), heads.cast("long")


def matmul_parameters(depth: Column, width: Column, vocab: int) -> Column:
    """Twelve square matrices' worth a layer, and the output head."""
    return depth * 12 * width * width + width * vocab


def flops_per_token(parameters: Column, heads: Column, head: int, windows: Column, length: int) -> Column:
    """Six a matmul parameter, and attention by each layer's window (-1: all of ``length``)."""
    seen = F.transform(windows, lambda w: F.when(w < 0, F.lit(length)).otherwise(F.least(w, F.lit(length))).cast("long"))
    return parameters * 6 + F.aggregate(seen, F.lit(0).cast("long"), lambda a, w: a + w) * heads * 12 * head


def throughput(tokens: Column, seconds: Column, flops: Column, peak: float, devices: int = 1) -> Column:
    """{tokens_per_second, mfu in percent}; tokens are cut to whole ones."""
    return F.struct((tokens / seconds).cast("long").alias("tokens_per_second"), (F.lit(100.0) * flops * tokens / seconds / (peak * devices)).alias("mfu"))


def prompt_span(kind: str, tokens: Column) -> Column:
    """[{start, end}] of the part that differs (multiple choice), that is shared at the end (schema), or that continues (two prompts)."""
    ends = F.transform(tokens, lambda t: F.size(t))
    if kind == "multiple_choice":
        n = arrays.common_prefix(tokens)
        return F.transform(ends, lambda e: F.struct(n.alias("start"), e.alias("end")))
    if kind == "schema":
        n = arrays.common_suffix(tokens)
        return F.transform(ends, lambda e: F.struct((e - n).alias("start"), e.alias("end")))
    if kind == "language_modeling":
        ok = (F.size(tokens[0]) < F.size(tokens[1])) & (arrays.common_prefix(tokens) == F.size(tokens[0]))
        return F.when(ok, F.array(F.struct(F.size(tokens[0]).alias("start"), F.size(tokens[1]).alias("end"))))
    raise ValueError(kind)


def novel_name(first: list[str], second: list[str], seed: int, *key: Column | str) -> Column:
    """A name of two drawn parts."""
    return F.concat(pick(first, seed, *key, "first"), pick(second, seed, *key, "second"))


def categories(table: dict[str, list[str]], n: int, seed: int, key: Column) -> Column:
    """[{category, item}]: ``n`` distinct categories by hash rank and an item of each."""
    from textloom.functions.ids import stream_key

    all_of = F.array(*(F.struct(stream_key(seed, "category", key, c).alias("h"), F.lit(c).alias("category"), pick(items, seed, "item", key, c).alias("item")) for c, items in table.items()))
    return F.transform(F.slice(F.array_sort(all_of), 1, n), lambda x: F.struct(x["category"].alias("category"), x["item"].alias("item")))


def year(seed: int, low: int, high: int, *key: Column | str) -> Column:
    return draw(high - low, seed, *key) + low


def run_programs(rows: DataFrame, program: str, allow: bool = False, seconds: int = 5, megabytes: int = 256) -> DataFrame:
    """``rows`` with success, timed_out and output of each program, run in a process of its own with limits.

    This runs what it is given and is no security sandbox: it must be allowed explicitly, and only on machines where
    any program may run.
    """
    if not allow:
        raise PermissionError("running programs must be allowed explicitly")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import resource
        import subprocess
        import sys
        import tempfile

        def limits() -> None:
            resource.setrlimit(resource.RLIMIT_AS, (megabytes << 20, megabytes << 20))
            resource.setrlimit(resource.RLIMIT_CPU, (seconds, seconds))
            resource.setrlimit(resource.RLIMIT_FSIZE, (1 << 20, 1 << 20))

        for b in batches:
            out = []
            for code in b[program]:
                with tempfile.TemporaryDirectory() as folder:
                    try:
                        p = subprocess.run([sys.executable, "-I", "-c", code or ""], cwd=folder, capture_output=True, text=True, timeout=seconds, preexec_fn=limits, env={}, check=False)
                        out.append((p.returncode == 0, False, p.stdout[:10_000]))
                    except subprocess.TimeoutExpired:
                        out.append((False, True, ""))
            yield b.assign(success=[x[0] for x in out], timed_out=[x[1] for x in out], output=[x[2] for x in out])

    return rows.mapInPandas(run, f"{fields}, success boolean, timed_out boolean, output string")


@dataclass(frozen=True)
class Task:
    """A task: how its answers are judged ('generative' or 'categorical'), and a slice of its examples.

    ``correct`` gives the verdict from the columns completion and answer (generative), or prediction, answer and letters
    (categorical).
    """

    name: str
    eval_type: str
    correct: Callable[[], Column]
    start: int = 0
    stop: int | None = None
    step: int = 1

    def __post_init__(self):
        if self.eval_type not in ("generative", "categorical"):
            raise ValueError(f"unsupported task evaluation type {self.eval_type!r}")
        if self.start < 0 or self.step < 1 or (self.stop is not None and self.stop < self.start):
            raise ValueError("a slice needs a start of 0 or more, a stop from it on and a step of 1 or more")

    def size(self, examples: int) -> int:
        """Examples in the slice of so many."""
        stop = examples if self.stop is None else self.stop
        n = -(-(stop - self.start) // self.step)
        if n < 0:
            raise ValueError("the slice begins after the last example")
        return n

    def examples(self, rows: DataFrame, index: str = "local_idx") -> DataFrame:
        """The slice's rows of ``rows`` with idx, their place in it."""
        at = F.col(index) - self.start
        inside = (at >= 0) & (at % self.step == 0)
        if self.stop is not None:
            inside = inside & (F.col(index) < self.stop)
        return rows.where(inside).withColumn("idx", F.floor(at / self.step).cast("long"))


def evaluate(tasks: list[Task], rows: DataFrame, most: int | None = None) -> DataFrame:
    """task, eval_type, n, passed, accuracy of answered examples (task, local_idx, sample, and what the verdicts read).

    A generative problem counts once, if any of its samples is right; a categorical one has one prediction. Tasks take
    their own slices, and of these the first ``most``. Tasks without rows give none.
    """
    out = None
    for task in tasks:
        own = task.examples(rows.where(F.col("task") == task.name))
        if most is not None:
            own = own.where(F.col("idx") < most)
        judged = own.withColumn("ok", F.coalesce(task.correct(), F.lit(False)))
        problems = judged.groupBy("idx").agg(F.bool_or("ok").alias("ok")) if task.eval_type == "generative" else judged.select("idx", "ok")
        one = problems.agg(F.count("*").alias("n"), F.count_if("ok").alias("passed")).where("n > 0")
        one = one.select(F.lit(task.name).alias("task"), F.lit(task.eval_type).alias("eval_type"), "n", "passed", (F.col("passed") / F.col("n")).alias("accuracy"))
        out = one if out is None else out.unionByName(one)
    return out
