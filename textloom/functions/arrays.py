"""Column expressions on token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inputs(tokens: Column) -> Column:
    return F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0)))


def targets(tokens: Column) -> Column:
    return F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))


def masked_targets(tokens: Column, mask: Column, content: Column | None = None) -> Column:
    """Targets with -1 where the mask of the token is 0, and from place ``content`` - 1 on (padding)."""
    shifted = F.zip_with(targets(tokens), targets(mask), lambda t, m: F.when(m == 1, t).otherwise(F.lit(-1)))
    if content is None:
        return shifted
    return F.transform(shifted, lambda t, i: F.when(i >= content - 1, F.lit(-1)).otherwise(t))


def common_prefix(sequences: Column) -> Column:
    """Length of the common prefix of an array of arrays: the least of what the first one shares with each."""

    def shared(first: Column, other: Column) -> Column:
        # Side by side, in one pass: an element by its place would make the arrays anew at each place.
        at = F.array_position(F.zip_with(first, other, lambda a, b: a != b), True)
        return F.when(at == 0, F.least(F.size(first), F.size(other))).otherwise(at - 1).cast("int")

    # Variables of their own, so that the sequences and the first of them are made once.
    of = lambda all_of: F.transform(F.array(all_of[0]), lambda first: F.array_min(F.transform(all_of, lambda s: shared(first, s))))[0]
    return F.transform(F.array(sequences), of)[0]


def common_suffix(sequences: Column) -> Column:
    return common_prefix(F.transform(sequences, lambda s: F.reverse(s)))


def candidate_span(full: Column, context: Column) -> Column:
    """{start, merged}: the first candidate token after bos and the context's prefix, and whether the boundary was merged away."""
    # Side by side, in one pass: an element by its place would make both arrays anew at each place.
    differs = F.array_position(F.zip_with(full, context, lambda a, b: ~a.eqNullSafe(b)), True)
    n = F.when(differs == 0, F.size(full)).otherwise(differs - 1).cast("int")
    return F.struct((n + 1).alias("start"), (n != F.size(context)).alias("merged"))


def left_crop(tokens: Column, most: int) -> Column:
    return F.when(F.size(tokens) > most, F.slice(tokens, -most, most)).otherwise(tokens)


def crop_shift(tokens: Column, most: int) -> Column:
    """How far places move in ``left_crop``."""
    return F.greatest(F.size(tokens) - most, F.lit(0))


def right_pad(tokens: Column, length: Column, pad: int) -> Column:
    return F.concat(tokens, F.array_repeat(F.lit(pad), F.greatest(length - F.size(tokens), F.lit(0))))


def span_mean(losses: Column, start: Column, end: Column) -> Column:
    """Mean of the losses that predict tokens start to end - 1: places start - 1 to end - 2."""
    span = F.slice(losses, start, end - start)
    return F.aggregate(span, F.lit(0.0), lambda a, x: a + x) / F.size(span)


def byte_ids(text: Column) -> Column:
    """Ids of a vocabulary of single bytes: the bytes' values."""
    one_a_byte = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    return F.transform(F.filter(F.split(one_a_byte, ""), lambda c: c != ""), lambda c: F.ascii(c))


def ema(values: Column, beta: float) -> Column:
    """Exponential averages with bias correction of an ordered array."""
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        s = a["s"] * beta + x * (1 - beta)
        n = F.size(a["out"]) + 1
        return F.struct(s.alias("s"), F.concat(a["out"], F.array(s / (1 - F.pow(F.lit(beta), n)))).alias("out"))

    return F.aggregate(values, start, step)["out"]
