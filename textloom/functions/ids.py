"""Stable ids and portable randomness by SHA-256, the same in every engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(parts: Sequence[Column | str | int]) -> list[Column]:
    return [(p if isinstance(p, Column) else F.lit(str(p))).cast("string") for p in parts]


def stable_id(*parts: Column | str | int) -> Column:
    """First 16 hex digits of the SHA-256 of the parts, each after a zero byte; order matters."""
    return F.substring(F.sha2(F.concat(*(x for p in _parts(parts) for x in (F.lit("\0"), p))), 256), 1, 16)


def stream_key(seed: int, *names: Column | str | int) -> Column:
    """Hex SHA-256 of the seed and the names, each name after a zero byte: an ordering key instead of a shuffle."""
    return F.sha2(F.concat(F.lit(str(seed)), *(x for p in _parts(names) for x in (F.lit("\0"), p))), 256)


def stream_seed(seed: int, *names: Column | str | int) -> Column:
    """The first 8 bytes of ``stream_key`` as an unsigned number (decimal(20,0))."""
    return F.conv(F.substring(stream_key(seed, *names), 1, 16), 16, 10).cast("decimal(20,0)")


def draw(n: int | Column, seed: int, *names: Column | str | int) -> Column:
    """A number from 0 to n - 1 for the named stream, from the key's first 15 hex digits."""
    return F.pmod(F.conv(F.substring(stream_key(seed, *names), 1, 15), 16, 10).cast("long"), n if isinstance(n, Column) else F.lit(n))


def uniform(seed: int, *names: Column | str | int) -> Column:
    """A number in [0, 1) for the named stream, in steps of 2**-48."""
    return F.conv(F.substring(stream_key(seed, *names), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def pick(values: Sequence[str], seed: int, *names: Column | str | int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (draw(len(values), seed, *names) + 1).cast("int"))
