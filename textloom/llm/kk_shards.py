"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Differencing combines the two partial partitions with the largest spread, one ordered against the other, until one is
left. Up to ``HEAVY`` groups are differenced together in one task, which leaves shards a byte or so apart. Of more
groups the heaviest are, and the light rest is dealt out by buckets of a digest, each differenced together with what the
heavy ones leave to fill; the last bucket is differenced after all others and evens out what they left. A group larger
than the mean of what is left has a shard to itself. Only sums by shard reach the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import cut, hot_join

#: Bytes that each document counts besides its text.
OVERHEAD = 8
#: Groups that are differenced together in one task (some 40 MB), and groups that a bucket of the rest is meant to hold.
HEAVY, BUCKET_GROUPS = 50_000, 50_000
#: A key with over a thousandth of all rows is hot; there are fewer than 1,000, and their rows are spread over so many.
SALTS = 64


def difference(vectors: Sequence[Sequence[int]], k: int) -> list[list[int]]:
    """For each vector of ``k`` sums, the part that each of its entries goes to.

    Classic number partitioning is the case of vectors with one entry that isn't 0. Ties go to the earlier vector.
    """
    if not vectors:
        return []
    bins, order, nodes, heap = range(k), [], [], []
    for i, v in enumerate(vectors):
        at = sorted(bins, key=v.__getitem__)
        order.append(at)
        sums = [v[j] for j in at]
        nodes.append(None)
        heap.append((sums[0] - sums[-1], i, sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        both = [p + q for p, q in zip(reversed(x), y, strict=True)]  # a's largest with b's smallest
        at = sorted(bins, key=both.__getitem__)
        base = both[at[0]]
        nodes.append((a, b, at))
        heapq.heappush(heap, (both[at[0]] - both[at[-1]], len(nodes) - 1, [both[j] - base for j in at]))
    labels: dict[int, list[int]] = {len(nodes) - 1: list(bins)}
    out: list[list[int]] = [[]] * len(vectors)
    for node in range(len(nodes) - 1, -1, -1):
        mine = labels.pop(node)
        if nodes[node] is None:
            placed = [0] * k
            for position, entry in enumerate(order[node]):
                placed[entry] = mine[position]
            out[node] = placed
        else:
            a, b, at = nodes[node]
            lab = [0] * k
            for position, entry in enumerate(at):
                lab[entry] = mine[position]
            labels[b] = lab
            labels[a] = lab[::-1]
    return out


def level(sums: Sequence[int], more: int) -> list[int]:
    """How ``more`` is to be added to ``sums`` so that the lowest of them reach one level: amounts that add up to ``more``."""
    order = sorted(range(len(sums)), key=sums.__getitem__)
    filled, n = 0, 0
    while n < len(order) and (n == 0 or n * sums[order[n]] - filled < more):
        filled += sums[order[n]]
        n += 1
    out, left = [0] * len(sums), more
    for i, j in enumerate(order[:n]):
        out[j] = max(0, (more + filled + n - 1 - i) // n - sums[j])
        left -= out[j]
    out[order[0]] += left
    return out


def partition_sizes(sizes: Sequence[int], k: int, sums: Sequence[int] | None = None) -> list[int]:
    """The part of each of ``sizes``, by one differencing of all; ``sums`` is what the parts hold already.

    A size larger than the mean of what is left goes to a part of its own, the emptiest, which gets nothing more.
    """
    held = list(sums) if sums is not None else [0] * k
    out = [0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    left, free, first = sum(sizes), set(range(k)), 0
    while len(free) > 1 and first < len(order):
        whole = left + sum(held[j] for j in free)
        over = [j for j in free if held[j] * len(free) > whole]
        if over:
            free.remove(max(over, key=lambda j: (held[j], j)))
        elif sizes[order[first]] * len(free) > whole:
            emptiest = min(free, key=lambda j: (held[j], j))
            out[order[first]] = emptiest
            held[emptiest] += sizes[order[first]]
            left -= sizes[order[first]]
            free.remove(emptiest)
            first += 1
        else:
            break
    parts, rest = sorted(free), order[first:]
    n = len(parts)
    base = [held[j] for j in parts]
    placed = difference([base] + [[int(sizes[i])] + [0] * (n - 1) for i in rest], n)
    where = {label: parts[i] for i, label in enumerate(placed[0])}  # what the parts hold already says which is which
    for i, p in zip(rest, placed[1:], strict=True):
        out[i] = where[p[0]]
    return out


def _dealt(groups: DataFrame, shards: int, key: str, base: Callable[[int, int], Sequence[int]]) -> DataFrame:
    """``groups`` (group, bytes, n and ``key``) with column shard: each key's groups differenced in one task."""

    def within(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["bytes", "group"], ascending=[False, True], kind="stable")
        sizes = part["bytes"].tolist()
        return part.assign(shard=partition_sizes(sizes, shards, base(int(part[key].iloc[0]), sum(sizes)))).astype({"shard": "int32"})[["group", "bytes", "n", "shard"]]

    return cut(groups.groupBy(key).applyInPandas(within, "group binary, bytes long, n long, shard int"))


def _sums(placed: DataFrame, shards: int) -> list[int]:
    out = [0] * shards
    for shard, size in placed.groupBy("shard").agg(F.sum("bytes")).collect():  # one row a shard
        out[shard] = int(size)
    return out


def place_groups(groups: DataFrame, shards: int, heavy: int = HEAVY, bucket_groups: int = BUCKET_GROUPS) -> DataFrame:
    """``groups`` (group binary, bytes, n) with column shard. Up to ``heavy`` groups are differenced all together."""
    total = groups.count()
    none = F.lit(0).alias("bucket")
    if total <= heavy:
        return _dealt(groups.select("group", "bytes", "n", none), shards, "bucket", lambda *_: [0] * shards)
    # The size that so many groups reach, from a histogram of sizes: at most 64 cells an octave reach the driver.
    cell = F.floor(F.log2(F.col("bytes").cast("double")) * 64).cast("int")
    cells = sorted(((r[0], r[1]) for r in groups.groupBy(cell.alias("cell")).count().collect()), reverse=True)
    least, held = cells[0][0] + 1, 0
    for c, n in cells:
        if held + n > heavy:
            break
        least, held = c, held + n
    large = _dealt(groups.where(cell >= least).select("group", "bytes", "n", none), shards, "bucket", lambda *_: [0] * shards)
    buckets = -(-(total - held) // bucket_groups)
    small = groups.where(cell < least).select("group", "bytes", "n", F.pmod(F.xxhash64("group"), F.lit(buckets)).cast("int").alias("bucket"))
    sums, rest = _sums(large, shards), small.agg(F.sum("bytes")).first()[0]
    quota = level(sums, int(rest))
    high = max(quota)
    # A bucket starts with what its part of the quotas lacks to the highest of them.
    early = _dealt(small.where(F.col("bucket") > 0), shards, "bucket", lambda _, own: [(high - q) * own // max(1, int(rest)) for q in quota])
    placed = large.unionByName(early)
    now = _sums(placed, shards)
    return placed.unionByName(_dealt(small.where("bucket = 0"), shards, "bucket", lambda *_: now))


def balanced_shards(docs: DataFrame, shards: int = 24, heavy: int = HEAVY) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    size is the text's UTF-8 bytes plus 8. Equal texts form an indivisible group and share a shard; null texts form a
    group of their own, apart from empty ones. Slots run from 0 without gaps in each shard. Rows with null or repeated
    doc_ids get slots of their own. An empty table gives an empty result; fewer groups than shards leave shards empty.
    The same rows give the same shards; slots follow from doc_id, up to rows equal in doc_id and text.
    """
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id"),
        F.coalesce(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), F.lit(b"null")).alias("group"),
        (F.octet_length(body) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.monotonically_increasing_id().alias("place"),
    )
    rows = cut(rows)
    total = rows.count()
    groups = cut(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    placed = place_groups(groups, shards, heavy).select("group", "n", "shard")
    where = hot_join(rows, placed, "group", "n", total, F.col("place"))
    # Slots: rows of a shard by a hash of doc_id and text, then by these; rows equal in both are spread if they are many.
    subs = max(16, min(4096, total // 50_000))
    equal = rows.groupBy("doc_id", "text_crc32").agg(F.count("*").alias("n")).where(F.col("n") * 1000 > F.lit(total)).select(F.col("doc_id").alias("hot_id"), F.col("text_crc32").alias("hot_crc"))
    where = where.join(F.broadcast(equal), F.col("doc_id").eqNullSafe(F.col("hot_id")) & (F.col("text_crc32") == F.col("hot_crc")), "left")
    salt = F.when(F.col("hot_crc").isNull(), F.lit(0)).otherwise(F.pmod("place", F.lit(SALTS)))
    sub = F.pmod(F.xxhash64("doc_id", "text_crc32") + salt, F.lit(subs)).cast("int")
    where = cut(where.select("doc_id", "size", "text_crc32", "shard", sub.alias("sub")))
    offsets = where.groupBy("shard", "sub").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1))
    offsets = offsets.select("shard", "sub", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "sub").orderBy("doc_id", "text_crc32", "size"))
    return where.withColumn("place", place).join(F.broadcast(offsets), ["shard", "sub"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.col("place") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
