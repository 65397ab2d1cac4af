"""Connected components by contraction, without a driver-side graph."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition's links: each node with the smallest node that it reaches there."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := parent.setdefault(root, root)) != root:
            root = p
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ru, rv = find(u), find(v)
            if ru != rv:
                parent[max(ru, rv)] = min(ru, rv)
    nodes = list(parent)
    for s in range(0, len(nodes), 65_536):
        part = nodes[s : s + 65_536]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["node", "root"])


#: Links that one task joins at most: a few dozen MB of its memory.
LINKS_A_TASK = 250_000


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of ``links`` (columns a and b, long); nodes share a label if and only if they are connected.

    Each round joins what the links of a task connect, hangs every node under the smallest of its roots in all tasks,
    and goes on with the links between the roots of one node. Any dealing of the links will do, so none is shuffled for
    this; tasks get ``LINKS_A_TASK`` or less. Only roots stay, at most half of the nodes, so the rounds are logarithmic
    in the links. Self-links give a label too. No links: an empty result.
    """
    rounds: list[DataFrame] = []
    links = cut(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    while True:
        tasks = -(-links.count() // LINKS_A_TASK)
        stars = cut(links.coalesce(max(1, tasks)).mapInArrow(_stars, "node long, root long"))
        if tasks <= 1:
            labels = stars.withColumnRenamed("root", "label")
            break
        up = cut(stars.groupBy("node").agg(F.min("root").alias("label"), F.max("root").alias("other")))
        rounds.append(up.select("node", "label"))
        split = up.where("label <> other").select("node", "label")
        links = cut(stars.join(split, "node").where("root <> label").select(F.col("root").alias("a"), F.col("label").alias("b")).distinct())
    while rounds:
        later = labels.select(F.col("node").alias("label"), F.col("label").alias("__later"))
        labels = cut(rounds.pop().join(later, "label", "left").select("node", F.coalesce("__later", "label").alias("label")))
    return labels
