"""Exact deduplication with Grace hash tables.

Records are partitioned to spill files by successive bits of a digest, recursively, until a bucket fits an
open-addressing table; the table compares complete contents. It runs twice: over each input partition, so that one
row a distinct text and partition goes to the shuffle however many copies there are, and over each shuffle partition.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import bounded_batches, unused

FANOUT_BITS = 4
MAX_DEPTH = 12
BUDGET = 48 << 20
#: Bytes that a member (two numbers and its list slot) is reckoned at.
MEMBER_BYTES = 120


class OpenTable:
    """Open addressing with linear probing; a slot matches on the digest's first 8 bytes and then on the whole content."""

    def __init__(self, slots: int = 1024):
        self.mask = slots - 1
        self.slots = [-1] * slots
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.digests: list[bytes] = []
        self.members: list[list[tuple]] = []

    def insert(self, digest: bytes, content: bytes, member: tuple) -> int:
        """Add a member; gives the bytes by which the table grew."""
        h = int.from_bytes(digest[:8], "little")
        at = h & self.mask
        slots = self.slots
        while (k := slots[at]) >= 0:
            if self.hashes[k] == h and self.contents[k] == content:
                self.members[k].append(member)
                return MEMBER_BYTES
            at = (at + 1) & self.mask
        slots[at] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.digests.append(digest)
        self.members.append([member])
        if 2 * len(self.hashes) > self.mask:
            self._grow()
        return len(content) + MEMBER_BYTES + 200

    def _grow(self) -> None:
        self.mask = 4 * (self.mask + 1) - 1
        self.slots = [-1] * (self.mask + 1)
        for k, h in enumerate(self.hashes):
            at = h & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = k

    def groups(self) -> Iterator[tuple[bytes, bytes, list[tuple]]]:
        yield from zip(self.digests, self.contents, self.members, strict=True)


def _read(path: str) -> Iterator[tuple[bytes, bytes, tuple]]:
    with open(path, "rb") as f:
        while True:
            try:
                yield from pickle.load(f)
            except EOFError:
                return


class _Spill:
    """Buffered append-only files, one a value of the next digest bits."""

    def __init__(self, folder: str, depth: int):
        self.depth, self.held = depth, 0
        self.paths = [os.path.join(folder, f"{depth}-{i}") for i in range(1 << FANOUT_BITS)]
        self.buffers: list[list] = [[] for _ in self.paths]

    def add(self, record: tuple[bytes, bytes, tuple]) -> None:
        # Bits from the digest's tail: the table probes with those of its head.
        bits = int.from_bytes(record[0][8:16], "little") >> (FANOUT_BITS * self.depth)
        self.buffers[bits & ((1 << FANOUT_BITS) - 1)].append(record)
        self.held += len(record[1]) + MEMBER_BYTES
        if self.held > 8 << 20:
            self.flush()

    def flush(self) -> None:
        for path, buffer in zip(self.paths, self.buffers, strict=True):
            if buffer:
                with open(path, "ab") as f:
                    pickle.dump(buffer, f, protocol=pickle.HIGHEST_PROTOCOL)
                buffer.clear()
        self.held = 0


def grace_groups(records: Iterator[tuple[bytes, bytes, tuple]], budget: int = BUDGET, folder: str | None = None, depth: int = 0) -> Iterator[tuple[bytes, bytes, list[tuple]]]:
    """Groups of equal contents as (digest, content, members), whatever their number, in about ``budget`` bytes.

    ``records`` are (digest, content, member). A bucket over the budget goes to spill files by the next bits of the
    digest. A bucket with one distinct content is never split: its copies are members of a few bytes each. At
    ``MAX_DEPTH`` (48 equal bits) the table grows over the budget, as splitting can't help any more.
    """
    own = folder is None
    folder = folder or tempfile.mkdtemp(prefix="grace-")
    try:
        table, used, spill = OpenTable(), 0, None
        for record in records:
            if spill is not None:
                spill.add(record)
                continue
            used += table.insert(*record)
            if used > budget and len(table.hashes) > 1 and depth < MAX_DEPTH:
                deeper = tempfile.mkdtemp(dir=folder)
                spill = _Spill(deeper, depth)
                for digest, content, members in table.groups():
                    for m in members:
                        spill.add((digest, content, m))
                table = OpenTable()
        if spill is None:
            yield from table.groups()
            return
        spill.flush()
        for path in spill.paths:
            if os.path.exists(path):
                yield from grace_groups(_read(path), budget, os.path.dirname(path), depth + 1)
                os.remove(path)
    finally:
        if own:
            shutil.rmtree(folder, ignore_errors=True)


def _best(members: list[tuple]) -> tuple:
    """The member with the largest doc_id (nulls last), then the largest row number."""
    return max(members, key=lambda m: (m[0] is not None, m[0] or 0, m[1]))


LOCAL = pa.schema([("__doc", pa.int64()), ("__uid", pa.int64()), ("__rep", pa.int64()), ("__sha", pa.binary()), ("__n", pa.int64()), ("__body", pa.binary())])
GLOBAL = pa.schema([("__rep", pa.int64()), ("__keep_uid", pa.int64()), ("__keep_doc", pa.int64()), ("__size", pa.int64())])
LOCAL_DDL = "__doc long, __uid long, __rep long, __sha binary, __n long, __body binary"
GLOBAL_DDL = "__rep long, __keep_uid long, __keep_doc long, __size long"


def _batches(rows: Iterator[tuple], schema: pa.Schema, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + (len(row[-1]) if isinstance(row[-1], bytes) else 0)
        if size > limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _local(budget: int, bodies: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for b in batches:
                for doc, uid, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    body = body.lower()  # bytes: A-Z only
                    yield hashlib.sha256(body).digest(), body, (doc, uid)

        def rows():
            for digest, content, members in grace_groups(records(), budget):
                best = _best(members)
                for m in members:
                    first = m is best
                    if first or not bodies:
                        yield (m[0], m[1], best[1], digest, len(members) if first else None, content if first and bodies else None)

        yield from _batches(rows(), LOCAL)

    return run


def _global(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for b in batches:
                for doc, uid, digest, n, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    yield digest, body, (doc, uid, n)

        def rows():
            for _, _, members in grace_groups(records(), budget):
                best, size = _best(members), sum(m[2] for m in members)
                for m in members:
                    yield (m[1], best[1], best[0], size)

        yield from _batches(rows(), GLOBAL)

    return run


def _decided(numbered: DataFrame, budget: int) -> DataFrame:
    """One row a text and input partition: __rep, __keep_uid, __keep_doc, __size."""
    bounded_batches(numbered.sparkSession)
    rows = numbered.select(F.col("doc_id").cast("long").alias("__doc"), "__uid", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("__body"))
    reps = rows.mapInArrow(_local(budget, True), LOCAL_DDL)
    return reps.select("__doc", "__uid", "__sha", "__n", "__body").repartition("__sha").mapInArrow(_global(budget), GLOBAL_DDL)


def grace_dedup(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are after lower-casing A-Z. ``docs`` must be repeatable (files or a checkpoint):
    rows are known by their place in it. Null text counts as empty. Of equal texts the row with the largest doc_id
    stays; null doc_ids come last, and of rows with the same doc_id exactly one, the last read, is ``kept``. An empty
    table gives an empty result. Other columns of ``docs`` are not touched, whatever their names.
    """
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("__uid"))
    decided = _decided(numbered, budget)
    rows = numbered.select(F.col("doc_id").cast("long").alias("__doc"), "__uid", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("__body"))
    members = rows.mapInArrow(_local(budget, False), LOCAL_DDL).select("__doc", "__uid", "__rep", "__sha")
    return members.join(decided, "__rep").select(
        F.col("__doc").alias("doc_id"),
        F.col("__keep_doc").alias("keep_id"),
        F.col("__size").alias("group_size"),
        (F.col("__uid") == F.col("__keep_uid")).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``grace_dedup`` keeps."""
    uid, kept = unused(docs, "uid"), unused(docs, "kept")
    numbered = docs.withColumn(uid, F.monotonically_increasing_id())
    first = _decided(numbered.select("doc_id", "text", F.col(uid).alias("__uid")), budget).where("__rep = __keep_uid").select(F.col("__rep").alias(kept))
    return numbered.join(first, F.col(uid) == F.col(kept), "left_semi").drop(uid)
