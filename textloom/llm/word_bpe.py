"""Byte-level BPE by a global shuffle of distinct words.

A worker splits its texts into pre-tokens, numbers the distinct ones of a chunk of documents and keeps each text as
the numbers in order of position. A chunk's distinct words go to their buckets by hash, where each word of the corpus
is encoded once; the ids go back to the chunk, whose texts are put together again by position. Occurrences themselves
are never shuffled by word, so a frequent word costs as much as there are chunks. Buckets and tasks follow from the
measured size of the corpus, so that what a task holds does not grow with it. Decoding joins the token-byte table, a
fixed vocabulary that is broadcast as arrays sorted by id.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import bounded_batches, parallelism

#: A chunk ends with the document that takes it over one of these.
CHUNK_WORDS, CHUNK_TOKENS, CHUNK_DOCS = 200_000, 2_500_000, 20_000
#: Bytes of text behind a bucket of words, which a task holds one at a time (5 million words at the very most), and behind a task.
BUCKET_BYTES, TASK_BYTES = 32 << 20, 256 << 20
#: Documents whose positions are packed together.
PACK_DOCS = 1000


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a ``.tiktoken`` file: base64 and number a line, 100,000 or so lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _chunks(batches: Iterator[pa.RecordBatch], pattern: str) -> Iterator[tuple[int, dict[str, int], list[tuple]]]:
    """(chunk, number of each distinct pre-token, [(doc_id, numbers by position)]), in the partition's order."""
    split = regex.compile(pattern).findall
    part, chunk = TaskContext.get().partitionId(), 0
    words: dict[str, int] = {}
    docs, tokens = [], 0
    for b in batches:
        for doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            found = split(text)
            for w in set(found).difference(words):
                words[w] = len(words)
            docs.append((doc, np.fromiter(map(words.__getitem__, found), np.uint32, len(found))))
            tokens += len(found)
            if len(words) >= CHUNK_WORDS or tokens >= CHUNK_TOKENS or len(docs) >= CHUNK_DOCS:
                yield (part << 24) + chunk, words, docs
                words, docs, tokens, chunk = {}, [], 0, chunk + 1
    if docs:
        yield (part << 24) + chunk, words, docs


def _squeeze(x: np.ndarray, press: zstandard.ZstdCompressor) -> bytes:
    """Numbers under 2**32, by byte plane: the high planes are nearly constant."""
    return press.compress(np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes())


def _spread(blob: bytes, press: zstandard.ZstdDecompressor) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(press.decompress(blob), np.uint8).reshape(4, -1).T).view(np.uint32).reshape(-1)


def _distinct(pattern: str, buckets: int):
    """A chunk's distinct words as one row a bucket of words: words in order, lengths, and their numbers in the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for chunk, words, _ in _chunks(batches, pattern):
            keys = np.array([w.encode() for w in words], object)
            bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in keys), np.int64, len(keys))
            order = np.lexsort((keys, bucket))
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for k in range(buckets):
                own = order[edges[k] : edges[k + 1]]
                if len(own):
                    mine = keys[own]
                    rows.append((k, chunk, press.compress(b"".join(mine)), _squeeze(np.fromiter(map(len, mine), np.uint32, len(own)), press), _squeeze(own, press)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "chunk", "words", "sizes", "numbers"])

    return run


def _positions(pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=6)
        for chunk, _, docs in _chunks(batches, pattern):
            for s in range(0, len(docs), PACK_DOCS):
                part = docs[s : s + PACK_DOCS]
                row = (chunk, [d for d, _ in part], [len(x) for _, x in part], _squeeze(np.concatenate([x for _, x in part]), press))
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()), strict=True)], names=["chunk", "docs", "sizes", "numbers"])

    return run


def _encoded(ranks, pattern: str):
    """Encode each distinct word of a bucket once; give each chunk the ids of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        piece = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})._encode_single_piece
        press, unpress = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        now, known = None, {}
        for b in batches:  # by bucket
            for bucket, chunk, joined, sizes, numbers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != now:
                    now, known = bucket, {}
                raw, ends = unpress.decompress(joined), np.cumsum(_spread(sizes, unpress)).tolist()
                found, start = [], 0
                for end in ends:
                    w = raw[start:end]
                    start = end
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = tuple(piece(w))
                    found.append(ids)
                blobs = (numbers, _squeeze(np.fromiter(map(len, found), np.uint32, len(found)), press), _squeeze(np.fromiter(chain.from_iterable(found), np.uint32), press))
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *(pa.array([x], pa.binary()) for x in blobs)], names=["chunk", "numbers", "lengths", "ids"])

    return run


def _reassembled(table: pa.Table, docs: pa.Table) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of a chunk's documents."""
    press = zstandard.ZstdDecompressor()
    none = np.zeros(0, np.uint32)
    numbers, lengths, ids = (np.concatenate([none, *(_spread(x, press) for x in table.column(c).to_pylist())]) for c in ("numbers", "lengths", "ids"))
    start, length = np.empty(len(numbers), np.int64), np.empty(len(numbers), np.int64)
    length[numbers] = lengths
    start[numbers] = np.cumsum(lengths, dtype=np.int64) - lengths
    for doc_ids, sizes, blob in zip(*(docs.column(c).to_pylist() for c in ("docs", "sizes", "numbers")), strict=True):
        places, first = _spread(blob, press), 0
        for doc, size in zip(doc_ids, sizes, strict=True):
            at = places[first : first + size]
            first += size
            n = length[at]
            ends = np.cumsum(n)
            yield doc, ids[np.repeat(start[at] - (ends - n), n) + np.arange(ends[-1] if size else 0)]


class TokenBytes:
    """The table that decoding joins: each id's bytes, as one array of bytes with places and lengths by id."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        self.length, self.start = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        held = sorted((i, b) for b, i in ranks.items())
        at = np.array([i for i, _ in held], np.int64)
        self.length[at] = [len(b) for _, b in held]
        self.start[at] = np.cumsum(self.length[at]) - self.length[at]
        self.bytes = np.frombuffer(b"".join(b for _, b in held), np.uint8)

    def decode(self, ids: np.ndarray, step: int = 1 << 20) -> bytes:
        """The bytes of ``ids``, joined in pieces of ``step`` ids; KeyError for an id that the table doesn't have."""
        out = []
        for s in range(0, len(ids), step):
            part = np.asarray(ids[s : s + step], np.int64)
            if len(part) and (part.max() >= len(self.length) or self.length[part].min() < 0):
                raise KeyError("an id that the token-byte table doesn't have")
            n = self.length[part]
            ends = np.cumsum(n)
            out.append(self.bytes[np.repeat(self.start[part] - (ends - n), n) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


def decode_ids(encoded: DataFrame, ranks_file: str, column: str = "ids") -> DataFrame:
    """``encoded`` with column decoded (binary; it replaces one of that name): the bytes of the ids in ``column``.

    Null ids give null, no ids no bytes; an id that the vocabulary doesn't have is an error.
    """
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(encoded.sparkSession, ranks_file))

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = TokenBytes(ranks.value)
        for ids in batches:
            yield ids.map(lambda x: None if x is None else tokens.decode(x))

    bounded_batches(encoded.sparkSession)
    return encoded.withColumn("decoded", decode(F.col(column)))


def _joined(docs: DataFrame, ranks_file: str, pattern: str, finish, ddl: str) -> DataFrame:
    spark = docs.sparkSession
    bounded_batches(spark, 4096)
    ranks = spark.sparkContext.broadcast(read_ranks(spark, ranks_file))  # a fixed vocabulary: its size doesn't depend on the data
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    width = max(parallelism(spark), -(-size // TASK_BYTES))
    buckets = max(4 * width, -(-size // BUCKET_BYTES))
    words = rows.mapInArrow(_distinct(pattern, buckets), "bucket int, chunk long, words binary, sizes binary, numbers binary")
    words = words.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(_encoded(ranks, pattern), "chunk long, numbers binary, lengths binary, ids binary")
    places = rows.mapInArrow(_positions(pattern), "chunk long, docs array<long>, sizes array<long>, numbers binary")
    return words.repartition(width, "chunk").groupBy("chunk").cogroup(places.repartition(width, "chunk").groupBy("chunk")).applyInArrow(finish(ranks), ddl)


def encode_words(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (array<int>), decoded (binary, from the ids).

    Null and empty texts have no ids. Texts are encoded whole, whatever their length. ``docs`` must be repeatable
    (files or a checkpoint), since words and positions are taken in two passes. Null and repeated doc_ids pass
    through; other columns don't matter; an empty table gives an empty result. ``decode_ids`` decodes a table of ids.
    """

    def finish(ranks):
        def run(table: pa.Table, places: pa.Table) -> pa.Table:
            tokens = TokenBytes(ranks.value)
            found = list(_reassembled(table, places))
            return pa.table({"doc_id": pa.array([d for d, _ in found], pa.int64()), "ids": pa.array([x.astype(np.int32) for _, x in found], pa.list_(pa.int32())), "decoded": pa.array([tokens.decode(x) for _, x in found], pa.binary())})

        return run

    return _joined(docs, ranks_file, pattern, finish, "doc_id long, ids array<int>, decoded binary")


def word_digest(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """``encode_words`` as doc_id, n_tokens, ids_sha256, decoded_sha256, with the digests made where the ids are."""

    def finish(ranks):
        def run(table: pa.Table, places: pa.Table) -> pa.Table:
            tokens = TokenBytes(ranks.value)
            found = [(d, len(x), hashlib.sha256(x.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(tokens.decode(x)).hexdigest()) for d, x in _reassembled(table, places)]
            types = (pa.int64(), pa.int64(), pa.string(), pa.string())
            return pa.table({k: pa.array(c, t) for k, c, t in zip(("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), zip(*found, strict=True), types, strict=True)})

        return run

    return _joined(docs, ranks_file, pattern, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
