"""Token ids of a corpus in binary files, coded by ``range_coder``.

A file is Parquet, so any store that Spark writes to will do. Its rows are records: some whole documents in ascending
order (their ids and lengths), the order-0 frequencies of their token ids and one blob of coded blocks.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm import range_coder
from textloom.llm.common import bounded_batches, parallelism
from textloom.llm.piece_table import PieceTable

#: Pre-tokens that the library gets as one text.
JOINED = 200
#: Marks of which any number are one pre-token where letters stand before and none behind.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: GPT-2's pattern, by which a pre-token begins at each space that a character other than white space follows.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RECORD_IDS = range_coder.BLOCK * range_coder.LANES
RECORDS = "part int, record int, before long, n_ids long, docs array<long>, lengths array<long>, order0 binary, blocks binary"


@lru_cache(maxsize=2)
def _encoder(file: str, pattern: str | None, end_id: int):
    """A function from texts to ids with ``end_id`` after each, by the tokenizers library.

    With the ``pattern`` of the tokenizer's own pre-tokens, a worker keeps the ids of each distinct pre-token that it has
    given to the library, from task to task, until another one takes its slot (see ``PieceTable``); a text's ids are those of its pre-tokens, as the library itself has them. By
    the ``SPACED`` pattern a text is cut at its spaces and the ids of what lies between are kept, so that only a piece
    that is new is split further; texts with other white space after a space are split as a whole. A text that holds
    one of the tokenizer's added tokens, which the library finds before it splits, goes to the library as a whole.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would only take memory
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(file)
    added = regex.compile("|".join(regex.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()) or "(?!)")
    if pattern is None:
        return lambda texts: [np.array([*e.ids, end_id], np.uint16) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    split, spaced = regex.compile(pattern).findall, pattern == SPACED
    odd = re.compile(r" (?:\s|\Z)").search
    # Letters of a token's name stand for its bytes.
    vocabulary = tokenizer.get_vocab()
    width = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
    for token, i in vocabulary.items():
        width[i] = len(token)

    def encode_words(words: list[bytes]) -> list[bytes]:
        """The ids of each of some pre-tokens."""
        return [np.array(e.ids, "<u2").tobytes() for e in tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def encode_joined(words: list[bytes]) -> list[bytes]:
        """The same of pre-tokens that can stand one behind the other, in long texts: ids are told apart by their bytes."""
        groups, out = [words[s : s + JOINED] for s in range(0, len(words), JOINED)], []
        for group, e in zip(groups, tokenizer.encode_batch_fast([b"".join(g).decode() for g in groups], add_special_tokens=False), strict=True):
            ids, ends = np.array(e.ids, "<u2"), np.cumsum(np.fromiter(map(len, group), np.int64, len(group)))
            reached = np.cumsum(width.take(ids))
            at = np.searchsorted(reached, ends)
            if at[-1] == len(ids) - 1 and (reached.take(at) == ends).all():
                raw, cuts = ids.tobytes(), (2 * at + 2).tolist()
                out += [raw[a:b] for a, b in zip([0, *cuts], cuts)]  # noqa: B905
            else:
                out += encode_words(group)
        return out

    def joinable(word: bytes) -> bool:
        """Whether it is a space and something else than white space."""
        return spaced and word[:1] == b" " and (word[1:2].isalpha() or len(word) > 1 and not word.decode()[1].isspace())

    def learn_words(words: list[bytes]) -> list[bytes]:
        behind = list(filter(joinable, words))
        found = dict(zip(behind, encode_joined(behind), strict=True))
        others = [w for w in words if w not in found]
        found.update(zip(others, encode_words(others), strict=True))
        return list(map(found.__getitem__, words))

    def learn_pieces(pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces, from those of their pre-tokens."""
        words, ends = [], [0]
        for piece in pieces:
            word = piece.rstrip(MARKS)
            body = word[1:] if word[:1] == b" " else word
            if not body.isalpha() and not body.decode().isalpha():
                words += [w.encode() for w in split(piece.decode())]
            elif len(word) == len(piece):  # a pre-token
                words.append(piece)
            else:  # one of letters and one of marks
                words += (word, piece[len(word) :])
            ends.append(len(words))
        places = known.places_of(words)
        cuts = (2 * np.append(0, np.cumsum(places & 0xFFFFFFFF)))[ends].tolist()
        raw = known.gather(places).tobytes()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]  # noqa: B905

    known, held = PieceTable(learn_words), PieceTable(learn_pieces)

    def encode(texts: list[str]) -> list[np.ndarray]:
        known.clear_if_full()
        held.clear_if_full()
        out, plain = {}, []
        for i, t in enumerate(texts):
            if added.search(t):
                out[i] = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, end_id], "<u2")
            elif spaced and not odd(t):
                plain.append(i)
            else:
                out[i] = np.append(known.gather(known.places_of([w.encode() for w in split(t)])), np.uint16(end_id))
        if plain:
            bodies = [texts[i].encode() for i in plain]
            joined = b" ".join(bodies)
            sizes = np.array([len(x) for x in bodies]) + 1
            spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
            start, first = np.append(0, spaces + 1), np.cumsum(sizes) - sizes
            kind = np.ones(len(start), np.int64)
            heads = np.searchsorted(start, first)
            kind[heads] = 0
            places = held.places(joined, start, np.append(spaces, len(joined)) - start, kind)
            ids = held.gather(places)
            ends = np.cumsum(places & 0xFFFFFFFF)[np.append(heads[1:], len(start)) - 1]
            ids = np.insert(ids, ends, end_id)
            out.update(zip(plain, np.split(ids, ends[:-1] + np.arange(1, len(plain))), strict=True))
        return [out[i] for i in range(len(texts))]

    return encode


def _written(tokenizer_file: str, end_id: int, record_ids: int, pattern: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_file, pattern, end_id)
        part, record, before = TaskContext.get().partitionId(), 0, 0
        docs, lengths, held, size = [], [], [], 0

        def flush():
            nonlocal docs, lengths, held, size, record, before
            ids = np.concatenate(held)
            order0 = range_coder.Order0(np.bincount(ids, minlength=range_coder.IDS))
            blob = range_coder.encode(ids, order0=order0)
            columns = [pa.array([x], t) for x, t in ((part, pa.int32()), (record, pa.int32()), (before, pa.int64()), (size, pa.int64()), (docs, pa.list_(pa.int64())), (lengths, pa.list_(pa.int64())), (order0.pack(), pa.binary()), (blob, pa.binary()))]
            docs, lengths, held, size, record, before = [], [], [], 0, record + 1, before + size
            return pa.RecordBatch.from_arrays(columns, names=["part", "record", "before", "n_ids", "docs", "lengths", "order0", "blocks"])

        for b in batches:
            ids, texts = (c.to_pylist() for c in b.columns)
            for s in range(0, len(texts), 64):
                for doc, x in zip(ids[s : s + 64], encode(texts[s : s + 64]), strict=True):
                    docs.append(doc)
                    lengths.append(len(x))
                    held.append(x)
                    size += len(x)
                    if size >= record_ids:
                        yield flush()
        if held:
            yield flush()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 2, record_ids: int = RECORD_IDS, pattern: str | None = None) -> None:
    """Write the ids of every text, each with ``end_id`` after it, to ``path`` in ascending doc_id order.

    A range partition of doc_id, and in it of a hash of the text, becomes a file. Null text counts as empty; null
    doc_ids come first; equal doc_ids follow each other in the order of that hash, then of the texts. ``pattern``, if given, is the tokenizer's pre-token pattern (see ``_encoder``). Ids must be under 65,536. An empty table gives a folder without records.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("part", F.xxhash64("text"))  # rows of one doc_id, or of none, may be many
    rows = rows.repartitionByRange(parallelism(spark), "doc_id", "part").sortWithinPartitions("doc_id", "part", "text").drop("part")
    rows.mapInArrow(_written(tokenizer_file, end_id, record_ids, pattern), RECORDS).write.mode("overwrite").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before the document), ids, n_tokens, ids_crc32 of each document, decoded from the files."""
    records = _placed(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                for doc, start, ids in _documents(row):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc], pa.int64()), pa.array([start], pa.int64()), pa.array([ids.astype(np.int32)], pa.list_(pa.int32())), pa.array([len(ids)], pa.int64()), pa.array([zlib.crc32(ids.tobytes())], pa.int64())],
                        names=["doc_id", "start", "ids", "n_tokens", "ids_crc32"],
                    )

    return records.mapInArrow(run, "doc_id long, start long, ids array<int>, n_tokens long, ids_crc32 long")


def token_file_digest(spark: SparkSession, path: str) -> DataFrame:
    """``read_token_files`` without the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                found = [(doc, start, len(ids), zlib.crc32(ids.tobytes())) for doc, start, ids in _documents(row)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _placed(spark, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _documents(row: dict) -> Iterator[tuple[int | None, int, np.ndarray]]:
    ids, at = range_coder.decode(row["blocks"], order0=range_coder.Order0.unpack(row["order0"])), 0
    if len(ids) != row["n_ids"]:
        raise ValueError(f"record {row['part']}/{row['record']} has {len(ids)} ids, expected {row['n_ids']}")
    for doc, n in zip(row["docs"], row["lengths"], strict=True):
        yield doc, row["start"] + at, ids[at : at + n]
        at += n


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The files' records with the ids before each. The sums that are broadcast are one a file, as many as the writer's partitions."""
    bounded_batches(spark, 64)
    records = spark.read.schema(RECORDS).parquet(path)
    parts = records.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    return records.join(F.broadcast(parts), "part").withColumn("start", F.col("earlier") + F.col("before"))
