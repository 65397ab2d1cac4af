"""Tokenization and packing: BPE training, encoding, conversation rendering, best-fit packing, generation replay."""

from __future__ import annotations

import ast
import bisect
import codecs
import functools
import heapq
import itertools
import operator
from collections import Counter, defaultdict, deque
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import arrays, render
from textloom.sources.scratch import bounded_batches, remove, scratch

#: Special tokens, which follow the merges in this order.
SPECIALS = ("<|bos|>", "<|user_start|>", "<|user_end|>", "<|assistant_start|>", "<|assistant_end|>", "<|python_start|>", "<|python_end|>", "<|output_start|>", "<|output_end|>")


#: Distinct pre-tokens, and their bytes, up to which the merge loop runs on the driver (some 300 MB); more are merged where they lie.
DRIVER_WORDS, DRIVER_BYTES = 500_000, 8 << 20
#: Most frequent pairs that a distributed round looks at.
ROUND_PAIRS = 256
#: Ids that a task or the driver takes up at once to merge or count (some 100 MB with what is made of them).
CHUNK = 1 << 20


def train_bpe(texts: DataFrame, vocab_size: int, column: str = "text", specials: tuple[str, ...] = SPECIALS, driver_words: int = DRIVER_WORDS) -> list[tuple[int, int]]:
    """Merges as pairs of ids in order: bytes first, then the most frequent pair each time, of equal ones the smallest ids.

    Counts of distinct pre-tokens come from one distributed aggregation, which is written to the shared folder. Up to
    ``driver_words`` of them the merge loop runs on the driver and counts only pairs in touched words anew; beyond that
    pairs are counted and merged in rounds over the table. Both ways give the same merges.
    """
    size = vocab_size - len(specials)
    if size < 256:
        raise ValueError("a vocabulary needs its 256 bytes")
    spark, path = texts.sparkSession, scratch(texts.sparkSession, "pretokens")
    texts.select(F.explode(render.pretokens(F.col(column))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).write.parquet(path)
    counts = spark.read.parquet(path)
    words, held = counts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("w") + 1), F.lit(0))).first()
    if words > driver_words or held > DRIVER_BYTES:
        return _merge_rounds(counts.select(arrays.byte_ids(F.col("w")).alias("ids"), "n"), size - 256)
    return _merge_loop(counts, size - 256)


def _merge_rounds(words: DataFrame, merges: int) -> list[tuple[int, int]]:
    """Merges over a table of words (ids, n), several a round where the order of single merges can't differ.

    Of the round's most frequent pairs, those are merged together of which none begins with another one's end, so that
    no merge takes an id from another's matches, and that are more frequent than any pair that an earlier one of them
    can bring about; such a pair stands in three ids in a row, whose counts bound it. Ids are numpy arrays in tasks;
    the driver gets ``ROUND_PAIRS`` pairs a round.
    """
    spark, out, path = words.sparkSession, [], None
    while len(out) < merges:
        rows = words.mapInArrow(_task_sums(_pair_keys), "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
        top = [(r.k >> 32, r.k & 0xFFFFFFFF, r.n) for r in rows.orderBy(F.desc("n"), "k").limit(ROUND_PAIRS).collect()]
        if not top:
            break
        apart: list[tuple[int, int, int]] = []
        firsts, seconds = set(), set()
        for a, b, n in top[: merges - len(out)]:
            if apart and (a == b or a in seconds or b in firsts):
                break
            apart.append((a, b, n))
            firsts.add(a)
            seconds.add(b)
            if a == b:
                break
        bound: dict[int, int] = {}
        if len(apart) > 1:
            asked = [(a << 32) + b for a, b, _ in apart]
            t = words.mapInArrow(_task_sums(_triple_keys(asked)), "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
            a, b, c = (F.shiftright("k", 42), F.shiftright("k", 21).bitwiseAND((1 << 21) - 1), F.col("k").bitwiseAND((1 << 21) - 1))
            ends = t.select(F.explode(F.array(F.shiftleft(a, 32) + b, F.shiftleft(b, 32) + c)).alias("k"), "n").where(F.col("k").isin(asked))
            bound = {r.k: r.n for r in ends.groupBy("k").agg(F.max("n").alias("n")).collect()}
        chosen, highest = [], 0
        for a, b, n in apart:
            if chosen and n <= highest:
                break
            chosen.append((a, b))
            highest = max(highest, bound.get((a << 32) + b, 0))
        new = {p: 256 + len(out) + i for i, p in enumerate(chosen)}
        out += chosen

        def merged(batches: Iterator[pa.RecordBatch], new=new) -> Iterator[pa.RecordBatch]:
            for ids, sizes, n in _word_chunks(batches):
                ids, sizes = _merge_all(ids, sizes, new)
                yield pa.RecordBatch.from_arrays([_lists(ids, sizes), pa.array(n)], names=["ids", "n"])

        before, path = path, scratch(spark, "merged")
        words.select("ids", "n").mapInArrow(merged, "ids array<int>, n long").where("size(ids) > 1").write.parquet(path)
        words = spark.read.parquet(path)
        if before:
            remove(spark, before)
    return out


def _lists(values: np.ndarray, sizes: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    """``values``, one list after another, as an array of lists."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()), mask=None if missing is None or not missing.any() else pa.array(missing))


def _word_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words (ids, n) as (ids of all one after another, sizes, weights), about ``CHUNK`` ids at a time."""
    def joined(held: list) -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(x) for x in zip(*held, strict=True))

    held, size = [], 0
    for b in batches:
        ids = b.column(0)
        held.append((ids.flatten().to_numpy(), np.diff(ids.offsets.to_numpy()), b.column(1).to_numpy()))
        size += len(held[-1][0])
        if size >= CHUNK:
            yield joined(held)
            held, size = [], 0
    if held:
        yield joined(held)


def _inside(sizes: np.ndarray) -> np.ndarray:
    """For each id whether the next one belongs to its word."""
    inside = np.ones(int(sizes.sum()), bool)
    inside[np.cumsum(sizes[sizes > 0]) - 1] = False
    return inside


def _every_other(at: np.ndarray) -> np.ndarray:
    """Of places that follow each other every other one, from the left."""
    starts = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    return at[(np.arange(len(at)) - np.repeat(starts, np.diff(starts, append=len(at)))) % 2 == 0]


def _merge_all(ids: np.ndarray, sizes: np.ndarray, new: Mapping[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and sizes of words with each pair of ``new``, from the left, as its id. No pair begins with another's end."""
    ids, inside, keep = ids.copy(), _inside(sizes)[:-1], np.ones(len(ids), bool)
    word = np.repeat(np.arange(len(sizes)), sizes)
    for (a, b), made in new.items():
        at = np.flatnonzero((ids[:-1] == a) & (ids[1:] == b) & inside)
        at = _every_other(at) if a == b else at
        ids[at] = made
        keep[at + 1] = False
    return ids[keep], np.bincount(word[keep], minlength=len(sizes))


def _pair_keys(ids: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places at which a pair begins, and pairs as numbers."""
    at = np.flatnonzero(inside)
    return at, (ids[at].astype(np.int64) << 32) | ids[at + 1]


def _triple_keys(asked: list[int]):
    """Three ids in a row as a number, where two of them are a pair of ``asked``; ids are under 2**21."""

    def keys(ids: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, pair = _pair_keys(ids, inside)
        hit = np.zeros(len(ids), bool)
        hit[at] = np.isin(pair, asked)
        begin = at[inside[np.minimum(at + 1, len(ids) - 1)]]
        begin = begin[hit[begin] | hit[begin + 1]]
        a, b, c = (ids[begin + i].astype(np.int64) for i in range(3))
        return begin, (a << 42) | (b << 21) | c

    return keys


def _task_sums(keys):
    """A pass over words (ids, n) that gives (k, n): keys by ``keys``(ids, inside) with their words' weights, summed up in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, n = np.empty(0, np.int64), np.empty(0, np.int64)
        for ids, sizes, weights in _word_chunks(batches):
            at, found = keys(ids, _inside(sizes))
            k, n = _sums(np.concatenate([k, found]), np.concatenate([n, np.repeat(weights, sizes)[at]]))
            if len(k) > CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["k", "n"])
                k, n = k[:0], n[:0]
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["k", "n"])

    return run


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of ``n``."""
    found, which = np.unique(keys, return_inverse=True)
    sums = np.zeros(len(found), np.int64)
    np.add.at(sums, which, n)
    return found, sums


def _merge(ids: list[int], new: Mapping[tuple[int, int], int]) -> list[int]:
    """``ids`` with each pair of ``new``, from the left, as its id."""
    at, out = 0, []
    while at < len(ids):
        made = new.get((ids[at], ids[at + 1])) if at + 1 < len(ids) else None
        out.append(ids[at] if made is None else made)
        at += 1 if made is None else 2
    return out


#: Matches of a merge under which a search of the touched words alone pays, if there are as many merges left as stated.
FEW_MATCHES, MANY_MERGES = 20_000, 300


def _pair_sums(ids: np.ndarray, weight: np.ndarray, at: np.ndarray) -> Iterator[tuple[tuple[int, int], int]]:
    """Pairs that begin at the places ``at``, none of them across a word's end, with the sums of their words' weights."""
    left, right = ids[at], ids[at + 1]
    inside = (left >= 0) & (right >= 0)
    keys, sums = _sums((left[inside].astype(np.int64) << 32) | right[inside], weight[at[inside]])
    return zip(zip((keys >> 32).tolist(), (keys & 0xFFFFFFFF).tolist(), strict=True), sums.tolist(), strict=True)


def _merge_loop(counts: DataFrame, most: int) -> list[tuple[int, int]]:
    """Merges over all words as one array, in which -1 ends a word; once matches are few, over the touched words only."""
    table = counts.select(F.encode("w", "UTF-8").alias("w"), "n").toArrow()  # ``driver_words`` at most
    found = table.column(0).to_pylist()
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ids = np.full(int(sizes.sum()) + len(found) + 1, -1, np.int32)
    ends = np.cumsum(sizes + 1)
    body = np.ones(len(ids), bool)
    body[ends - 1] = body[-1:] = False
    ids[body] = np.frombuffer(b"".join(found), np.uint8)
    weight = np.zeros(len(ids), np.int64)
    weight[: len(ids) - 1] = np.repeat(table.column(1).to_numpy(), sizes + 1)
    del table, found
    pairs: Counter = Counter()
    for lo in range(0, len(ids) - 1, CHUNK):
        for p, k in _pair_sums(ids, weight, np.arange(lo, min(lo + CHUNK, len(ids) - 1))):
            pairs[p] += k
    heap = [(-n, p) for p, n in pairs.items()]
    heapq.heapify(heap)
    merges = []
    while len(merges) < most and heap:
        n, best = heapq.heappop(heap)
        if pairs.get(best, 0) != -n or n == 0:
            continue  # an older count
        at = np.flatnonzero((ids[:-1] == best[0]) & (ids[1:] == best[1]))
        if best[0] == best[1]:  # in a run every other one counts, from the left
            at = _every_other(at)
        if len(at) < FEW_MATCHES and most - len(merges) > MANY_MERGES:
            heapq.heappush(heap, (n, best))
            break
        new = 256 + len(merges)
        merges.append(best)
        touched: set[tuple[int, int]] = set()
        for p, k in _pair_sums(ids, weight, np.unique(np.concatenate([at[at > 0] - 1, at, at + 1]))):
            pairs[p] -= k
            touched.add(p)
        ids[at] = new
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        at = at - np.arange(len(at))
        ids, weight = ids[keep], weight[keep]
        for p, k in _pair_sums(ids, weight, np.unique(np.concatenate([at[at > 0] - 1, at]))):
            pairs[p] += k
            touched.add(p)
        for p in touched:
            if pairs[p] > 0:
                heapq.heappush(heap, (-pairs[p], p))
            else:
                pairs.pop(p, None)
    return merges if len(merges) == most or not heap else _merge_touched(ids, weight, pairs, heap, merges, most)


def _merge_touched(ids: np.ndarray, weights: np.ndarray, pairs: Counter, heap: list, merges: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """``_merge_loop`` on with words by the pairs in them."""
    ends = np.flatnonzero(ids < 0)
    words = [x[:-1].tolist() for x in np.split(ids, ends[:-1] + 1)]
    weight = weights[np.concatenate([[0], ends[:-1] + 1])].tolist()
    where: dict[tuple[int, int], set[int]] = defaultdict(set)
    for i, w in enumerate(words):
        for p in zip(w, w[1:], strict=False):
            where[p].add(i)
    while len(merges) < most and heap:
        n, best = heapq.heappop(heap)
        if pairs.get(best, 0) != -n or n == 0:
            continue  # an older count
        new = 256 + len(merges)
        merges.append(best)
        touched: set[tuple[int, int]] = set()
        for i in where.pop(best):
            old = words[i]
            for p in zip(old, old[1:], strict=False):
                pairs[p] -= weight[i]
                touched.add(p)
            out = _merge(old, {best: new})
            words[i] = out
            for p in zip(out, out[1:], strict=False):
                pairs[p] += weight[i]
                where[p].add(i)
                touched.add(p)
        for p in touched:
            if pairs[p] > 0:
                heapq.heappush(heap, (-pairs[p], p))
            else:
                pairs.pop(p, None)
    return merges


def ranks_of(merges: list[tuple[int, int]]) -> dict[bytes, int]:
    """Token bytes and ranks of a trained vocabulary."""
    tokens = [bytes([i]) for i in range(256)]
    for a, b in merges:
        tokens.append(tokens[a] + tokens[b])
    return {t: i for i, t in enumerate(tokens)}


def vocabulary(spark: SparkSession, ranks: Mapping[bytes, int], specials: tuple[str, ...] = SPECIALS) -> DataFrame:
    """token_id, token, special, n_bytes: bytes of what the token alone decodes to (3 for bytes that are no UTF-8), 0 for specials."""
    rows = [(i, t, False, len(t.decode("utf-8", "replace").encode())) for t, i in ranks.items()]
    rows += [(len(ranks) + i, s.encode(), True, 0) for i, s in enumerate(specials)]
    return spark.createDataFrame(rows, "token_id int, token binary, special boolean, n_bytes int")


def save_vocabulary(vocabulary: DataFrame, path: str) -> None:
    """Write a ``vocabulary`` table (a trained vocabulary's size, one file) with the byte counts that bits per byte need."""
    vocabulary.orderBy("token_id").coalesce(1).write.mode("overwrite").parquet(path)


def load_vocabulary(spark: SparkSession, path: str) -> tuple[dict[bytes, int], tuple[str, ...]]:
    """Ranks and special tokens of a saved vocabulary: a table of its size, read once on the driver."""
    ranks, specials = {}, []
    for r in spark.read.parquet(path).select("token_id", "token", "special").orderBy("token_id").toLocalIterator():
        if r.special:
            specials.append(bytes(r.token).decode())
        else:
            ranks[bytes(r.token)] = r.token_id
    return ranks, tuple(specials)


#: Tokens that begin a document, in order of preference.
BOS_NAMES = ("<|bos|>", "<|endoftext|>")


def bos_id(vocabulary: DataFrame, names: tuple[str, ...] = BOS_NAMES) -> DataFrame:
    """One row with bos: the id of the first of ``names`` that ``vocabulary`` (token_id, token) has. None of them is an error."""
    found = [F.min(F.when(F.col("token") == F.lit(n).cast("binary"), F.col("token_id"))) for n in names]
    return vocabulary.agg(F.coalesce(*found, F.raise_error(F.lit("no token that begins a document")).cast("int")).alias("bos"))


def chat_prompt(messages: Column, encode=arrays.byte_ids, size: int = 256) -> Column:
    """Ids that a chat is answered after: bos, user and assistant messages in their marks, and the mark that starts an answer. Other roles are left out."""
    mark = lambda name: F.array(F.lit(special_id(name, size)))
    wrapped = lambda m, who: F.concat(mark(f"<|{who}_start|>"), encode(m["content"]), mark(f"<|{who}_end|>"))
    body = F.transform(messages, lambda m: F.when(m["role"] == "user", wrapped(m, "user")).when(m["role"] == "assistant", wrapped(m, "assistant")).otherwise(F.array().cast("array<int>")))
    return F.concat(mark("<|bos|>"), F.flatten(body), mark("<|assistant_start|>"))


def stream_deltas(ids: Column, size: int = 256) -> Column:
    """[{step, delta}]: what a stream of byte tokens shows at each step that shows something, up to an end mark or a new document."""
    stops = (special_id("<|assistant_end|>", size), special_id("<|bos|>", size))
    kind = pa.list_(pa.struct([("step", pa.int32()), ("delta", pa.string())]))

    @F.arrow_udf("array<struct<step:int,delta:string>>")
    def run(logs: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in logs:
            for some in _pieces(batch):
                out = []
                for log in some:
                    held = log.values.to_numpy() if log.is_valid else np.empty(0, np.int32)
                    end = np.flatnonzero(np.isin(held, stops))
                    out.append(_shown(held[: end[0]] if len(end) else held))
                steps, deltas = ([x for pair in out for x in pair[k]] for k in (0, 1))
                shown = pa.StructArray.from_arrays([pa.array(steps, pa.int32()), pa.array(deltas, pa.string())], fields=list(kind.value_type))
                offsets = np.concatenate([[0], np.cumsum([len(x[0]) for x in out])]).astype(np.int32)
                yield pa.ListArray.from_arrays(pa.array(offsets), shown, type=kind)

    _bound()
    return run(ids)


def _shown(ids: np.ndarray) -> tuple[list[int], list[str]]:
    """Steps and what they show. In text without replacement characters that is each character at its last byte."""
    data = None if len(ids) and (ids.min() < 0 or ids.max() > 255) else ids.astype(np.uint8)
    try:
        text = None if data is None else data.tobytes().decode()
    except UnicodeDecodeError:
        text = None
    if text is None or "\ufffd" in text:
        found = [(i, d) for i, d in enumerate(text_deltas(ids.tolist())) if d]
        return [i for i, _ in found], [d for _, d in found]
    ends = np.flatnonzero((data & 0xC0) != 0x80)[1:] - 1  # before the next character's first byte
    return [*ends.tolist(), len(data) - 1] if len(data) else [], list(text)


def stream_text(rows: DataFrame, key: str, ids: str, size: int = 256) -> DataFrame:
    """key, step, delta of ``stream_deltas``, a row a step."""
    return rows.select(key, F.explode(stream_deltas(F.col(ids), size)).alias("x")).select(key, "x.step", "x.delta")


def pack_progress(rows: DataFrame, documents: int, world: int, accumulation: int = 1) -> DataFrame:
    """Packed rows (rank, row, n_docs) with consumed, epoch, progress and last: how far a rank is after each row.

    A rank takes every ``world``-th document, so what it has consumed stands for ``world`` times as many. The epoch goes
    up by one each time all ``documents`` are through; the last step is the one whose rows, ``accumulation`` of them,
    take the first epoch to its end. Running sums go by blocks of a rank's rows.
    """
    block = rows.withColumn("__block", F.expr("row div 4096"))
    sums = block.groupBy("rank", "__block").agg(F.sum("n_docs").alias("__n"))
    earlier = Window.partitionBy("rank").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("rank", "__block", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    own = F.sum("n_docs").over(Window.partitionBy("rank", "__block").orderBy("row"))
    out = block.withColumn("__own", own).join(sums, ["rank", "__block"]).withColumn("consumed", (F.col("__before") + F.col("__own")) * world)
    out = out.withColumn("epoch", (F.floor((F.col("consumed") - 1) / documents) + 1).cast("int")).withColumn("progress", F.least(F.lit(1.0), F.col("consumed") / F.lit(float(documents))))
    full = (F.col("row") + 1) % accumulation == 0
    return out.withColumn("last", full & (F.col("consumed") >= documents)).drop("__block", "__own", "__before")


#: Bytes of text, or ids, that a Python worker encodes or decodes at once.
PIECE = 1 << 20


def _pieces(batch: pa.Array) -> Iterator[pa.Array]:
    """``batch``, an array of texts or lists, in parts of about ``PIECE`` bytes or ids: one long text alone, and some of the short ones together."""
    if not len(batch):
        return
    ends = batch.offsets.to_numpy() if pa.types.is_list(batch.type) else np.frombuffer(batch.buffers()[1], np.int32)[batch.offset : batch.offset + len(batch) + 1]
    ends, lo = ends.astype(np.int64), 0
    while lo < len(batch):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + PIECE, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def tiktoken_encoding(ranks: Mapping[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=render.PRETOKENS, mergeable_ranks=dict(ranks), special_tokens={})


def encoder(ranks: Mapping[bytes, int], prepend: int | None = None, append: int | None = None):
    """A column function from text to ids; specials in a text are ordinary text. Ids are numbers of 4 bytes throughout, about ``PIECE`` of them at once."""

    @F.arrow_udf("array<int>")
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = tiktoken_encoding(ranks).encode_to_numpy
        head, tail = (np.array([] if x is None else [x], np.int32) for x in (prepend, append))
        nothing = np.empty(0, np.int32)
        for batch in texts:
            for some in _pieces(batch):
                found = [nothing if t is None else np.concatenate([head, of(t).astype(np.int32), tail]) for t in some.to_pylist()]
                yield _lists(np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found)), some.is_null().to_numpy(False))

    _bound()
    return encode


def decoder(ranks: Mapping[bytes, int], specials: tuple[str, ...] = SPECIALS):
    """A column function from ids to text: the ids' bytes, taken from one table, of which each text is a part."""

    @F.arrow_udf("string")
    def decode(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = {i: t for t, i in ranks.items()} | {len(ranks) + i: s.encode() for i, s in enumerate(specials)}
        table = pa.array([of.get(i) for i in range(max(of) + 1)], pa.binary())
        for batch in ids:
            for some in _pieces(batch):
                made = table.take(some.flatten())
                if made.null_count:
                    raise KeyError("an id that the vocabulary hasn't got")
                ends = np.concatenate([[0], np.cumsum(np.diff(np.frombuffer(made.buffers()[1], np.int32)[: len(made) + 1]))])
                lengths = np.diff(some.offsets.to_numpy())
                lengths[some.is_null().to_numpy(False)] = 0  # what is behind a null isn't in the flat array
                held, at = made.buffers()[2], ends[np.concatenate([[0], np.cumsum(lengths)])]
                held = b"" if held is None else held.to_pybytes()
                yield pa.array([None if missing else held[i:j].decode("utf-8", "replace") for i, j, missing in zip(at, at[1:], some.is_null().to_pylist(), strict=False)], pa.string())

    _bound()
    return decode


def _bound() -> None:
    if spark := SparkSession.getActiveSession():
        bounded_batches(spark)


@functools.cache
def special_ids(size: int = 256) -> dict[str, int]:
    return {n: special_id(n, size) for n in SPECIALS}


def special_id(name: str, size: int = 256) -> int:
    return size + SPECIALS.index(name)


def render_conversation(messages: Column, encode=arrays.byte_ids, size: int = 256, most: int | None = 2048) -> Column:
    """{ids, mask} of a conversation of {role, content}: bos, then each message in its marks; assistant content and its end are supervised.

    ``encode`` is any column function from text to ids. Expressions only, with the vocabulary of single bytes.
    """
    mark = lambda name, m: F.struct(F.array(F.lit(special_id(name, size))).alias("ids"), F.lit(m).alias("m"))

    def segments(x: Column) -> Column:
        user = F.array(mark("<|user_start|>", 0), F.struct(encode(x["content"]).alias("ids"), F.lit(0).alias("m")), mark("<|user_end|>", 0))
        assistant = F.array(mark("<|assistant_start|>", 0), F.struct(encode(x["content"]).alias("ids"), F.lit(1).alias("m")), mark("<|assistant_end|>", 1))
        return F.when(x["role"] == "user", user).otherwise(assistant)

    return _flat(F.concat(F.array(mark("<|bos|>", 0)), F.flatten(F.transform(messages, segments))), most)


def render_parts(parts: Column, encode=arrays.byte_ids, size: int = 256) -> Column:
    """{ids, mask} of an assistant message of {type, text} parts: calls and their marks are supervised, outputs aren't."""

    def segments(p: Column) -> Column:
        at = lambda name, m: F.struct(F.array(F.lit(special_id(name, size))).alias("ids"), F.lit(m).alias("m"))
        body = lambda m: F.struct(encode(p["text"]).alias("ids"), F.lit(m).alias("m"))
        call = F.array(at("<|python_start|>", 1), body(1), at("<|python_end|>", 1))
        output = F.array(at("<|output_start|>", 0), body(0), at("<|output_end|>", 0))
        return F.when(p["type"] == "python", call).when(p["type"] == "python_output", output).otherwise(F.array(body(1)))

    return _flat(F.flatten(F.transform(parts, segments)), None)


def _flat(segments: Column, most: int | None) -> Column:
    ids = F.flatten(F.transform(segments, lambda s: s["ids"]))
    mask = F.flatten(F.transform(segments, lambda s: F.array_repeat(s["m"], F.size(s["ids"]))))
    if most is not None:
        ids, mask = F.slice(ids, 1, most), F.slice(mask, 1, most)
    return F.struct(ids.alias("ids"), mask.alias("mask"))


def render_for_completion(messages: Column, encode=arrays.byte_ids, size: int = 256) -> Column:
    """Ids without the last assistant message, and the mark that starts one (after any truncation)."""
    return F.concat(render_conversation(F.slice(messages, F.lit(1), F.size(messages) - 1), encode, size)["ids"], F.array(F.lit(special_id("<|assistant_start|>", size))))


class BestFit:
    """Rows of fixed capacity from a buffer of documents, the largest that fits first.

    Documents of one length wait in the order of their arrival, so that the largest that fits, and the earliest of
    those, is found by bisection among the lengths. ``crop``: where none fits, the shortest is cut to fill the row;
    else the row is padded.
    """

    def __init__(self, capacity: int, buffer: int, crop: bool, pad: int = 0):
        self.capacity, self.size, self.crop, self.pad = capacity, buffer, crop, pad
        self.lengths: list[int] = []
        self.docs: dict[int, deque] = {}
        self.count = 0

    def add(self, length: int, item) -> None:
        if length not in self.docs:
            bisect.insort(self.lengths, length)
            self.docs[length] = deque()
        self.docs[length].append(item)
        self.count += 1

    def _take(self, at: int) -> tuple:
        length = self.lengths[at]
        waiting = self.docs[length]
        item = waiting.popleft()
        self.count -= 1
        if not waiting:
            del self.docs[length], self.lengths[at]
        return length, item

    def placements(self, source: Iterator[tuple[int, object]]) -> Iterator[list[tuple[object, int, int]]]:
        """[(item, placed, cut off)] of each row, from (length, item); the buffer is refilled before each placement, and emptied at the end."""
        done = False
        while True:
            room, parts = self.capacity, []
            while room:
                while not done and self.count < self.size:
                    nxt = next(source, None)
                    done = nxt is None
                    if nxt is not None:
                        self.add(*nxt)
                if not self.count:
                    break
                at = bisect.bisect_right(self.lengths, room) - 1
                if at < 0 and not self.crop and room < self.capacity:
                    break
                length, item = self._take(max(at, 0))
                parts.append((item, min(length, room), max(0, length - room)))
                room -= min(length, room)
            if room == self.capacity:
                return
            yield parts

    def rows(self, source: Iterator[tuple[np.ndarray, object]]) -> Iterator[tuple[np.ndarray, int, list]]:
        """(ids, how many of them are content, [(tag, placed, cut off)]) from (ids, tag)."""
        for parts in self.placements((len(ids), (ids, tag)) for ids, tag in source):
            row = np.concatenate([ids[:n] for (ids, _), n, _ in parts])
            yield np.pad(row, (0, self.capacity - len(row)), constant_values=self.pad), len(row), [(tag, n, cut) for (_, tag), n, cut in parts]


def pack(docs: DataFrame, rank: str, order: str, ids: str, capacity: int, buffer: int = 1000, crop: bool = True, pad: int = 0) -> DataFrame:
    """rank, row, tokens, content, n_docs, placed, cut of packed rows; each rank is a stream of its own, in ``order``.

    Packing depends on all that came before it, so a rank is sequential; ranks are many. Rows come and go in Arrow
    batches, and only the buffer is held.
    """
    fields = "rank long, row long, tokens array<int>, content int, n_docs int, placed long, cut long"
    kinds = dict(zip((f.split()[0] for f in fields.split(", ")), (pa.int64(), pa.int64(), None, pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True))
    bounded_batches(docs.sparkSession)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for b in batches:
            values, ends = b.column(1).values.to_numpy(), b.column(1).offsets.to_numpy()
            for key, lo, hi in zip(b.column(0).to_pylist(), ends, ends[1:], strict=False):
                yield key, values[lo:hi].copy()  # a part would keep its whole batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now, own in itertools.groupby(stream(batches), operator.itemgetter(0)):
            packed = enumerate(BestFit(capacity, buffer, crop, pad).rows((ids, None) for _, ids in own))
            while some := list(itertools.islice(packed, max(1, CHUNK // capacity))):
                columns = {"rank": [now] * len(some), "row": [i for i, _ in some], "tokens": None, "content": [n for _, (_, n, _) in some], "n_docs": [len(p) for _, (_, _, p) in some]}
                columns |= {"placed": [n for _, (_, n, _) in some], "cut": [sum(x[2] for x in p) for _, (_, _, p) in some]}
                columns["tokens"] = _lists(np.concatenate([t for _, (t, _, _) in some]), np.full(len(some), capacity))
                yield pa.RecordBatch.from_arrays([c if k == "tokens" else pa.array(c, kinds[k]) for k, c in columns.items()], names=list(columns))

    keyed = docs.select(F.col(rank).cast("long").alias("__rank"), F.col(ids).alias("__ids"), F.col(order).alias("__order"))
    return keyed.repartition("__rank").sortWithinPartitions("__rank", "__order").drop("__order").mapInArrow(run, fields)


def pack_stats(rows: DataFrame, capacity: int) -> DataFrame:
    """rank, rows, placed, cut, padded and use (content over capacity)."""
    got = rows.groupBy("rank").agg(F.count("*").alias("rows"), F.sum("placed").alias("placed"), F.sum("cut").alias("cut"), F.sum(F.lit(capacity) - F.col("content")).alias("padded"))
    return got.withColumn("use", 1 - F.col("padded") / (F.col("rows") * capacity))


OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv}


def calculate(expression: str | None):
    """The value of an arithmetic expression, or of 'text'.count('part'); None for all else, powers included. Walks a syntax tree, runs nothing."""
    if expression is None:
        return None
    text = expression.replace(",", "")

    def value(node):
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return node.value
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
            return value(node.operand) if isinstance(node.op, ast.UAdd) else -value(node.operand)
        if isinstance(node, ast.BinOp) and type(node.op) in OPERATORS:
            return OPERATORS[type(node.op)](value(node.left), value(node.right))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "count" and len(node.args) == 1 and not node.keywords:
            of, part = node.func.value, node.args[0]
            if all(isinstance(x, ast.Constant) and isinstance(x.value, str) for x in (of, part)):
                return of.value.count(part.value)
        raise ValueError

    if len(text) > 1000:
        return None
    try:
        out = value(ast.parse(text.strip(), mode="eval").body)
        return out if not isinstance(out, int) or abs(out) < 1 << 63 else None
    except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, RecursionError, MemoryError):
        return None


def calculator(expression: Column) -> Column:
    """``calculate`` as a column, its results as strings."""

    @F.pandas_udf("string")
    def run(expressions: pd.Series) -> pd.Series:
        return expressions.map(lambda e: None if (v := calculate(e)) is None else str(v))

    return run(expression)


class ToolState:
    """One generation row: forced tokens come before sampled ones; a finished call puts its output in the queue."""

    def __init__(self, size: int = 256):
        self.s = special_ids(size)
        self.queue: list[int] = []
        self.call: list[int] | None = None
        self.done = False

    def step(self, sampled: int) -> tuple[int, int]:
        """(token, mask): mask 1 if it is the sampled one."""
        mask = 0 if self.queue else 1
        token = self.queue.pop(0) if self.queue else sampled
        s = self.s
        if token in (s["<|assistant_end|>"], s["<|bos|>"]):
            self.done = True
        if token == s["<|python_start|>"]:
            self.call = []
        elif token == s["<|python_end|>"] and self.call is not None:
            result = calculate(bytes(x for x in self.call if x < 256).decode("utf-8", "replace")) if self.call else None
            if result is not None:
                self.queue = [s["<|output_start|>"], *str(result).encode(), s["<|output_end|>"]]
            self.call = None
        elif self.call is not None:
            self.call.append(token)
        return token, mask


def replay(rows: DataFrame, key: str, sampled: str, most: int = 2048, size: int = 256) -> DataFrame:
    """key, tokens, mask of each row's log of sampled tokens through ``ToolState``, up to its end or ``most`` tokens."""

    @F.pandas_udf("struct<tokens:array<int>,mask:array<int>>")
    def run(logs: pd.Series) -> pd.DataFrame:
        out = []
        for log in logs:
            state, tokens, mask = ToolState(size), [], []
            for x in list(log)[:most]:
                if state.done:
                    break
                t, m = state.step(int(x))
                tokens.append(t)
                mask.append(m)
            out.append((tokens, mask))
        return pd.DataFrame(out, columns=["tokens", "mask"])

    return rows.select(key, run(sampled).alias("r")).select(key, "r.tokens", "r.mask")


def text_deltas(tokens: list[int]) -> list[str]:
    """What a stream of byte tokens shows at each step: held back while the text so far ends in an unfinished or broken character."""
    decoder, held, out = codecs.getincrementaldecoder("utf-8")("replace"), "", []
    for t in tokens:
        held += decoder.decode(bytes([t]))
        ready = held if not decoder.getstate()[0] and not held.endswith("\ufffd") else ""
        out.append(ready)
        held = held[len(ready) :]
    return out


def mock_score(ids: Column, start: Column) -> Column:
    """A stand-in for a model: a number from the checksum of the candidate's ids and its length."""
    tail = F.slice(ids, start + 1, F.size(ids))
    written = F.concat(F.lit("["), F.array_join(F.transform(tail, lambda x: x.cast("string")), ", "), F.lit("]"))
    return -(F.crc32(written.cast("binary")) % 1000) / F.lit(100.0) - F.size(tail)


