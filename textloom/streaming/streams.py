"""Structured Streaming: resumable corpus scans, stateful packing and tool use, streamed arms, windows on events."""

from __future__ import annotations

import os
import tempfile
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.operators.tokens import CHUNK, BestFit, ToolState
from textloom.sources.scratch import bounded_batches, scratch


def shard_stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """A stream of a folder's shards in the order of their names' times, ``files`` a trigger. The checkpoint is the offset: a restart goes on exactly behind the last committed file."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run_to_end(stream: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Write all that is there, in triggers, to Parquet, and stop."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
    query.awaitTermination()
    return query


def write_arms(stream: DataFrame, path: str, checkpoint: str, arm: str = "arm") -> StreamingQuery:
    """One input, a folder an arm: each micro-batch is written once, partitioned by arm, under its own batch folder, so that a retry replaces it."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy(arm).parquet(f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def pack_stream(docs: DataFrame, rank: str, order: str, ids: str, capacity: int, buffer: int) -> DataFrame:
    """Best-fit packed rows of a stream, a state a rank: the buffer of waiting documents and the row being filled.

    A row goes out when it is full, which needs a full buffer before each placement; what is in the buffer stays in
    the state and its checkpoint, so nothing is lost at a restart. All documents of a batch are placed by their whole
    lengths; their ids wait in a local file that ends with the task. A document that is longer than a row fills one and
    is cut off there, so no more than its first ``capacity`` ids are ever read: only those are sent (Spark puts all
    that a rank gets into one buffer of its JVM, 2 GB at most).
    """
    bounded_batches(docs.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, lengths, rows = state.get if state.exists else ([], [], 0)
        orders, starts, sizes = [], array("q"), array("q")  # a place in the file for each document
        with tempfile.TemporaryFile() as file:

            def keep(x, length: int) -> None:
                starts.append(file.tell())
                sizes.append(length)
                file.write(np.asarray(x, np.int32).tobytes())

            def read(i: int, n: int) -> np.ndarray:
                return np.frombuffer(os.pread(file.fileno(), 4 * n, starts[i]), np.int32)

            for x, n in zip(held, lengths, strict=True):
                keep(x, n)
            old = len(starts)
            for b in batches:
                for o, x, n in zip(b["order"].tolist(), b["ids"], b["length"].tolist(), strict=True):
                    orders.append(o)
                    keep(x, n)
            file.flush()
            arrived = [*range(old), *(old + i for i in sorted(range(len(orders)), key=orders.__getitem__))]
            waiting, left, gone, out = BestFit(capacity, 0, True), len(arrived), bytearray(len(starts)), []
            for i in arrived:
                waiting.add(sizes[i], i)
            made = waiting.placements(iter(()))
            while left > buffer:
                parts = next(made, [])
                if sum(n for _, n, _ in parts) < capacity:
                    break
                for i, _, _ in parts:
                    gone[i] = 1
                left -= len(parts)
                out.append((key[0], rows, np.concatenate([read(i, n) for i, n, _ in parts])))
                rows += 1
                if len(out) * capacity >= CHUNK:
                    yield pd.DataFrame(out, columns=["rank", "row", "tokens"])
                    out = []
            kept = [i for i in arrived if not gone[i]]
            state.update(([read(i, min(sizes[i], capacity)).tolist() for i in kept], [sizes[i] for i in kept], rows))
        yield pd.DataFrame(out, columns=["rank", "row", "tokens"])

    own = F.coalesce(F.col(ids), F.array().cast("array<int>"))
    keyed = docs.select(F.col(rank).cast("long").alias("rank"), F.col(order).alias("order"), F.slice(own, 1, capacity).alias("ids"), F.size(own).alias("length"))
    return keyed.groupBy("rank").applyInPandasWithState(step, "rank long, row long, tokens array<int>", "held array<array<int>>, lengths array<int>, rows long", "append", GroupStateTimeout.NoTimeout)


#: Groups of rows that share a state. A row's group never changes, so a stream has to keep the number it began with.
TOOL_GROUPS = 4096


def tool_stream(events: DataFrame, size: int = 256, groups: int = TOOL_GROUPS) -> DataFrame:
    """row_id, step, token, mask of a stream of sampled tokens (row_id, step, token): the tool state machine of each row.

    Rows share a state by hash, as a call of Python for each row would take most of the time: the finished ones, and
    the queue and the open call of the others.
    """
    bounded_batches(events.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        finished, machines = set(), {}
        if state.exists:
            done, *open_rows = state.get
            finished.update(done)
            for row, queue, call, calling in zip(*open_rows, strict=True):
                m = machines[row] = ToolState(size)
                m.queue, m.call = list(queue), (list(call) if calling else None)
        rows, steps, tokens = (np.concatenate(x) for x in zip(*((b["row_id"].to_numpy(), b["step"].to_numpy(), b["token"].to_numpy()) for b in batches), strict=True))
        order, out = np.lexsort((tokens, steps, rows)), []
        for row, s, t in zip(rows[order].tolist(), steps[order].tolist(), tokens[order].tolist(), strict=True):
            if row in finished:
                continue
            m = machines.get(row) or machines.setdefault(row, ToolState(size))
            out.append((row, s, *m.step(t)))
            if m.done:
                finished.add(row)
                del machines[row]
        of = list(machines.values())
        state.update((sorted(finished), list(machines), [m.queue for m in of], [m.call or [] for m in of], [m.call is not None for m in of]))
        yield pd.DataFrame(out, columns=["row_id", "step", "token", "mask"])

    group = F.pmod(F.xxhash64("row_id"), F.lit(groups)).alias("__group")
    kept = "finished array<long>, rows array<long>, queue array<array<int>>, call array<array<int>>, calling array<boolean>"
    return events.select("row_id", "step", "token", group).groupBy("__group").applyInPandasWithState(step, "row_id long, step long, token int, mask int", kept, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums a window and type. The source's times have no zone; they are read as the session's."""
    at = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return at.groupBy(F.window("__t", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def stored_stream(stream: DataFrame) -> DataFrame:
    """All that a bounded stream gives, as a table in the shared folder; nothing of it goes through the driver."""
    path, mark = (scratch(stream.sparkSession, n) for n in ("streamed", "mark"))
    run_to_end(stream, path, mark)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def collect_stream(stream: DataFrame, name: str, mode: str = "append", run: Callable[[StreamingQuery], None] | None = None) -> DataFrame:
    """All that a bounded stream gives, as a table in memory; for tests and small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    if run:
        run(query)
    return stream.sparkSession.table(name)
