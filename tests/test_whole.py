"""Queries cover whole tables and whole texts: small tables with long texts against plain programs."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import plain_pack

from textloom.plans import catalog, tokenizing
from textloom.streaming import streams

QUERIES = catalog.queries()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    made = {i: "".join(rng.choice(["a", "bc ", "é", "dog\n", "7"]) for _ in range(rng.choice([5, 90, 700, 3000]))) for i in range(130)}
    return made | {130: "", 131: "x" * 9000}


@pytest.fixture(scope="module")
def long_dir(spark, texts, tmp_path_factory):
    path = tmp_path_factory.mktemp("long")
    rows = [(i, t, "dog", "src", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def encoded(texts, rank, of):
    return [[256, *t.encode()] for i, t in sorted(texts.items()) if i % of == rank]


@pytest.mark.parametrize("crop", [True, False])
def test_packing_takes_whole_texts(spark, long_dir, texts, crop):
    rows = tokenizing.packed(spark, long_dir, crop).orderBy("rank", "row").collect()
    for rank in range(8):
        docs, own = encoded(texts, rank, 8), [r for r in rows if r["rank"] == rank]
        assert [r.tokens for r in own] == plain_pack(docs, 513, 100, crop, 256)
        assert sum(r.placed + r.cut for r in own) == sum(map(len, docs))
    name = "pack_bestfit" if crop else "pack_bestfit_pad"
    assert sum(r.placed for r in QUERIES[name](spark, long_dir).collect()) == sum(r.placed for r in rows)


def test_pack_stats_counts_whole_texts(spark, long_dir, texts):
    got = {r["rank"]: (r.total, r["size"]) for r in QUERIES["pack_stats"](spark, long_dir).collect()}
    assert got == {rank: (sum(map(len, encoded(texts, rank, 8))), 513) for rank in range(8)}


def streamed(docs, capacity, buffer):
    """Full rows while more than ``buffer`` documents wait, the largest that fits first, else the shortest cut."""
    held, n = list(docs), 0
    while len(held) > buffer:
        left, room = list(held), capacity
        while room and left:
            fits = [d for d in left if len(d) <= room]
            best = max(fits, key=len) if fits else min(left, key=len)
            left.remove(best)
            room -= min(room, len(best))
        if room:
            break
        held, n = left, n + 1
    return n


def test_stream_pack_takes_whole_texts(spark, long_dir, texts, monkeypatch):
    many = QUERIES["stream_pack"](spark, long_dir).collect()
    assert many
    with monkeypatch.context() as m:  # what goes into the stream, row by row: full rows alone don't show how long their documents were
        m.setattr(streams, "pack_stream", lambda docs, rank, order, ids, capacity, buffer: docs.select(rank, F.col(order).alias("row"), F.col(ids).alias("tokens")))
        assert {r.row: r["size"] for r in QUERIES["stream_pack"](spark, long_dir).collect()} == {i: len(t.encode()) + 1 for i, t in texts.items()}
    for rank in range(4):
        own = sorted(r.row for r in many if r["rank"] == rank)
        assert own == list(range(streamed(encoded(texts, rank, 4), 257, 20)))
    assert {r["size"] for r in many} <= {257}


def test_stream_tools_takes_all_rows(spark, long_dir, texts):
    assert {r.row_id: r.n for r in QUERIES["stream_tools"](spark, long_dir).collect()} == dict.fromkeys(texts, 2)


def test_fewshot_prompt_takes_all_items(spark, tmp_path):
    ids = [*range(60), 75, 90]  # over 40, and with gaps
    spark.createDataFrame([(i,) for i in ids], "item_id long").write.parquet(f"{tmp_path}/benchmark.parquet")
    draw = lambda n, *names: int(hashlib.sha256("\0".join(["11", "fewshot", *map(str, names)]).encode()).hexdigest()[:15], 16) % n
    expected = {}
    for a in ids:
        left = [b for b in ids if b != a]
        shots = [left.pop(draw(len(left), a, j)) for j in range(3)]
        expected[a] = "".join(f"q{b} a{b}\n\n" for b in shots) + f"q{a}"
    assert {r["item"]: r.prompt for r in QUERIES["fewshot_prompt"](spark, str(tmp_path)).collect()} == expected


def test_interp_takes_all_events(spark, tmp_path):
    rng = random.Random(5)
    events = [(i, rng.randrange(50), round(rng.uniform(0, 9), 3)) for i in range(3000)]
    spark.createDataFrame(events, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    curves, expected = {}, {}
    for i, user, value in events:
        curve = curves.setdefault(user % 20, {})
        curve[i // 100] = max(value, curve.get(i // 100, value))
    for i, user, _ in events:
        xs = sorted(curves[user % 20])
        at = i % 120 - 5.5
        expected[user % 20, at] = np.interp(at, xs, [curves[user % 20][x] for x in xs])
    got = {(r.k, r.pt): r.value for r in QUERIES["interp"](spark, str(tmp_path)).collect()}
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(expected[k], abs=1e-6) for k in expected)


def test_text_queries_take_whole_texts(spark, long_dir, texts):
    replaced = {r.doc_id: r.text for r in QUERIES["replace_first"](spark, long_dir).collect()}
    assert replaced == {i: t.replace("dog", "<dog>", 1) for i, t in texts.items()}
    spans = {r.doc_id: (r.start, r.merged) for r in QUERIES["candidate_span"](spark, long_dir).collect()}
    assert spans == {i: (len(t.encode()) + 1, False) for i, t in texts.items()}
    scores = {r.doc_id: r.score for r in QUERIES["dry_score"](spark, long_dir).collect()}
    for i, t in texts.items():
        tail = list(t.encode())[5:]
        assert scores[i] == pytest.approx(-(zlib.crc32(str(tail).encode()) % 1000) / 100 - len(tail))
