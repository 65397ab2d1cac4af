"""What a driver or a task holds doesn't grow with the tables, and results are those of plain programs or SQL."""

import datetime as dt
import random
import time

import duckdb
import numpy as np
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import arrays, render
from textloom.operators import facts, tokens
from textloom.streaming import streams


def words_of(spark, rng, n=40):
    texts = [" ".join(rng.choice(["aaaa", "abab", "banana", "the", "then", "ß", "é", "zz"]) + rng.choice(["", "s", "ing"]) for _ in range(30)) for _ in range(n)] + ["", "a"]
    return spark.createDataFrame([(t,) for t in texts], "text string")


def test_bpe_merges_many_bytes_where_they_lie(spark, monkeypatch):
    """Few words with many bytes stay off the driver as well, tasks take them up in parts, and no round's table but the last is left."""
    docs = words_of(spark, random.Random(8))
    expected, paths = tokens.train_bpe(docs, 256 + 40 + 9), []
    monkeypatch.setattr(tokens, "DRIVER_BYTES", 20)
    monkeypatch.setattr(tokens, "CHUNK", 30)
    monkeypatch.setattr(tokens, "_merge_loop", lambda *a: pytest.fail("words on the driver"))
    scratch = tokens.scratch
    monkeypatch.setattr(tokens, "scratch", lambda s, n: paths.append(scratch(s, n)) or paths[-1])
    assert tokens.train_bpe(docs, 256 + 40 + 9) == expected
    import os

    assert [os.path.isdir(p) for p in paths] == [True, *[False] * (len(paths) - 2), True]


def test_bpe_loop_counts_in_parts(spark, monkeypatch):
    docs = words_of(spark, random.Random(9))
    expected = tokens.train_bpe(docs, 256 + 40 + 9)
    monkeypatch.setattr(tokens, "CHUNK", 7)
    assert tokens.train_bpe(docs, 256 + 40 + 9) == expected


def test_stream_pack_goes_on_with_little_held(spark, tmp_path, monkeypatch):
    """Over two batches: what waits is in the state, ids are in a file, rows go out in parts, and nothing goes to the driver's memory table."""
    rng = random.Random(5)
    docs = {i: [rng.randrange(1000) for _ in range(rng.choice([0, 1, 3, 8, 20, 21, 22, 90]))] for i in range(120)}
    for part in (0, 1):
        rows = [(i % 2, i, x) for i, x in docs.items() if (i >= 60) == part]
        spark.createDataFrame(rows, "rank long, pos long, ids array<int>").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    monkeypatch.setattr(streams, "CHUNK", 40)
    monkeypatch.setattr(streams, "collect_stream", lambda *a: pytest.fail("rows on the driver"))
    stream = streams.shard_stream(spark, str(tmp_path / "in"), "rank long, pos long, ids array<int>")
    got = streams.stored_stream(streams.pack_stream(stream, "rank", "pos", "ids", 20, 5)).collect()
    for rank in (0, 1):
        held, expected = [], []
        for part in (0, 1):
            held += [x for i, x in docs.items() if i % 2 == rank and (i >= 60) == part]
            while len(held) > 5:
                left, row = list(held), []
                while len(row) < 20 and left:
                    fits = [x for x in left if len(x) <= 20 - len(row)]
                    best = max(fits, key=len) if fits else min(left, key=len)
                    left.pop(next(i for i, x in enumerate(left) if x is best))
                    row += best[: 20 - len(row)]
                if len(row) < 20:
                    break
                held = left
                expected.append(row)
        assert [r.tokens for r in sorted(got, key=lambda r: r.row) if r["rank"] == rank] == expected


def test_stream_pack_sends_what_a_row_can_take(spark, tmp_path, monkeypatch):
    """Of a document over a row's length the first ids and the length; nulls are empty."""
    spark.createDataFrame([(0, 1, list(range(50))), (0, 2, None), (0, 3, [7])], "rank long, pos long, ids array<int>").write.parquet(str(tmp_path / "in"))
    stream, sent = streams.shard_stream(spark, str(tmp_path / "in"), "rank long, pos long, ids array<int>"), []
    group = type(stream).groupBy
    monkeypatch.setattr(type(stream), "groupBy", lambda self, *a: sent.append(self) or group(self, *a))
    packed = streams.pack_stream(stream, "rank", "pos", "ids", 20, 0)
    assert [r.tokens for r in streams.stored_stream(packed).collect()] == [[7, *range(19)]]
    assert sorted((r["order"], r.ids, r.length) for r in streams.stored_stream(sent[0]).collect()) == [(1, list(range(20)), 50), (2, [], 0), (3, [7], 1)]


def test_stream_pack_stays_off_the_driver(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(streams, "collect_stream", lambda *a: pytest.fail("rows on the driver"))
    from textloom.plans import catalog

    assert catalog.queries()["stream_pack"](spark, sf_dir).count() > 0


def test_deltas_of_whole_texts(spark, monkeypatch):
    """The quick way for clean text shows what the decoder does step by step; ids that end a stream, broken bytes, nulls."""
    rng = random.Random(3)
    logs = [list("".join(rng.choice(["a", "é", "€", "🌍", "\n"]) for _ in range(n)).encode()) for n in (0, 1, 5, 40)]
    logs += [[*logs[2], 200, 65], list("a�b".encode()), logs[3][:-1] + [tokens.special_id("<|assistant_end|>"), 65], [226, 130], None]
    monkeypatch.setattr(tokens, "PIECE", 20)
    rows = spark.createDataFrame(list(enumerate(logs)), "i int, ids array<int>").coalesce(1)
    got = {}
    for r in tokens.stream_text(rows, "i", "ids").collect():
        got.setdefault(r.i, []).append((r.step, r.delta))
    for i, log in enumerate(logs):
        held = [t for t in (log or [])]
        held = held[: held.index(260)] if 260 in held else held
        assert got.get(i, []) == [(k, d) for k, d in enumerate(tokens.text_deltas(held)) if d], log


def test_text_deltas_brings_no_characters_together(spark, sf_dir):
    """A text's steps stay in its row: no shuffle of a row a character."""
    from textloom.plans import catalog

    plan = catalog.queries()["text_deltas"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_pack_gives_rows_in_parts(spark, monkeypatch):
    """No task makes a list of all rows of a rank: rows go out while documents still come in."""
    docs = spark.createDataFrame([(i % 2, i, [i] * (i % 7)) for i in range(300)], "rank long, pos long, ids array<int>")
    whole = tokens.pack(docs, "rank", "pos", "ids", 5, buffer=3).orderBy("rank", "row").collect()
    monkeypatch.setattr(tokens, "CHUNK", 20)
    assert tokens.pack(docs, "rank", "pos", "ids", 5, buffer=3).orderBy("rank", "row").collect() == whole
    seen, taken = [], 0

    def source():
        nonlocal taken
        for i in range(100):
            taken += 1
            yield np.arange(5), i

    for _ in tokens.BestFit(5, 3, True).rows(source()):
        seen.append(taken)
    assert len(seen) == 100 and seen[0] <= 4


def test_encoder_and_decoder_in_parts(spark, monkeypatch):
    """Nulls, empty texts and a text over a part's size; ids that are no text decode to replacement characters."""
    ranks = tokens.ranks_of([(104, 101), (116, 256)])
    texts = [None, "", "the hé", None, "the " * 50, "x", "🌍", ""] * 3
    monkeypatch.setattr(tokens, "PIECE", 9)
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    got = frame.select("i", "text", tokens.encoder(ranks, prepend=300, append=301)("text").alias("ids")).orderBy("i").collect()
    encode = lambda t: None if t is None else [300, *tokens.tiktoken_encoding(ranks).encode_ordinary(t), 301]
    assert [r.ids for r in got] == [encode(t) for t in texts]
    back = frame.select("i", tokens.decoder(ranks)(tokens.encoder(ranks)("text")).alias("text")).orderBy("i").collect()
    assert [r.text for r in back] == texts
    odd = spark.createDataFrame([([200, 65],), ([],), (None,), ([257, 258],)], "ids array<int>").select(tokens.decoder(ranks, ("<|x|>",))("ids").alias("t"))
    assert [r.t for r in odd.collect()] == ["�A", "", None, "the<|x|>"]


def test_run_duration_rounds_like_its_sql(spark, tmp_path):
    """Spans within a half of a second of a minute's end, halves to even seconds, one event, a day and more."""
    at = dt.datetime(2024, 1, 1, 0, 0, 7, 250_000)
    spans = [0, 59.4, 59.5, 59.499999, 3599.5, 3599.6, 60.5, 119.5, 118.5, 90061.75, 5e6 - 0.5]
    rows = [(k, at + dt.timedelta(seconds=x)) for k, span in enumerate(spans) for x in {0, span}]
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz").write.parquet(str(tmp_path / "events.parquet"))
    from textloom.plans import catalog

    con = duckdb.connect()
    con.execute(f"create view events as from '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(map(tuple, catalog.queries()["run_duration"](spark, str(tmp_path)).collect())) == sorted(con.sql(catalog.oracle_sql()["run_duration"]).fetchall())


def test_common_prefix_in_one_pass(spark, tmp_path):
    """Against SQL: long texts that share much (made anew at each place, they took minutes), none, a null, one message."""
    long = "ab é" * 15_000
    texts = {1: [long + "x", long + "y"], 2: [long, long + "y"], 3: ["", "a"], 4: [None, "a"], 5: ["abc", None], 6: ["a"], 7: ["🌍a", "🌍b", "q"], 8: ["b", "a"]}
    rows = [(c, i, "user", t) for c, ts in texts.items() for i, t in enumerate(ts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    from textloom.plans import catalog

    began = time.monotonic()
    got = {r.conv_id: r.prefix for r in catalog.queries()["common_prefix"](spark, str(tmp_path)).collect()}
    assert time.monotonic() - began < 30
    assert got == {1: 60_000, 2: 60_000, 3: 0, 4: 0, 5: 0, 6: None, 7: 1, 8: 0}
    con = duckdb.connect()
    con.execute(f"create view conversations as from '{tmp_path}/conversations.parquet/*.parquet' where conv_id > 2")  # the SQL is quadratic itself
    assert got.items() >= dict(con.sql(catalog.oracle_sql()["common_prefix"]).fetchall()).items()
    three = F.array(*(F.array(*map(F.lit, x)) for x in ([1, 2, 3, 4], [1, 2, 3], [1, 2, 5, 4])))
    assert spark.range(1).select(arrays.common_prefix(three)).first()[0] == 2


@pytest.mark.parametrize("groups", [1, 3])
def test_tool_stream_goes_on_with_its_rows(spark, tmp_path, monkeypatch, groups):
    """Over three batches, with calls and forced tokens across their ends, finished rows that get more, and rows that begin late."""
    rng, s = random.Random(7), {n: tokens.special_id(n) for n in tokens.SPECIALS}
    logs = {}
    for row in range(40):
        call = [s["<|python_start|>"], *rng.choice([b"1+1", b"", b"x", b"12*12"]), s["<|python_end|>"]]
        logs[row] = [65] * rng.randrange(4) + call * rng.randrange(3) + [66] * rng.randrange(9) + [s["<|assistant_end|>"]] * rng.randrange(2) + [67, 68]
    part_of = lambda row, i: min(i // 4, 2) if row % 5 else 2
    for part in range(3):
        rows = [(r, i, t) for r, log in logs.items() for i, t in enumerate(log) if part_of(r, i) == part]
        rng.shuffle(rows)
        spark.createDataFrame(rows, "row_id long, step long, token int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.shard_stream(spark, str(tmp_path / "in"), "row_id long, step long, token int")
    monkeypatch.setattr(streams, "collect_stream", lambda *a: pytest.fail("rows on the driver"))
    got = {}
    for r in streams.stored_stream(streams.tool_stream(stream, groups=groups)).orderBy("row_id", "step").collect():
        got.setdefault(r.row_id, []).append((r.token, r["mask"]))
    for row, log in logs.items():
        machine, expected = tokens.ToolState(), []
        for t in log:
            if machine.done:
                break
            expected.append(machine.step(t))
        assert got[row] == expected


@pytest.mark.parametrize("name", ["wrapper_probes", "render_occurrence"])
def test_renderings_are_made_once(spark, sf_dir, name):
    """The wrapper's verb is drawn at one place of the plan (each more is one more rendering of the row), carriers are split before the join, and rows go to all tasks."""
    from textloom.plans import catalog

    before = spark.conf.get("spark.sql.maxPlanStringLength"), spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        frame = catalog.queries()[name](spark, sf_dir)
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before[1])
    assert plan.count("claimed,argued") == 1
    assert "RepartitionByExpression" in plan
    assert name != "render_occurrence" or plan.count("split(translate(") == 1 and plan.index("split(translate(") > plan.index("Join Inner")


def test_embedding_around_a_place(spark):
    """The parts around a place are those of ``embed``, also without sentences or a carrier."""
    carriers = ["One. Two here. Three.", "Only", "  ", "", None]
    rows = spark.createDataFrame([(c, k / 4) for c in carriers for k in range(5)], "c string, f double")
    a = render.around(render.sentences(F.col("c")), F.col("f"))
    whole = F.coalesce(render.embed(F.col("c"), F.lit("S."), F.col("f")), F.lit("S."))
    for r in rows.select(F.concat(a["before"], F.lit("S."), a["after"]).alias("x"), whole.alias("y")).collect():
        assert r.x == r.y


def test_external_ids_are_whole(spark):
    """Places of over five digits keep them all, so that no two facts share an id."""
    ids = [r.fact_id for r in facts.external_ids(spark.range(99_998, 100_012), "id").collect()]
    assert ids[0] == "external_99998" and ids[2] == "external_100000" and len(set(ids)) == 14
