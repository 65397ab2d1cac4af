"""Operators against sequential programs."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import metrics, tasks, tokens, validate
from textloom.sources import corpus, text


def test_greedy_shards(spark):
    rng = random.Random(1)
    lengths = [rng.randint(1, 40) for _ in range(203)]
    docs = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(lengths)], "pos long, text string")

    def plain(budget, group):
        shard, held, buffer, out = 0, 0, 0, []
        for n in lengths:
            out.append(shard)
            held, buffer = held + n, buffer + 1
            if held >= budget and buffer % group == 0:
                shard, held, buffer = shard + 1, 0, 0
        return out, shard

    for budget, group in ((100, 8), (300, 4), (10_000, 8)):
        expected, full = plain(budget, group)
        assert [r.shard for r in corpus.greedy_shards(docs, "pos", budget, group).orderBy("pos").collect()] == expected
        kept = corpus.greedy_shards(docs, "pos", budget, group, drop_tail=True).count()
        assert kept == sum(s < full for s in expected)


def test_budget_and_topup(spark):
    docs = spark.createDataFrame([(i, "x" * 10) for i in range(20)], "pos long, text string")
    assert corpus.char_budget(docs, "pos", 35).count() == 4  # the crossing document is in
    totals = spark.createDataFrame([("C", 100), ("R", 70)], "arm string, total long")
    filler = spark.createDataFrame([(i, 8) for i in range(10)], "pos long, chars long")
    got = {r.arm: r.n for r in corpus.parity_topup(totals, filler, 0.05).groupBy("arm").agg(F.count("*").alias("n")).collect()}
    assert got == {"R": 4}


def test_write_and_scan(spark, tmp_path):
    import pyarrow.parquet as pq

    docs = spark.createDataFrame([(i, f"text {i}", i // 1500) for i in range(3000)], "pos long, text string, shard int")
    corpus.write_shards(docs, str(tmp_path / "c"))
    files = sorted((tmp_path / "c").rglob("*.parquet"))
    meta = pq.ParquetFile(files[0]).metadata
    assert len(files) == 2 and meta.row_group(0).num_rows == 1024 and meta.row_group(0).column(0).compression == "ZSTD"
    got = corpus.scan(spark, [str(f) for f in files])
    assert got.count() == 3000 and got.agg(F.max("rg")).first()[0] == 1
    with pytest.raises(ValueError):
        corpus.finalize(docs, docs.where("false"))


def test_resume(spark):
    assert corpus.resume_point(5, 1, 4) == 9
    rows = spark.createDataFrame([(f, g) for f in range(2) for g in range(6)], "file_no int, rg int")
    got = [tuple(r) for r in corpus.epochs(rows, 2, 1, 2, after=(0, 1, 1)).select("epoch", "file_no", "rg").orderBy("epoch", "file_no", "rg").collect()]
    assert got == [(1, 0, 3), (1, 0, 5), (1, 1, 1), (1, 1, 3), (1, 1, 5), *[(2, f, g) for f in range(2) for g in (1, 3, 5)]]


def test_conversations(spark):
    lines = ['[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]', "  ", "nonsense", '[{"role":"user","content":"a"}]', '[{"role":"user","content":"a"},{"role":"user","content":"b"}]']
    got = [r.problem for r in text.conversations(spark.createDataFrame([(x,) for x in lines], "value string")).collect()]
    assert got == [None, "not_json", "too_short", "roles"]


def test_log_values(spark):
    lines = spark.createDataFrame(list(enumerate(["loss: 1,200", "x", "loss: 900"])), "line_no long, value string")
    assert [tuple(r) for r in text.log_values(lines, {"loss": r"loss: ([0-9,]+)"}).collect()] == [("loss", "900")]


def test_slices():
    assert tasks.slice_length(2, 11, 3) == 3
    with pytest.raises(ValueError):
        tasks.task_slice(None, 5, 2)


def test_signed_rank(spark):
    d = [1.0, -1.0, 2.0, 2.0, -3.0, 4.0, 5.0, 0.0, 6.0, 7.0, 8.0]
    got = metrics.signed_rank(spark.createDataFrame([(1, x) for x in d], "c int, d double"), ["c"]).first()
    values = sorted(abs(x) for x in d if x)
    rank = {v: sum(i + 1 for i, x in enumerate(values) if x == v) / values.count(v) for v in values}
    assert got.n == 10 and got.w_plus == sum(rank[x] for x in d if x > 0) and 0 < got.p < 1
    assert metrics.signed_rank(spark.createDataFrame([(1, 1.0)] * 9, "c int, d double"), ["c"]).first().z is None


def test_fits(spark):
    rows = spark.createDataFrame([(float(x), 2.0 * x * x - 8 * x + 3) for x in range(1, 9)], "x double, y double")
    got = metrics.quadratic_vertex(rows, "x", "y").first()
    assert (round(got.a, 6), round(got.b, 6), round(got.best, 6)) == (2, -8, 2)
    weights = {r.name: r.weight for r in metrics.ridge(rows.withColumn("x2", F.col("x") * F.col("x")), ["x", "x2"], "y", 0.0).collect()}
    assert {k: round(v, 6) for k, v in weights.items()} == {"intercept": 3, "x": -8, "x2": 2}


def test_bpe(spark):
    docs = spark.createDataFrame([("abab abab cab",), ("abc abab",), ("",)], "text string")
    merges = tokens.train_bpe(docs, 256 + 4 + 9)
    assert merges[0] == (97, 98)
    ranks = tokens.ranks_of(merges)
    got = docs.select("text", tokens.encoder(ranks)("text").alias("ids")).select("text", tokens.decoder(ranks)("ids").alias("back")).collect()
    assert all(r.text == r.back for r in got)
    with pytest.raises(ValueError):
        tokens.train_bpe(docs, 200)


def plain_pack(docs, capacity, size, crop, pad):
    source, buffer, rows = iter(docs), [], []
    while True:
        row = []
        while len(row) < capacity:
            while len(buffer) < size and (x := next(source, None)) is not None:
                buffer.append(x)
            if not buffer:
                break
            room, best = capacity - len(row), -1
            for i, d in enumerate(buffer):
                if len(d) <= room and (best < 0 or len(d) > len(buffer[best])):
                    best = i
            if best >= 0:
                row += buffer.pop(best)
            elif crop or not row:
                i = min(range(len(buffer)), key=lambda i: len(buffer[i]))
                row += buffer.pop(i)[:room]
            else:
                break
        if not row:
            return rows
        rows.append(row + [pad] * (capacity - len(row)))


@pytest.mark.parametrize("crop", [True, False])
def test_packing(spark, crop):
    rng = random.Random(3)
    docs = [[100 + i] * rng.randint(1, 9) for i in range(60)]
    frame = spark.createDataFrame([(0, i, d) for i, d in enumerate(docs)], "rank long, pos long, ids array<int>")
    got = tokens.pack(frame, "rank", "pos", "ids", 5, buffer=7, crop=crop, pad=0).orderBy("row").collect()
    assert [r.tokens for r in got] == plain_pack(docs, 5, 7, crop, 0)
    stats = tokens.pack_stats(spark.createDataFrame(got), 5).first()
    assert stats.placed + stats.cut == sum(map(len, docs))


def test_calculator():
    assert tokens.calculate("1,000 + 2*3") == 1006
    assert tokens.calculate("'banana'.count('a')") == 3
    for bad in ("2**9", "__import__('os')", "a", "1/0", "", "'a'.upper()", None):
        assert tokens.calculate(bad) is None


def test_tool_state():
    s = {n: tokens.special_id(n) for n in tokens.SPECIALS}
    machine = tokens.ToolState()
    sampled = [s["<|python_start|>"], *b"1+1", s["<|python_end|>"], 65, 65, 65, 66, s["<|assistant_end|>"]]
    got = [machine.step(t) for t in sampled]
    assert [t for t, m in got if m == 0] == [s["<|output_start|>"], ord("2"), s["<|output_end|>"]]
    assert machine.done
    assert "".join(tokens.text_deltas(list("aé🌍".encode()))) == "aé🌍"


def test_contamination(spark):
    docs = spark.createDataFrame([(1, "aaa b", "k"), (2, None, "k"), (3, "xx", "k")], "doc_id long, text string, needle string").drop("needle")
    got = validate.contamination(docs, [(0, "aa"), (1, "b"), (2, "aa")])
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, 1), (1, 1, 1), (1, 2, 1)]


def test_spelling(spark):
    words = tasks.word_index(spark.createDataFrame([(w,) for w in ("banana", "apple", "kiwi", "kiwi")], "word string"))
    assert sorted(r.idx for r in words.collect()) == [0, 1, 2]
    got = tasks.spelling_examples(spark, words, 40, seed=1).collect()
    assert len(got) == 40 and all(r.n_letters == r.word.count(r.letter) and r.parts[-1]["text"].endswith(f"#### {r.n_letters}") for r in got)
