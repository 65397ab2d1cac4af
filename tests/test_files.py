"""File sources and sinks, programs, streams."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import evaluation, facts, validate
from textloom.sources import files
from textloom.streaming import streams


def test_manifest_round_trip(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = spark.createDataFrame([("b", "true", "d", "real", "R", 4, "b:0", "True", "False", "shard_00000"), ("a", "false", "d", "novel", "X", 1, "a:0", "False", "False", "shard_00001")], files.MANIFEST)
    files.write_manifest(rows, path, ["arm", "fact_id"])
    assert len(list((tmp_path / "m").glob("part-*.csv"))) == 1
    assert sorted(files.read_csv(spark, path, files.MANIFEST).collect()) == sorted(rows.collect())


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n  \n{"b": "y"}\n')
    got = files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int, b string").collect()
    assert sorted(map(tuple, got), key=str) == [(1, None), (None, "y")]
    files.write_jsonl(spark.createDataFrame([(2, "z")], "a int, b string"), str(tmp_path / "out"))
    assert [tuple(r) for r in files.read_jsonl(spark, str(tmp_path / "out"), "a int, b string").collect()] == [(2, "z")]


def test_report(spark):
    rows = spark.createDataFrame([(1, "loss", "0.1234"), (0, "steps", "10,000")], "place int, key string, value string")
    got = files.report_section("Base Model", rows, F.lit("2025-01-02 03:04:05").cast("timestamp")).first()
    assert got.file == "base-model.md"
    assert got.text == "## Base Model\ntimestamp: 2025-01-02 03:04:05\n\n- steps: 10,000\n- loss: 0.1234\n\n"


def test_environment_and_ids(spark):
    assert files.environment(spark).first().spark == spark.version
    assert [r.shard for r in files.shard_ids(spark, 3, 9).collect()] == [0, 1, 2, 9]


def test_programs(spark):
    rows = spark.createDataFrame([(0, "print(1)"), (1, "1/0"), (2, "while True: pass")], "i int, code string")
    with pytest.raises(PermissionError):
        evaluation.run_programs(rows, "code")
    got = {r.i: (r.success, r.output.strip()) for r in evaluation.run_programs(rows, "code", allow=True, seconds=2).collect()}
    assert got == {0: (True, "1"), 1: (False, ""), 2: (False, "")}


def test_prompt_spans(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [tuple(s) for s in one(evaluation.prompt_span("schema", F.array(a(1, 2, 9), a(1, 3, 4, 9))))] == [(2, 3), (3, 4)]
    assert [tuple(s) for s in one(evaluation.prompt_span("language_modeling", F.array(a(1, 2), a(1, 2, 3))))] == [(2, 3)]
    assert one(evaluation.prompt_span("language_modeling", F.array(a(1, 5), a(1, 2, 3)))) is None
    with pytest.raises(ValueError):
        evaluation.prompt_span("other", F.array(a(1)))


def test_too_many_needles(spark, monkeypatch):
    monkeypatch.setattr(validate, "MOST_NEEDLES", 1)
    with pytest.raises(ValueError):
        validate.contamination(spark.createDataFrame([("x",)], "text string"), [(0, "a"), (1, "b")])


def test_dense(spark):
    rows = spark.createDataFrame([(x,) for x in (5, -3, 10**15, 7, 0)], "k long")
    assert [(r.k, r["__i"]) for r in facts.dense(rows, "k").orderBy("k").collect()] == list(zip(sorted((5, -3, 10**15, 7, 0)), range(5), strict=True))


def test_stream_resumes(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    write = lambda lo: spark.range(lo, lo + 10).select(F.col("id").alias("pos"), F.col("id").cast("string").alias("text")).coalesce(1).write.mode("append").parquet(source)
    write(0)
    stream = lambda: streams.shard_stream(spark, source, "pos long, text string")
    streams.run_to_end(stream(), sink, checkpoint)
    write(10)
    streams.run_to_end(stream(), sink, checkpoint)  # only what is new
    assert sorted(r.pos for r in spark.read.parquet(sink).collect()) == list(range(20))


def test_arms(spark, tmp_path):
    spark.createDataFrame([("C", "a"), ("R", "b"), ("C", "c")], "arm string, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    streams.write_arms(streams.shard_stream(spark, str(tmp_path / "in"), "arm string, text string"), str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("arm").count().collect()
    assert {r.arm: r["count"] for r in got} == {"C": 2, "R": 1}
