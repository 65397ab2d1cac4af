"""The fact pool, keep-first by either key, tasks, vocabularies and shards against sequential programs."""

import hashlib
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from textloom.operators import evaluation, facts, tokens, validate
from textloom.plans import pool
from textloom.sources import corpus, files

SEED = 7


def number(n, *names):
    key = hashlib.sha256("\0".join([str(SEED), *map(str, names)]).encode()).hexdigest()
    return int(key[:15], 16) % n


def name(*key):
    pick = lambda values, what: values[number(len(values), "novel", *key, what)]
    return f"{pick(facts.NAME_STARTS, 'start')}{pick(facts.NAME_ENDS, 'end')} {number(900, 'novel', *key, 'number') + 100}"


def plain_pool(relations, real, n, contested):
    """Relations in turn, real pairs first, then invented ones; ids and claims are unique; attempts are guarded."""
    sid = lambda *parts: hashlib.sha256("".join(f"\0{p}" for p in parts).encode()).hexdigest()[:16]
    out, ids, claims = [], set(), set()
    fill = lambda t, s, v: t.replace("{s}", s).replace("{v}", v)

    def add(truth, domain, tier, key, subject, value, other, frames, *marks):
        claim, fid = fill(frames[0], subject, value), sid(domain, key, subject, value, truth)
        if fid in ids or claim in claims:
            return
        ids.add(fid)
        claims.add(claim)
        out.append((fid, sid(domain, key, subject, tier, *marks), truth, tier, subject, value, other, claim))

    disputed = round(n * contested)
    wanted = max(1, (n - disputed) // 2)
    turn = 0
    while len(out) < 2 * wanted and turn < 40 * wanted + 1000:
        (key, domain, frames), k = relations[turn % len(relations)], turn // len(relations)
        turn += 1
        pairs = real.get(key, [])
        tier = "real" if k < len(pairs) else "novel"
        subject, value = pairs[k] if tier == "real" else (name("pair", key, k, "subject"), name("pair", key, k, "value"))
        left = [v for v in sorted({v for _, v in pairs}) if v != value]
        if tier == "real" and left:
            other = left[number(len(left), "distractor", key, k)]
        else:
            other = name("pair", key, k, "other")
            other = other if other != value else value + "*"
        for truth, v, c in (("true", value, other), ("false", other, value)):
            add(truth, domain, tier, key, subject, v, c, frames)
    first, turn = len(out), 0
    while len(out) - first < disputed and turn < 40 * disputed + 1000:
        (key, domain, frames), k = relations[turn % len(relations)], turn // len(relations)
        turn += 1
        subject, value, other = (name("contested", key, k, what) for what in ("subject", "value", "other"))
        add("contested", domain, "novel", key, subject, value, other if other != value else value + "*", frames, "contested")
    return out


@pytest.mark.parametrize("n, contested", [(60, 0.08), (1, 0.08), (25, 0.5), (400, 0.1)])
def test_pool(spark, n, contested):
    """With real pairs that repeat a claim, and a relation without any."""
    relations = [("r1", "d1", ["{s} has {v}.", "{v} is of {s}."]), ("r2", "d2", ["{s} has {v}."]), ("r3", "d1", ["No {s} without {v}."])]
    real = {"r1": [("a", "x"), ("b", "y"), ("c", "x")], "r2": [("a", "x"), ("q", "z")]}  # r2's first pair claims what r1's does
    catalogue = spark.createDataFrame([(k, d, f, ["{s}: ___."], i) for i, (k, d, f) in enumerate(relations)], "relation string, domain string, frames array<string>, clozes array<string>, place int")
    pairs = spark.createDataFrame([(k, s, v, i) for k, ps in real.items() for i, (s, v) in enumerate(ps)], "relation string, subject string, value string, place int")
    got = facts.build_pool(pairs, catalogue, n, SEED, contested).orderBy("seq").collect()
    assert [(r.fact_id, r.pair_id, r.truth_value, r.entity_tier, r.subject, r.value, r.competing_value, r.claim_text) for r in got] == plain_pool(relations, real, n, contested)


def test_the_query_s_pool(spark, sf_dir):
    """Of the driver tables: as many facts as asked for, ids and claims unique, pairs of one true and one false fact at most."""
    got = pool.fact_pool_built(spark, sf_dir).collect()
    assert len(got) == 2000 and len({r.fact_id for r in got}) == len({r.claim_text for r in got}) == 2000
    assert sum(r.truth_value == "contested" for r in got) == 160 and {r.entity_tier for r in got} == {"real", "novel"}
    assert all(r.value != r.competing_value for r in got)


def test_first_by_either(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 40), rng.randint(0, 40)) for i in range(200)]
    got = facts.first_by_either(spark.createDataFrame(rows, "i long, a long, b long"), ["i"], ["a", "b"]).collect()
    kept, seen = [], (set(), set())
    for i, a, b in rows:
        if a not in seen[0] and b not in seen[1]:
            kept.append(i)
            seen[0].add(a)
            seen[1].add(b)
    assert [r.i for r in got] == kept


def test_tasks(spark):
    with pytest.raises(ValueError):
        evaluation.Task("x", "other", lambda: F.lit(True))
    for bad in ({"start": -1}, {"start": 3, "stop": 2}, {"step": 0}):
        with pytest.raises(ValueError):
            evaluation.Task("x", "generative", lambda: F.lit(True), **bad)
    task = evaluation.Task("x", "categorical", lambda: F.col("prediction") == F.col("answer"), start=2, stop=11, step=3)
    assert task.size(50) == 3 and evaluation.Task("x", "generative", lambda: F.lit(True), start=4).size(4) == 0
    with pytest.raises(ValueError):
        evaluation.Task("x", "generative", lambda: F.lit(True), start=4).size(3)
    rows = spark.createDataFrame([("x", i, "a", "a" if i != 5 else None) for i in range(20)], "task string, local_idx long, prediction string, answer string")
    assert [(r.local_idx, r.idx) for r in task.examples(rows).orderBy("idx").collect()] == [(2, 0), (5, 1), (8, 2)]
    assert [(r.n, r.passed) for r in evaluation.evaluate([task], rows).collect()] == [(3, 2)]
    assert [(r.n, r.passed) for r in evaluation.evaluate([task], rows, most=2).collect()] == [(2, 1)]
    assert evaluation.evaluate([task], rows.where("false")).count() == 0


def test_vocabulary(spark, tmp_path):
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256}
    tokens.save_vocabulary(tokens.vocabulary(spark, ranks), str(tmp_path / "v"))
    assert tokens.load_vocabulary(spark, str(tmp_path / "v")) == (ranks, tokens.SPECIALS)
    with pytest.raises(PySparkException, match="no token"):
        tokens.bos_id(tokens.vocabulary(spark, ranks, ("<|x|>",))).collect()


def test_deltas_hold_back_what_is_unfinished():
    def plain(ids):
        held, shown, out = [], "", []
        for t in ids:
            held.append(t)
            whole = bytes(held).decode("utf-8", "replace")
            out.append("" if whole.endswith("�") else whole[len(shown) :])
            shown = shown if whole.endswith("�") else whole
        return out

    rng = random.Random(2)
    for _ in range(200):
        ids = list("".join(rng.choice(["a", "é", "€", "🌍", "�"]) for _ in range(8)).encode())
        if rng.random() < 0.5:
            ids.insert(rng.randint(0, len(ids)), rng.randint(128, 255))
        assert tokens.text_deltas(ids) == plain(ids), ids


def test_shards_on_demand(spark, tmp_path):
    folder = str(tmp_path / "s")
    ask = lambda source, i: corpus.ensure_shard(spark, source, i, folder, 5, 3000, 4)
    with pytest.raises(ValueError, match="unknown"):
        ask("other", 0)
    with pytest.raises(ValueError, match="6 shards"):
        ask("download", 6)
    with pytest.raises(FileNotFoundError):
        ask("download", 5)
    first = ask("synthetic", 3).collect()
    assert ask("synthetic", 3).collect() == first and ask("download", 3).collect() == first  # what is there is read
    texts = [r.text for r in first]
    assert min(map(len, texts)) >= 750 and sum(map(len, texts)) >= 3000 > sum(map(len, texts[:-1]))
    assert files.list_files(spark, [str(tmp_path / "none")]).count() == 0


def test_needles_in_parts(spark, monkeypatch):
    """More needles than an automaton holds: passes by parts find the same."""
    docs = spark.createDataFrame([(i, f"w{i % 7} xw{i % 5}, w{i}") for i in range(40)], "doc_id long, text string")
    needles = spark.createDataFrame([(i, f"w{i}") for i in range(12)] + [(50, "w1")], "needle long, string string")
    want = sorted(map(tuple, validate.contamination(docs, needles).collect()))
    edge = sorted(map(tuple, validate.boundary_leaks(docs, needles).collect()))
    monkeypatch.setattr(validate, "MOST_NEEDLES", 3)
    assert sorted(map(tuple, validate.contamination(docs, needles).collect())) == want
    texts = {r.doc_id: r.text for r in docs.collect()}
    import re

    assert edge == sorted((d, n, ) for d, t in texts.items() for n, s in [(r.needle, r.string) for r in needles.collect()] if re.search(rf"(?<![^\W_]){s}", t))


def test_pack_progress(spark):
    rng = random.Random(1)
    rows = [(rank, row, rng.randint(0, 4)) for rank in range(2) for row in range(30)]
    got = {(r.rank, r.row): r for r in tokens.pack_progress(spark.createDataFrame(rows, "rank long, row long, n_docs long"), 50, 2, 4).collect()}
    for rank in range(2):
        consumed = 0
        for row in range(30):
            consumed += 2 * next(n for a, b, n in rows if (a, b) == (rank, row))
            r = got[rank, row]
            assert (r.consumed, r.epoch, r.last) == (consumed, (consumed - 1) // 50 + 1, consumed >= 50 and row % 4 == 3)
            assert r.progress == pytest.approx(min(1.0, consumed / 50))


def test_bpe_rounds_equal_the_loop(spark, monkeypatch):
    """The distributed rounds give the driver's merges, with ties, runs of one letter and words of one byte."""
    rng = random.Random(6)
    stems = ["aaaa", "abab", "banana", "the", "there", "then", "xyz", "zz", "é", "q"]
    texts = [" ".join(rng.choice(stems) + rng.choice(["", "s", "ing", "a"]) for _ in range(40)) for _ in range(30)] + ["", "a"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    loop = tokens.train_bpe(docs, 256 + 45 + 9)
    rounds = []
    scratch = tokens.scratch
    monkeypatch.setattr(tokens, "scratch", lambda s, n: rounds.append(n) or scratch(s, n))
    assert tokens.train_bpe(docs, 256 + 45 + 9, driver_words=0) == loop and len(loop) == 45
    assert rounds.count("merged") < 45  # some rounds make several merges
    monkeypatch.setattr(tokens, "MANY_MERGES", 20)  # the loop goes over to touched words in between
    assert tokens.train_bpe(docs, 256 + 45 + 9) == loop
    monkeypatch.setattr(tokens, "MANY_MERGES", 0)
    assert tokens.train_bpe(docs, 256 + 45 + 9) == loop
