"""Language id, toxicity, mixing, surrogates and the pipeline on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import domain_mixing, language_id, toxicity
from textloom.llm.common import cut


def corpus(n=240):
    rng = random.Random(4)
    stock = {"en": "the of and to in is that was he for it with".split(), "de": "der die und nicht für über schön auch wird ein".split(), "fr": "été être où le la des vous très à ça".split()}
    rows = []
    for i in range(n):
        lang = ("en", "de", "fr")[i % 3]
        words = [rng.choice(stock[lang]) for _ in range(rng.randint(8, 120))]
        bad = i % 5 == 0
        if bad:
            words.insert(rng.randint(0, len(words)), rng.choice(["scoundrel", "scoundrels", "Sc0undrel"]))
        rows.append((i, " ".join(words), lang, int(bad)))
    return rows


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("labelled") / "d")
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, toxic int").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def net(labelled):
    return language_id.train(labelled.where(~language_id.held_out()))


def test_language(labelled, net, docs, empty):
    got = labelled.join(language_id.identify(labelled, net).withColumnRenamed("doc_id", "d"), F.col("doc_id") == F.col("d")).where(language_id.held_out())
    rows = got.collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.95 and all(0 <= r.score <= 1 for r in rows)
    odd = {r.doc_id: r for r in language_id.identify(docs, net).collect() if r.doc_id is not None}
    assert [odd[i].lang_pred for i in (4, 5, 6, 12)] == ["und"] * 4
    assert odd[7] == odd[8].__class__(**{**odd[8].asDict(), "doc_id": 7})
    assert language_id.identify(empty, net).count() == 0
    assert language_id.train(empty) is None
    assert language_id.identify(docs, None).first().lang_pred == "und"


def test_lookup_equals_convolution(net):
    rng = np.random.default_rng(1)
    body = rng.integers(0, 256, 1000).astype(np.uint8).tobytes()
    rows = language_id.windows(body)
    assert rows[:, : language_id.WINDOW].reshape(-1)[:1000].tobytes() == body  # every byte is in a window
    direct, _ = net._forward(rows)
    weight = np.array([256, 256, 256, 232.0])
    assert np.allclose(net.probabilities([body])[0], (direct * weight[:, None]).sum(0) / weight.sum(), atol=1e-5)


def test_batches_change_nothing(net):
    """Texts alone and side by side, in any order, give the same figures."""
    rng = np.random.default_rng(4)
    bodies = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (1, 3, 255, 256, 257, 5000, 20, 700)] * 9
    alone = [net.predict([b])[0] for b in bodies]
    assert net.predict(bodies) == alone and net.predict(bodies[::-1]) == alone[::-1]


def test_language_sample(spark):
    """Many languages, short texts, and a language that is nearly one text: each has its class and its own sample."""
    rows = [("sh", "na so"), ("sh", "so na"), *[("cp", "one text again and again")] * 3000, *[("cp", f"other words {i}") for i in range(40)]]
    rows += [(f"l{i}", f"{chr(0x3041 + i % 80)}{i} abc") for i in range(60)] + [(None, "nothing"), ("xx", None), ("yy", "")]
    some = spark.createDataFrame(rows, "lang string, text string")
    assert language_id.train(some, 30).classes == sorted({"sh", "cp", *(f"l{i}" for i in range(60))})


def test_held_out_accuracy(spark):
    """The query on the driver's table: what it never learned from."""
    import os

    from textloom.llm.registry import op1_byte_cnn

    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("the driver's tables aren't there")
    got = op1_byte_cnn(spark, path).join(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = got.where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) >= 0.97


def test_gradients():
    net = language_id.ByteNet(["a", "b"], seed=3)
    rng = np.random.default_rng(2)
    net.p["out"] = rng.normal(size=net.p["out"].shape).astype(np.float32)
    x, y = rng.integers(97, 110, (4, 40)).astype(np.uint8), np.array([0, 1, 1, 0])
    loss = lambda: float(-np.log(net._forward(x)[0][np.arange(4), y]).mean())
    g = net._gradients(x, y)
    for name in ("out", "conv3", "embed", "bias2"):
        where = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        kept, step = net.p[name][where], 1e-2
        net.p[name][where] = kept + step
        up = loss()
        net.p[name][where] = kept - step
        down = loss()
        net.p[name][where] = kept
        assert abs((up - down) / (2 * step) - g[name][where]) < 0.05 * abs(g[name][where]) + 1e-3


def test_toxicity(labelled, docs, empty):
    lexicon = toxicity.learn(labelled, labelled.select("doc_id", "toxic").where(~toxicity.held_out()))
    assert any(w.startswith("scou") for w in lexicon.weights) and not any(w in lexicon.weights for w in ("the", "der"))
    rows = toxicity.toxicity(labelled, lexicon).collect()
    assert all(r.predicted == r.toxic for r in rows)
    got = toxicity.toxicity(docs, lexicon)
    assert got.columns == [*docs.columns, "predicted"] and got.where("score is null").count() == 0
    assert toxicity.drop_toxic_rows(docs, lexicon).where("score = 'x'").count() == docs.count()
    assert toxicity.toxicity(empty, lexicon).count() == 0
    none = toxicity.learn(docs, labelled.select("doc_id", "toxic").where("false"))
    assert not none.weights and toxicity.toxicity(docs, none).where("predicted = 1").count() == 0


def test_lexicon():
    lexicon = toxicity.Lexicon({"trash": 4.0, "idio*": 5.0}, intercept=-3.0, slope=2.0)
    assert lexicon.signal("take out the trash") > 0 == lexicon.signal("the trash can is full") == lexicon.signal("thrashing")
    for text in ("you 1d10t", "уоu іdіоt", "IDIOTIC", "an id​iot"):  # digits, Cyrillic, case, an invisible character
        assert lexicon.signal(text) > 0, text
    assert lexicon.signal("periidiot") == 0  # not at a word's beginning
    assert lexicon.signal("trash " + "word " * 400) < lexicon.signal("trash") and lexicon.score(None) == lexicon.score("")
    assert toxicity.ratio(5, 0, 10, 90) == pytest.approx(2 * (5 * np.log(10)) + 2 * (5 * np.log(5 * 100 / (10 * 95)) + 90 * np.log(100 / 95)))


def test_mixing(labelled, docs, empty):
    targets = labelled.select("doc_id", F.col("lang").alias("domain"))
    got = domain_mixing.mix(labelled, targets, {"en": 0.5, "de": 0.3, "fr": 0.2})
    rows = got.join(labelled.select("doc_id", "lang"), "doc_id").collect()
    total = sum(r.tokens for r in rows)
    share = {d: sum(r.rate * r.tokens for r in rows if r.lang == d) / total for d in ("en", "de", "fr")}
    assert all(r.domain == r.lang for r in rows)
    assert share == pytest.approx({"en": 0.5, "de": 0.3, "fr": 0.2}, abs=0.03)
    assert all(int(r.rate) <= r.copies <= int(r.rate) + 1 for r in rows)
    kept = domain_mixing.mixed_documents(docs, docs.select("doc_id", F.col("lang").alias("domain")), least=1.0)
    assert kept.columns == docs.columns and kept.count() >= docs.count()
    assert kept.select("doc_id", "text").distinct().count() == docs.select("doc_id", "text").distinct().count()
    assert domain_mixing.mix(empty, targets).count() == 0
    assert {r.domain for r in domain_mixing.mix(docs, targets.where("false")).collect()} == {"none"}


def test_rates_meet_targets_or_bounds(spark):
    rng = random.Random(1)
    rows = [(i, 10 + i % 50, *(lambda p: (p, 1 - p))(rng.random())) for i in range(300)]
    members = cut(spark.createDataFrame(rows, "doc_id long, tokens long, p0 double, p1 double"))
    total = sum(r[1] for r in rows)
    rated, expected = domain_mixing.fit_rates(members, [0.55 * total, 0.45 * total])
    assert expected == pytest.approx([0.55 * total, 0.45 * total], rel=1e-4)
    assert rated.where("rate < 0").count() == 0
    rated, _ = domain_mixing.fit_rates(members, [5.0 * total, 0.0], 0.5, 2.0)
    assert rated.where("rate < 0.5 or rate > 2.0").count() == 0


def solved(p, tokens, targets, least, most):
    """The constrained least squares by a long plain projected gradient over documents, dense."""
    total = tokens.sum()
    gram = (p * tokens[:, None]).T @ p / total
    weigh, rate = np.linalg.inv(gram + 1e-12 * np.eye(len(targets))), np.clip(np.ones(len(p)), least, most)
    for _ in range(20_000):
        gap = ((rate * tokens) @ p - targets) / total
        rate = np.clip(rate - p @ (weigh @ gap), least, most)
    gap = ((rate * tokens) @ p - targets) / total
    return gap @ weigh @ gap, (rate * tokens) @ p


@pytest.mark.parametrize("shares,least,most", [((0.5, 0.3, 0.2), 0.0, 8.0), ((0.8, 0.19, 0.01), 0.0, 2.0), ((0.1, 0.1, 0.8), 1.0, 3.0), ((0.0, 0.0, 1.0), 0.2, 1.2)])
def test_rates_are_those_of_a_dense_solver(spark, shares, least, most):
    """Reachable targets are met; of others the fit is as near as any, up to the grid's cells."""
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.4, 0.6, 0.2], 500)
    tokens = rng.integers(0, 400, 500).astype(float)
    targets = np.array(shares) * tokens.sum()
    members = cut(spark.createDataFrame([(i, int(t), *map(float, x)) for i, (t, x) in enumerate(zip(tokens, p, strict=True))], "doc_id long, tokens long, p0 double, p1 double, p2 double"))
    rated, expected = domain_mixing.fit_rates(members, targets.tolist(), least, most)
    rows = rated.collect()
    assert len(rows) == 500 and all(least <= r.rate <= most for r in rows)
    sums = np.array([sum(r.rate * r.tokens * r[f"p{i}"] for r in rows) for i in range(3)])
    assert sums == pytest.approx(expected, rel=1e-9, abs=1e-6)
    best, near = solved(p, tokens, targets, least, most)
    gap = (sums - targets) / tokens.sum()
    weigh = np.linalg.inv((p * tokens[:, None]).T @ p / tokens.sum())
    assert gap @ weigh @ gap <= best * 1.01 + 1e-9
    assert np.abs(sums - near).max() <= 0.005 * tokens.sum()


def test_posteriors_are_naive_bayes(spark, labelled):
    """Against the same formulas in plain Python."""
    targets = labelled.where("doc_id % 3 <> 1").select("doc_id", F.col("lang").alias("domain")).unionByName(labelled.where("doc_id = 1").select("doc_id", F.lit("a`__bucket").alias("domain")))
    domains, table, priors = domain_mixing.fit_domains(labelled, targets)
    assert domains == ["a`__bucket", "en", "fr"]
    texts = {r.doc_id: r.text.lower() for r in labelled.select("doc_id", "text").collect()}
    words = labelled.select(F.explode(F.split(F.lower("text"), " ")).alias("w")).select("w", domain_mixing._bucket(F.col("w")).alias("b")).distinct().collect()
    bucket = {r.w: r.b for r in words}
    label = {r.doc_id: r.domain for r in targets.collect()}
    counts = {d: {} for d in domains}
    for i, d in label.items():
        for w in texts[i].split():
            counts[d][bucket[w]] = counts[d].get(bucket[w], 0) + 1
    log = lambda d, b: np.log((counts[d].get(b, 0) + 0.5) / (sum(counts[d].values()) + 0.5 * domain_mixing.BUCKETS))
    got = {r.doc_id: r for r in domain_mixing.posteriors(labelled, table, priors).collect()}
    for i in sorted(texts)[:60]:
        ws = texts[i].split()
        z = np.array([np.log(sum(x == d for x in label.values()) / len(label)) + domain_mixing.TEMPER / np.sqrt(len(ws)) * sum(log(d, bucket[w]) for w in ws) for d in domains])
        q = np.exp(z - z.max())
        assert [got[i].p0, got[i].p1, got[i].p2] == pytest.approx(list(q / q.sum()), abs=1e-6) and got[i].tokens == len(ws)


def test_many_domains_and_unmet_shares(spark, labelled):
    """No domain is left out, whatever their number; shares out of reach are reported."""
    many = labelled.select("doc_id", F.concat(F.lit("d"), F.col("doc_id") % 80).alias("domain"))
    domains, _, priors = domain_mixing.fit_domains(labelled, many)
    assert len(domains) == len(priors) == 80
    targets = labelled.select("doc_id", F.col("lang").alias("domain"))
    with pytest.warns(UserWarning, match="keep these shares"):
        rows = domain_mixing.mix(labelled, targets, {"en": 0.98, "de": 0.01, "fr": 0.01}, least=0.9, most=1.5).collect()
    assert {r.domain: round(r.target_share, 2) for r in rows} == {"en": 0.98, "de": 0.01, "fr": 0.01}
    total = sum(r.rate * r.tokens for r in rows)
    assert all(abs(r.reached_share - sum(x.rate * x.tokens for x in rows if x.domain == r.domain) / total) < 0.02 for r in rows[:9])
    with pytest.warns(UserWarning, match="no labelled rows"):
        rows = domain_mixing.mix(labelled, targets, {"en": 0.5, "de": 0.3, "fr": 0.2, "xx": 0.5}, budget=None).collect()
    assert len(rows) == labelled.count() and all(r.target_share == pytest.approx(r.reached_share, abs=0.005) for r in rows)


def test_checkpoints_need_a_shared_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from textloom.llm.common import shared_folder

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError):
        shared_folder(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None)))
    assert shared_folder(spark)


def test_stages_with_odd_tables(spark, tmp_path):
    """Empty tables, null and empty texts, repeated and null doc_ids, columns named like the operators' own."""
    pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long, __uid string, score string, kept string, rate string, tokens string, domain string"
    rows = [(i, t, "en", "s", 1, *"abcdef") for i, t in [(1, None), (2, ""), (2, ""), (3, "one two three four five six"), (3, "one two three four five six"), (None, None), (None, "seven eight nine"), (4, "word " * 50_000)]]
    spark.createDataFrame([(3, 1, 0), (4, 0, 0), (9, 1, 1), (None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, some in (("odd", rows), ("empty", [])):
        path = f"{tmp_path}/{name}"
        spark.createDataFrame(some, schema).repartition(2).write.parquet(path)
        docs = spark.read.parquet(path)
        for stage, function in pipeline.STAGES:
            out = function(spark, docs, str(tmp_path))
            assert out.columns == (docs.columns if stage != "byte-level BPE" else ["doc_id", "n_tokens", "ids", "decoded_sha256"]), stage
            got = out.collect()
            assert bool(got) == bool(some), stage
            if some:
                assert {1, 2, 3, 4} <= {r.doc_id for r in got} or stage == "exact dedup", stage


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    base = [(i, " ".join(f"w{rng.randint(0, 400)}" for _ in range(60))) for i in range(60)]
    rows = base + [(100 + i, t.upper()) for i, t in base[:5]] + [(200 + i, t + " end") for i, t in base[5:10]] + [(300 + i, t + " scoundrel") for i, t in base[:40:2]]
    rows = [(i, t, "en", "s", len(t)) for i, t in rows]
    labels = [(i, int(i % 4 > 0), int(300 <= i)) for i, *_ in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in got}
    assert not any(i >= 300 for i in ids)  # toxic ones go
    assert all((i in ids) != (100 + i in ids) for i in range(5))  # of equal texts one stays
    assert all(i in ids and 200 + i not in ids for i in range(5, 10))  # of near copies the first
    assert set(range(10, 60)) <= ids  # clean ones stay
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "exact dedup", "near-dedup", "mixing", "byte-level BPE"]


def test_lexicon_reads_any_length_and_white_space():
    import time

    lexicon = toxicity.Lexicon({"trash": 4.0, "idio*": 5.0})
    start = time.monotonic()
    assert lexicon.signal("trash can " * 1_000_000) == 0.0  # 10 MB of exception phrases
    one = lexicon.signal("trash can " * 500_000 + "idiot")
    assert one == pytest.approx(5.0 / np.sqrt(1_000_001)) and time.monotonic() - start < 60
    words = "you idiot take this trash away now".split()
    assert len({lexicon.signal(gap.join(words)) for gap in (" ", "\n", "\t", "  \n ", " . ")}) == 1
    covered = toxicity.Lexicon({"trash": 4.0, "can": 2.0}, exceptions=("trash can", "can opener", "trash"))
    assert covered.signal("trash can opener") == 0 and covered.signal("can trash can") == pytest.approx(2 / np.sqrt(3))


def test_exceptions_are_learned(spark, tmp_path):
    """A word that is an insult alone, but not in one phrase; repeated, null and very long texts."""
    rng = random.Random(8)
    stock = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(600):
        words = [rng.choice(stock) for _ in range(30)]
        if i % 6 == 0:
            words.insert(rng.randint(0, 30), "weasel")
        elif i % 6 == 1:
            words[9:11] = ["Weasel", "coffee"]
        rows.append((i, " ".join(words), int(i % 6 == 0)))
    rows += [(600, None, 0), (601, "", 0), (602, "weasel coffee " * 200_000, 0), (0, rows[0][1], 1)]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string, toxic int").write.parquet(path)
    table = spark.read.parquet(path)
    lexicon = toxicity.learn(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    assert "weasel" in lexicon.weights and "weasel coffee" in lexicon.exceptions
    got = toxicity.toxicity(table, lexicon).collect()
    assert len(got) == len(rows) and np.mean([r.predicted == r.toxic for r in got]) >= 0.99
    assert len({(r.score, r.predicted) for r in got if r.doc_id == 0}) == 1
