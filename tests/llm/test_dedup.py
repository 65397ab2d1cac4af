"""Exact and near-duplicate removal against brute force, with awkward rows."""

import hashlib
import random
import re

import numpy as np
import pytest

from textloom.llm import grace_dedup, minhash_bayes
from textloom.llm.components import components

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def test_grace_spills_and_recurses():
    rng = random.Random(1)
    contents = [f"{rng.randint(0, 300)}".encode() * 50 for _ in range(3000)]
    records = [(hashlib.sha256(c).digest(), c, (i,)) for i, c in enumerate(contents)]
    groups = {c: sorted(m[0] for m in ms) for _, c, ms in grace_dedup.grace_groups(iter(records), budget=20_000)}
    expected = {}
    for i, c in enumerate(contents):
        expected.setdefault(c, []).append(i)
    assert groups == expected


def test_grace_compares_contents():
    digest = b"\1" * 32  # one digest for all: the contents must decide, at any depth
    records = [(digest, f"{i % 7}".encode() * 100, (i,)) for i in range(70)]
    groups = list(grace_dedup.grace_groups(iter(records), budget=200))
    assert len(groups) == 7 and all(len(g[2]) == 10 for g in groups)


def test_exact(docs, empty):
    got = grace_dedup.grace_dedup(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    groups = {}
    for r in rows:
        groups.setdefault((r.text or "").translate(LOWER), []).append(r.doc_id)
    for r in got:
        ids = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)
    kept = grace_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert {r.score for r in kept.collect()} == {"x"}
    assert grace_dedup.grace_dedup(empty).count() == 0 and grace_dedup.drop_exact_copies(empty).count() == 0


def brute(rows, k, percent):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets = []
    for _, t in rows:
        w = word.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    comp = {}
    for i, (d, _) in enumerate(rows):
        comp.setdefault(find(i), []).append(d)
    return sets, [min((d for d in comp[find(i)] if d is not None), default=None) for i in range(len(rows))]


def variants():
    """Copies with a few words changed, so that similarities lie on both sides of the thresholds, in chains."""
    rng = random.Random(5)
    rows = []
    for g in range(12):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(20, 200))]
        for _ in range(12):
            words = [f"v{rng.randint(0, 5000)}" if rng.random() < 0.006 * (g % 5) else w for w in words]
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("plan", [minhash_bayes.Plan(3, 85, 7, 32), minhash_bayes.Plan()])
def test_near(spark, tmp_path, docs, plan):
    rows = variants() + [(1000 + (r.doc_id or 0), r.text) for r in docs.collect()]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(path)
    table = spark.read.parquet(path)
    sets, expected = brute(rows, plan.words, plan.percent)
    got = sorted(table.join(minhash_bayes.near_duplicates(table, plan).withColumnRenamed("doc_id", "d"), table.doc_id.eqNullSafe(minhash_bayes.F.col("d"))).select("doc_id", "text", "n_shingles", "component_id").distinct().collect())
    want = sorted({(d, t, len(s), c) for (d, t), s, c in zip(rows, sets, expected, strict=True)}, key=lambda r: (r[0], r[1] or ""))
    assert sorted({(r.doc_id, r.n_shingles, r.component_id) for r in got}) == sorted({(d, n, c) for d, _, n, c in want})


def unlinked():
    """Groups that share buckets though few of their rows are linked: a common half, own words, some copies with small changes."""
    rng = random.Random(6)
    rows = []
    for g in range(3):
        common = [f"c{g}x{i}" for i in range(160)]
        for i in range(70):
            own = [f"o{g}y{rng.randint(0, 9)}z{j}" for j in range(20)]
            rows.append(" ".join(common + own))
            if i % 6 == 0:
                rows.append(" ".join(common + own + ["end", "of", "it"]))
    return rows


@pytest.mark.parametrize("sides", [(4, 8), (128, 1024)])
def test_mixed_buckets_by_brute_force(spark, tmp_path, monkeypatch, sides):
    """Also with sides of a few rows, repeated and null doc_ids, and a column named like an own one."""
    monkeypatch.setattr(minhash_bayes, "LEAST_SIDE", sides[0])
    monkeypatch.setattr(minhash_bayes, "MOST_SIDE", sides[1])
    plan = minhash_bayes.Plan(3, 85, 7, 32)
    rows = [(None if i % 41 == 7 else i // 2 if i % 30 < 4 else 1000 + i, t) for i, t in enumerate(unlinked())]
    path = str(tmp_path / "d")
    spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, __uid string").repartition(5).write.parquet(path)
    table = spark.read.parquet(path)
    sets, expected = brute(rows, 3, 85)
    got = sorted((r.doc_id or -1, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in minhash_bayes.near_duplicates(table, plan).collect())
    assert got == sorted((d or -1, len(s), -1 if c is None else c) for (d, _), s, c in zip(rows, sets, expected, strict=True))
    kept = minhash_bayes.drop_near_copies(table, plan)
    assert kept.columns == ["doc_id", "text", "__uid"] and len({c for c in expected if c is not None}) <= kept.count() < len(rows)


def test_exact_repeats_equal_the_sql(spark, tmp_path):
    """Repeated and null doc_ids: one row of each group is kept, in the operator and in its SQL."""
    import duckdb

    from textloom.llm.registry import OP3_SQL

    rows = [(5, "A b"), (5, "a b"), (5, "a B"), (3, "a b"), (None, "a b"), (None, "z"), (None, "Z"), (1, None), (1, ""), (2, "É"), (2, "é")]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(d, t, "y") for d, t in rows], "doc_id long, text string, __uid string").coalesce(1).write.parquet(path)
    got = grace_dedup.grace_dedup(spark.read.parquet(path)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{path}/*.parquet'")
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, db.sql(OP3_SQL).fetchall()))
    assert grace_dedup.drop_exact_copies(spark.read.parquet(path)).count() == sum(r.kept for r in got)


def test_near_awkward(docs, empty):
    plan = minhash_bayes.Plan(3, 85, 7, 32)
    got = minhash_bayes.near_duplicates(docs, plan).collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert {by_id[i].component_id for i in (1, 2, 3)} == {1} and {by_id[i].component_id for i in (9, 10)} == {9}
    assert [by_id[i].component_id for i in (4, 5, 6)] == [4, 5, 6] and by_id[4].n_shingles == 0
    assert [r.kept for r in got if r.doc_id == 11] == [True, True]  # kept says that doc_id is the component's
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None) and [r.kept for r in got if r.doc_id is None] == [True]
    kept = minhash_bayes.drop_near_copies(docs, plan)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == sorted({r.doc_id or 0 for r in got if r.kept})  # one row of each
    assert minhash_bayes.near_duplicates(empty, plan).count() == 0


def test_bounds():
    plan = minhash_bayes.Plan(3, 85, 7, 32)
    table = minhash_bayes.least_agreements(plan)
    assert [n for n, _ in table] == list(range(32, 225, 32)) and all(m <= 0.85 * n for n, m in table)
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, (200, plan.hashes)).astype(np.uint16)
    b = a.copy()
    b[:100] = rng.integers(0, 1 << 16, (100, plan.hashes))
    b[100:, ::12] = a[100:, ::12] + 1
    assert minhash_bayes.survivors(a, b, plan).tolist() == list(range(100, 200))


def test_cross_links_with_sides():
    plan = minhash_bayes.Plan(3, 85, 7, 32)
    signer, shingler = plan.signer, minhash_bayes.Shingler(3)
    texts = [b"a b c d e f g h i j k l m n o p q r s t u v w x y z", b"a b c d e f g h i j k l m n o p q r s t u v w x y z1", b"other words than those before in this one"]
    sets = [shingler(t) for t in texts]
    sig = np.stack([signer.signature(s) for s in sets])
    keys = [signer.keys(s) for s in sig]
    common = keys[0][keys[0] == keys[1]][0]
    for side in ([0, 1, 1], [0, 0, 0]):
        found = minhash_bayes.cross_links(np.array(side), np.arange(3), np.arange(3), sig, sets.__getitem__, int(common), plan)
        assert found == [(0, 1)]


def test_components(spark, monkeypatch):
    import textloom.llm.components as module

    monkeypatch.setattr(module, "LINKS_A_TASK", 7)  # many tasks and rounds
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(60) if i % 20] + [(rng.randint(100, 140), rng.randint(100, 140)) for _ in range(40)] + [(500, 500)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert set(got) == set(parent)
    groups = {}
    for x in parent:
        groups.setdefault(find(x), set()).add(got[x])
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
