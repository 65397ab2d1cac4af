"""MinHash near-duplicates with sequential Bayesian verification.

Signatures are cut into bands; rows that agree in a band are candidates. Candidates' signatures are compared batch by
batch, and a pair goes as soon as the posterior probability that its similarity reaches the threshold, given the
agreements so far and a uniform prior, is below the chosen miss probability. What survives is confirmed on full
shingle sets. Connected components of the confirmed links are the groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import bounded_batches, cut, hot_join, text_bytes, unused
from textloom.llm.components import components

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
ROLL = np.uint64(0x9E3779B97F4A7C15)
#: Distinct words whose hashes a worker holds at most before it starts anew.
WORDS_HELD = 400_000
#: Rows of a bucket that are compared with as many others in one go, at least and at most: a sixteenth of the bucket
#: between these. Larger buckets are dealt out by pairs of sides.
LEAST_SIDE, MOST_SIDE = 512, 1024


@dataclass(frozen=True)
class Plan:
    """Words a shingle, threshold in percent, rows a band, bands, hashes compared at once, miss probability of pruning.

    7 rows and 32 bands miss a pair at 85 % with probability 4e-6, 7 and 48 one at 80 % with 1.3e-5; less above.
    """

    words: int = 5
    percent: int = 80
    rows: int = 7
    bands: int = 48
    batch: int = 32
    miss: float = 1e-7

    @property
    def hashes(self) -> int:
        return self.rows * self.bands

    @property
    def signer(self) -> Signer:
        return _signer(self)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct shingles of a text as sorted 64-bit hashes; words are runs of bytes other than ASCII white space, A-Z lower-cased."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def __call__(self, body: bytes) -> np.ndarray:
        return self.of(body.lower().split())  # bytes: exactly A-Z, and exactly space and 9 to 13

    def of(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > WORDS_HELD:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.words, len(h))
        n = len(h) - k + 1
        x = np.full(n, k, np.uint64)
        for o in range(k):
            x = _mix(x * ROLL + h[o : o + n])
        return np.unique(x)


class Signer:
    def __init__(self, plan: Plan):
        rng = np.random.default_rng(20_240)
        self.plan = plan
        self.xor = rng.integers(0, 1 << 32, (plan.hashes, 1), np.uint32)
        self.times = rng.integers(0, 1 << 32, (plan.hashes, 1), np.uint32) | np.uint32(1)
        self.weights = rng.integers(0, 1 << 63, (plan.bands, plan.rows), np.uint64) | np.uint64(1)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """16 bits of each of the smallest hashes; the minimum itself is taken over 32."""
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(self.plan.hashes, 0xFFFFFFFF, np.uint32)
        for s in range(0, len(x), 1024):
            np.minimum(least, ((x[None, s : s + 1024] ^ self.xor) * self.times).min(axis=1), out=least)
        return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)

    def keys(self, signature: np.ndarray) -> np.ndarray:
        """One 64-bit key a band."""
        rows = signature.reshape(self.plan.bands, self.plan.rows).astype(np.uint64) + np.uint64(1)
        return _mix((rows * self.weights).sum(axis=1, dtype=np.uint64) + np.arange(self.plan.bands, dtype=np.uint64) * ROLL).view(np.int64)


@lru_cache
def _signer(plan: Plan) -> Signer:
    return Signer(plan)


@lru_cache
def least_agreements(plan: Plan) -> list[tuple[int, int]]:
    """(hashes compared, agreements that a pair needs to stay): the posterior bound as a table.

    With a uniform prior, m agreements of n make the similarity Beta(m + 1, n - m + 1), which is t or more with the
    probability that a Binomial(n + 1, t) is m at most.
    """
    t, out = plan.percent / 100, []
    for n in range(plan.batch, plan.hashes + 1, plan.batch):
        below, m = 0.0, -1
        while True:
            m += 1
            below += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(t) + (n + 1 - m) * math.log1p(-t))
            if below >= plan.miss:
                break
        out.append((n, m))
    return out


def survivors(a: np.ndarray, b: np.ndarray, plan: Plan) -> np.ndarray:
    """Which pairs of signature rows pass every posterior bound; pruned pairs are not compared further."""
    alive, agreed, at = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for n, least in least_agreements(plan):
        agreed[alive] += (a[alive, at:n] == b[alive, at:n]).sum(axis=1)
        alive, at = alive[agreed[alive] >= least], n
    return alive


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return bool(len(a)) and 100 * both >= percent * (len(a) + len(b) - both)


def _scan(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(plan.words), Signer(plan)
        for b in batches:
            n, same, keys = [], [], []
            for body in b.column(2).to_pylist():
                words = body.lower().split()
                s = shingler.of(words)
                n.append(len(s))
                same.append(xxhash.xxh3_128_digest(b" ".join(words)) if len(s) else None)
                keys.append(signer.keys(signer.signature(s)).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(keys, pa.binary())], names=["uid", "doc", "n", "same", "keys"])

    return run


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        uid, blobs = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
        if blobs:
            keys = np.frombuffer(b"".join(blobs), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(uid, len(keys) // len(uid)))], names=["key", "uid"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key: those that share a key with a neighbour or may do so beyond the partition's ends, with the row before."""
    first = True

    def out(key, uid, before, keep):
        return pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(uid[keep]), pa.array(before[keep], mask=before[keep] < 0)], names=["key", "uid", "prev"])

    last: tuple | None = None  # key, uid, row before, shares a key: the row whose successor isn't known yet
    for b in batches:
        if not b.num_rows:
            continue
        key, uid = b.column(0).to_numpy(), b.column(1).to_numpy()
        if last is not None:
            key, uid = np.concatenate([[last[0]], key]), np.concatenate([[last[1]], uid])
        same = key[1:] == key[:-1]
        before = np.full(len(key), -1, np.int64)
        before[1:][same] = uid[:-1][same]
        shares = np.zeros(len(key), bool)
        shares[1:] |= same
        shares[:-1] |= same
        if last is not None:
            before[0], shares[0] = last[2], shares[0] | last[3]
        elif first:
            shares[0] = True
        first = False
        last = (key[-1], uid[-1], before[-1], shares[-1])
        keep = shares[:-1]
        yield out(key[:-1], uid[:-1], before[:-1], keep)
    if last is not None:
        yield out(np.array([last[0]]), np.array([last[1]]), np.array([last[2]]), np.array([True]))


def _signed(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer, press = Shingler(plan.words), Signer(plan), zstandard.ZstdCompressor(level=3)
        for b in batches:
            sigs, bodies = [], []
            for body in b.column(1).to_pylist():
                sigs.append(signer.signature(shingler(body)).tobytes())
                bodies.append(press.compress(body))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sigs, pa.binary()), pa.array(bodies, pa.binary())], names=["uid", "sig", "body"])

    return run


def _pruned(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(b.num_rows, -1) for i in (2, 3))
                yield b.select(["a", "b"]).take(pa.array(survivors(x, y, plan)))

    return run


def _confirmed(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, press = Shingler(plan.words), zstandard.ZstdDecompressor()
        known: dict[int, np.ndarray] = {}

        def of(node: int, body: bytes) -> np.ndarray:
            if node not in known:
                if len(known) > 200:
                    known.clear()
                known[node] = shingler(press.decompress(body))
            return known[node]

        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            keep = [i for i, (u, v, x, y) in enumerate(rows) if similar(of(u, x), of(v, y), plan.percent)]
            yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def cross_links(side: np.ndarray, uid: np.ndarray, label: np.ndarray, sig: np.ndarray, shingles, key: int, plan: Plan) -> list[tuple[int, int]]:
    """Links that connect components of one bucket; ``shingles`` gives a row's set.

    Every pair of different components that shares this bucket and no earlier one is compared by signature batches.
    Those that survive are confirmed on full sets, the likeliest first, unless links found meanwhile connect them.
    With two sides, only pairs across them are meant.
    """
    signer = plan.signer
    if len({*side.tolist()}) == 2:
        first, second = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
    else:
        first = second = np.arange(len(uid))
    left, right, agreed = [], [], []
    for i in first:
        js = second[(label[second] != label[i])]
        if first is second:
            js = js[js > i]
        if len(js):
            js = js[survivors(np.broadcast_to(sig[i], (len(js), sig.shape[1])), sig[js], plan)]
            left += [i] * len(js)
            right += js.tolist()
            agreed += (sig[js] == sig[i]).sum(axis=1).tolist()
    keys: dict[int, np.ndarray] = {}
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    def key_of(i: int) -> np.ndarray:
        if i not in keys:
            keys[i] = signer.keys(sig[i])
        return keys[i]

    out = []
    for n in np.argsort(-np.array(agreed), kind="stable"):
        i, j = left[n], right[n]
        a, b = find(int(label[i])), find(int(label[j]))
        if a == b:
            continue
        common = key_of(i)[key_of(i) == key_of(j)]
        if len(common) and common[0] == key and similar(shingles(i), shingles(j), plan.percent):
            parent[max(a, b)] = min(a, b)
            out.append((int(uid[i]), int(uid[j])))
    return out


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each (key, x, y), which stand together."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and held[0][:3] != row[:3]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def open_rows(side: np.ndarray, label: np.ndarray, sig: np.ndarray, key: int, plan: Plan) -> np.ndarray:
    """Rows of one bucket that pass the bounds with a row of another component that shares no earlier bucket with them."""
    signer, two = plan.signer, len({*side.tolist()}) == 2
    first = np.flatnonzero(side == side.min()) if two else np.arange(len(side))
    second = np.flatnonzero(side == side.max()) if two else first
    found = np.zeros(len(side), bool)
    keys: dict[int, np.ndarray] = {}

    def key_of(i: int) -> np.ndarray:
        if i not in keys:
            keys[i] = signer.keys(sig[i])
        return keys[i]

    for i in first:
        js = second[label[second] != label[i]]
        if not two:
            js = js[js > i]
        if len(js):
            for j in js[survivors(np.broadcast_to(sig[i], (len(js), sig.shape[1])), sig[js], plan)].tolist():
                if not (found[i] and found[j]):
                    common = key_of(i)[key_of(i) == key_of(j)]
                    if len(common) and common[0] == key:
                        found[i] = found[j] = True
    return np.flatnonzero(found)


def _opened(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _cells(batches):  # key, x, y, side, uid, label, sig
            side, label = (np.array([r[k] for r in rows], np.int64) for k in (3, 5))
            sig = np.frombuffer(b"".join(r[6] for r in rows), np.uint16).reshape(len(rows), -1)
            keep = [rows[i] for i in open_rows(side, label, sig, rows[0][0], plan)]
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in keep], t) for k, t in ((0, pa.int64()), (1, pa.int32()), (2, pa.int32()), (3, pa.int32()), (4, pa.int64()), (5, pa.int64()))], names=["key", "x", "y", "side", "uid", "label"])

    return run


def _across(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, press = Shingler(plan.words), zstandard.ZstdDecompressor()

        def links(rows: list[tuple]) -> pa.RecordBatch:
            known: dict[int, np.ndarray] = {}

            def shingles(i: int) -> np.ndarray:
                if i not in known:
                    known[i] = shingler(press.decompress(rows[i][7]))
                return known[i]

            columns = [np.array([r[k] for r in rows], np.int64) for k in (3, 4, 5)]
            sig = np.frombuffer(b"".join(r[6] for r in rows), np.uint16).reshape(len(rows), -1)
            found = cross_links(*columns, sig, shingles, rows[0][0], plan)
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        yield from map(links, _cells(batches))

    return run


def _check(pairs: DataFrame, nodes: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (a, b) that pass the bounds and then the exact comparison."""
    ends = lambda p, what: p.join(nodes.select(F.col("uid").alias("a"), F.col(what).alias("x")), "a").join(nodes.select(F.col("uid").alias("b"), F.col(what).alias("y")), "b").select("a", "b", "x", "y")
    alive = cut(ends(pairs, "sig").mapInArrow(_pruned(plan), "a long, b long"))
    return cut(ends(alive, "body").mapInArrow(_confirmed(plan), "a long, b long"))


def _grouped(numbered: DataFrame, plan: Plan) -> DataFrame:
    """uid, doc, n, first_uid, first_doc of each row: the number and doc_id of its group's first row."""
    spark = numbered.sparkSession
    bounded_batches(spark)
    rows = numbered.select(F.col("__uid").alias("uid"), F.col("doc_id").cast("long").alias("doc"), text_bytes().alias("body"))
    scanned = cut(rows.mapInArrow(_scan(plan), "uid long, doc long, n long, same binary, keys binary"))
    total = scanned.count()
    # Copies of a word sequence have one shingle set: the first of them, by doc_id with nulls last, stands for all.
    order = F.struct(F.col("doc").isNull(), "doc", "uid")
    firsts = scanned.where("same is not null").groupBy("same").agg(F.min_by(F.struct("uid", "doc", "keys"), order).alias("r"), F.count("*").alias("copies"))
    firsts = cut(firsts.select("same", "copies", "r.*"))
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    bands = firsts.select("uid", "keys").mapInArrow(_banded, "key long, uid long")
    shared = cut(bands.repartitionByRange(width, "key", "uid").sortWithinPartitions("key", "uid").mapInArrow(_runs, "key long, uid long, prev long"))
    wanted = shared.select("uid").distinct().withColumnRenamed("uid", "__node")
    nodes = cut(rows.join(wanted, F.col("uid") == F.col("__node"), "left_semi").select("uid", "body").mapInArrow(_signed(plan), "uid long, sig binary, body binary"))
    # Each row against the one before it in each bucket: that connects nearly all there is to connect.
    near = shared.where("prev is not null").select(F.col("prev").alias("a"), F.col("uid").alias("b")).distinct()
    links = _check(near, nodes, plan)
    labels = components(links)
    # The rest exactly: buckets that still hold several components are searched for links across them.
    labelled = cut(shared.select("key", "uid").join(labels.withColumnRenamed("node", "uid"), "uid", "left").select("key", "uid", F.coalesce("label", "uid").alias("label")))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("rows")).where("lo <> hi")
    side_rows = F.least(F.lit(MOST_SIDE), F.greatest(F.lit(LEAST_SIDE), F.col("rows") / 16))
    mixed = mixed.select("key", F.ceil(F.col("rows") / side_rows).cast("int").alias("sides"))
    rows_open = labelled.join(mixed, "key").withColumn("side", F.pmod(F.xxhash64("uid"), F.col("sides")).cast("int"))
    rows_open = rows_open.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    rows_open = rows_open.select("key", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side", "uid", "label")
    # Signatures alone go round first; texts only follow for rows that some signature of another component lets pass.
    # Dealt by range, tasks have about the same rows and each cell is in one task; the cut spares a second join for the ranges.
    rows_open = rows_open.join(nodes.select("uid", "sig"), "uid").select("key", "x", "y", "side", "uid", "label", "sig")
    rows_open = cut(rows_open).repartitionByRange("key", "x", "y").sortWithinPartitions("key", "x", "y")
    rows_open = cut(rows_open.mapInArrow(_opened(plan), "key long, x int, y int, side int, uid long, label long"))
    rows_open = cut(rows_open.join(nodes, "uid").select("key", "x", "y", "side", "uid", "label", "sig", "body"))
    rows_open = rows_open.repartitionByRange("key", "x", "y").sortWithinPartitions("key", "x", "y")
    more = cut(rows_open.mapInArrow(_across(plan), "a long, b long"))
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    found = cut(firsts.join(labels, firsts["uid"] == labels["node"], "left").select("same", "copies", "uid", "doc", F.coalesce("label", "uid").alias("label")))
    best = found.groupBy("label").agg(F.min_by(F.struct(F.col("uid").alias("first_uid"), F.col("doc").alias("first_doc")), order).alias("f"), F.count("*").alias("size")).select("label", "size", "f.*")
    found = hot_join(found, best, "label", "size", total, F.xxhash64("uid")).select("same", "copies", "first_uid", "first_doc")
    out = hot_join(scanned.select("uid", "doc", "n", "same"), found, "same", "copies", total, F.xxhash64("uid"))
    return out.select("uid", "doc", "n", F.when(F.col("same").isNull(), F.col("uid")).otherwise(F.col("first_uid")).alias("first_uid"), F.when(F.col("same").isNull(), F.col("doc")).otherwise(F.col("first_doc")).alias("first_doc"))


def near_duplicates(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Null, empty and blank texts have no shingles and are linked with nothing; a text shorter than a shingle is one
    shingle. component_id is the smallest doc_id of the component (null if it has none), and the rows with that doc_id
    are kept: all of them, if it is repeated. Of a component without any doc_id the first row by place is kept.
    ``docs`` must be repeatable (files or a checkpoint): rows are known
    by their place in it. Other columns don't matter; an empty table gives an empty result.
    """
    g = _grouped(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("__uid")), plan)
    kept = F.when(F.col("first_doc").isNull(), F.col("uid") == F.col("first_uid")).otherwise(F.coalesce(F.col("doc") == F.col("first_doc"), F.lit(False)))
    return g.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("first_doc").alias("component_id"), kept.alias("kept"))


def drop_near_copies(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: one of each component of ``near_duplicates``.

    It is the first by doc_id with nulls last, then by place; rows without shingles all stay.
    """
    uid, kept = unused(docs, "uid"), unused(docs, "kept")
    numbered = docs.withColumn(uid, F.monotonically_increasing_id())
    first = cut(_grouped(numbered.select("doc_id", "text", F.col(uid).alias("__uid")), plan).where("uid = first_uid").select(F.col("uid").alias(kept)))
    return numbered.join(first, F.col(uid) == F.col(kept), "left_semi").drop(uid)
