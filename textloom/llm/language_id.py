"""Language identification by a byte convolutional network, trained and applied in numpy.

Bytes are embedded, filters of several widths run over fixed-length windows, each filter's largest response in a
window is kept, and a softmax layer gives the window's languages. A text's score is the mean over all its windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import bounded_batches, cut, text_bytes

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 10
EMBED = 8
#: Training windows a language at most.
FIT_WINDOWS = 1500
EPOCHS, BATCH, RATE = 12, 64, 0.004
#: Windows of the forward pass at once; bounds a worker's memory whatever the text's length.
BLOCK = 48
#: Languages up to which their counts are broadcast.
BROADCAST_LANGUAGES = 10_000
LETTER = regex.compile(r"\p{L}")


def windows(body: bytes) -> np.ndarray:
    """All of ``body`` in rows of ``WINDOW`` bytes plus the overlap that the widest filter needs; the last is filled with spaces."""
    over = max(WIDTHS) - 1
    rows = max(1, -(-len(body) // WINDOW))
    x = np.full(rows * WINDOW + over, 32, np.uint8)
    x[: len(body)] = np.frombuffer(body, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(x, WINDOW + over)[::WINDOW]


class ByteNet:
    """Embedding, filters of the widths, max pooling, softmax."""

    def __init__(self, classes: list[str], seed: int = 1):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.p = {"embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"conv{w}"] = rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)).astype(np.float32)
            self.p[f"bias{w}"] = np.zeros(FILTERS, np.float32)
        self.p["out"] = np.zeros((FILTERS * len(WIDTHS), len(classes)), np.float32)
        self.p["out_bias"] = np.zeros(len(classes), np.float32)
        self._tables = None

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}

    # training

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        e = self.p["embed"][x]
        kept, pooled = [], []
        for w in WIDTHS:
            n = x.shape[1] - max(WIDTHS) + 1
            cols = np.concatenate([e[:, o : o + n] for o in range(w)], axis=2)
            z = cols @ self.p[f"conv{w}"]
            at = z.argmax(axis=1)
            top = np.take_along_axis(z, at[:, None], 1)[:, 0] + self.p[f"bias{w}"]
            kept.append((w, cols, at, top))
            pooled.append(np.maximum(top, 0))
        h = np.concatenate(pooled, axis=1)
        logits = h @ self.p["out"] + self.p["out_bias"]
        logits -= logits.max(axis=1, keepdims=True)
        q = np.exp(logits)
        return q / q.sum(axis=1, keepdims=True), [h, kept]

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        q, (h, kept) = self._forward(x)
        d = q.copy()
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        g = {"out": h.T @ d, "out_bias": d.sum(0), "embed": np.zeros_like(self.p["embed"])}
        dh = d @ self.p["out"].T
        rows = np.arange(len(x))[:, None]
        for i, (w, cols, at, top) in enumerate(kept):
            dz = dh[:, i * FILTERS : (i + 1) * FILTERS] * (top > 0)
            picked = cols[rows, at]  # window, filter, column
            g[f"conv{w}"] = np.einsum("bf,bfc->cf", dz, picked)
            g[f"bias{w}"] = dz.sum(0)
            back = (dz[:, :, None] * self.p[f"conv{w}"].T[None]).reshape(len(x), FILTERS, w, EMBED)
            for o in range(w):
                np.add.at(g["embed"], x[rows, at + o], back[:, :, o])
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 2) -> ByteNet:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for s in range(0, len(order), BATCH):
                take = order[s : s + BATCH]
                step += 1
                for k, g in self._gradients(x[take], y[take]).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self._tables = None
        return self

    # inference

    def _lookup(self) -> tuple[np.ndarray, np.ndarray]:
        """The filters' responses to byte pairs: at an offset of 0 for all widths, at an offset of 2 for those over 2."""
        if self._tables is None:
            one = {(w, o): self.p["embed"] @ self.p[f"conv{w}"][o * EMBED : (o + 1) * EMBED] for w in WIDTHS for o in range(w)}
            none = np.zeros((256, FILTERS), np.float32)
            pair = lambda w, o: (one.get((w, o), none)[:, None] + one.get((w, o + 1), none)[None]).reshape(65536, FILTERS)
            self._tables = (np.concatenate([pair(w, 0) for w in WIDTHS], 1), np.concatenate([pair(w, 2) for w in WIDTHS if w > 2], 1))
        return self._tables

    def probabilities(self, bodies: list[bytes]) -> np.ndarray:
        """For each of ``bodies`` the mean over its windows of the languages' probabilities, each window by its bytes.

        Windows of all bodies go through the network side by side. A body's figures don't depend on the others.
        """
        first, second = self._lookup()
        parts = [windows(x) for x in bodies]
        counts = np.array([len(x) for x in parts])
        ends = np.cumsum(counts)
        weight = np.full(ends[-1], float(WINDOW))
        weight[ends - 1] = [max(1, len(x) - WINDOW * (n - 1)) for x, n in zip(bodies, counts.tolist(), strict=True)]
        rows, out = (np.concatenate(parts) if len(parts) > 1 else parts[0]), np.empty((ends[-1], len(self.classes)))
        bias = np.concatenate([self.p[f"bias{w}"] for w in WIDTHS])
        for s in range(0, len(rows), BLOCK):
            x = np.ascontiguousarray(rows[s : s + BLOCK].T).astype(np.int32)  # position, window
            pairs = (x[:-1] << 8) | x[1:]
            z = first.take(pairs[:WINDOW], axis=0)
            z[:, :, FILTERS:] += second.take(pairs[2 : WINDOW + 2], axis=0)
            h = np.maximum(z.max(axis=0) + bias, 0)
            logits = np.einsum("nf,fk->nk", h, self.p["out"]) + self.p["out_bias"]
            logits -= logits.max(axis=1, keepdims=True)
            q = np.exp(logits)
            out[s : s + BLOCK] = q / q.sum(axis=1, keepdims=True)
        return np.add.reduceat(out * weight[:, None], ends - counts) / np.add.reduceat(weight, ends - counts)[:, None]

    def predict(self, bodies: list[bytes]) -> list[tuple[str, float]]:
        found = [("und", 0.0)] * len(bodies)
        known = [i for i, x in enumerate(bodies) if LETTER.search(x.decode("utf-8", "replace"))]
        if known:
            for i, p in zip(known, self.probabilities([bodies[i] for i in known]), strict=True):
                k = int(p.argmax())
                found[i] = (self.classes[k], float(min(1.0, max(0.0, p[k]))))
        return found


def train(docs: DataFrame, rows: int = FIT_WINDOWS) -> ByteNet | None:
    """A network from text and lang of ``docs``: at most ``rows`` distinct texts a language, one window at a hashed place of each.

    The bounded sample reaches the driver (rows x languages x 259 bytes). Rows with null lang, null or empty text
    aren't learned from; of equal texts of a language one is. Every language of the rest is a class. None if nothing
    is left.
    """
    some = docs.where("text is not null and lang is not null and text <> ''").select(F.col("lang").alias("lang"), "text", F.xxhash64("text").alias("h"))
    counts = cut(some.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")))
    known = counts.count()
    if not known:
        return None
    # A hashed fraction first, so that only a few candidates a language are ordered.
    share = (F.lit(1_000_000 * (1.3 * rows + 30)) / F.col("n")).cast("long")
    candidates = some.join(F.broadcast(counts) if known <= BROADCAST_LANGUAGES else counts, "lang").where(F.pmod("h", F.lit(1_000_000)) < share)
    span = WINDOW + max(WIDTHS)
    at = F.lit(1) + F.pmod(F.shiftright("h", 20), F.greatest(F.length("text") - span, F.lit(0)) + 1).cast("int")
    sample = candidates.groupBy("lang", "h").agg(F.min(F.substring(F.col("text"), at, F.lit(span))).alias("piece"))
    sample = sample.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("place") <= rows)
    pieces: dict[str, list[bytes]] = {}
    for lang, piece in sample.orderBy("lang", "h").select("lang", "piece").toLocalIterator():
        pieces.setdefault(lang, []).append(piece.encode())
    classes = sorted(pieces)
    x = np.stack([windows(p)[0] for c in classes for p in pieces[c]])
    y = np.array([i for i, c in enumerate(classes) for _ in pieces[c]])
    # Short texts are to be known too: a third of the windows keep a few bytes only.
    rng = np.random.default_rng(3)
    x = x.copy()
    for i in np.nonzero(rng.random(len(x)) < 0.33)[0]:
        x[i, int(rng.integers(12, 120)) :] = 32
    return ByteNet(classes).fit(x, y)


def identify(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score.

    Null texts and texts without a letter are ``und`` with score 0, as is everything if ``net`` is None. Every byte of
    a text falls into a window. Equal texts give equal results; other columns are ignored; an empty table gives an
    empty result.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = b.column(1).to_pylist()
            found = net.predict(bodies) if net and bodies else [("und", 0.0)] * len(bodies)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(part: int = 0, of: int = 5):
    """Rows that are kept from learning: crc32 of the doc_id's text modulo ``of`` is ``part``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % F.lit(of) == F.lit(part)
