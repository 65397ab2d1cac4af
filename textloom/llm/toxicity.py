"""Toxicity from a weighted lexicon: folding, Aho-Corasick matching, exception phrases, length normalisation.

The lexicon's weights are learned from labelled rows. Its entries are whole words and word beginnings, so that an
insult is found in its inflected forms too. Exception phrases are learned from the same rows: pairs of words that hold
an entry and stand in clean texts much more often than the entry itself does.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import bounded_batches, cut

#: Look-alike letters of other scripts, and digits and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ł": "l", "ø": "o", "ɑ": "a", "ɡ": "g",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Phrases in which a lexicon word isn't an insult, besides those that are learned; matched like the lexicon, and they cover the words inside them.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "pond scum", "circus clown", "the idiot by", "disgusting taste")

FOLD = str.maketrans(HOMOGLYPHS | SUBSTITUTES | {"​": None, "‌": None, "‍": None, "­": None, "﻿": None})
WORD = re.compile(r"\w+")
PREFIXES = (4, 5, 6)
#: Labelled rows that the lexicon and its scale are fitted on, at most.
FIT_ROWS = 20_000
#: Log-likelihood ratio that an entry must reach (24: about one in a million by chance), and its least weight.
LEAST_RATIO, LEAST_WEIGHT = 24.0, 1.0
#: Log-likelihood ratio by which a phrase must be cleaner than the entry in it (11: about one in a thousand by chance).
EXCEPTION_RATIO = 11.0
#: Cells of the histogram that the logistic scale is fitted on.
CELLS = 64


def fold(text: str | None) -> str:
    """Lower case, look-alike letters and digit substitutions folded, invisible characters out."""
    return (text or "").lower().translate(FOLD)


def features(folded: str) -> set[str]:
    """Distinct words, and beginnings of words as ``stem*``."""
    words = set(WORD.findall(folded))
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}


@dataclass
class Lexicon:
    """Weights of words and of beginnings (``stem*``), exception phrases, and the scale of the score."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    intercept: float = -2.0
    slope: float = 1.0
    _machine: ahocorasick.Automaton | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_machine": None}

    def machine(self) -> ahocorasick.Automaton:
        if self._machine is None:
            entries: dict[str, list[float]] = {}  # text: weight as a word, weight as a beginning, 1 if an exception
            for w, x in self.weights.items():
                entries.setdefault(w.rstrip("*"), [0.0, 0.0, 0.0])[w.endswith("*")] = x
            for phrase in self.exceptions:
                entries.setdefault(fold(phrase), [0.0, 0.0, 0.0])[2] = 1.0
            self._machine = ahocorasick.Automaton()
            for text, x in entries.items():
                self._machine.add_word(text, (len(text), *x))
            if entries:
                self._machine.make_automaton()
        return self._machine

    def signal(self, text: str | None) -> float:
        """Weight of the matches outside exception phrases, each word once at its best, over the root of the number of words."""
        folded = fold(text)
        hits, covered = self.matches(folded)
        at = sorted(hits)
        total, last, phrases, n = 0.0, -1, sorted(covered), 0
        for start in at:  # both in order, so that each phrase is looked at once
            while n < len(phrases) and phrases[n][0] <= start:
                last = max(last, phrases[n][1])
                n += 1
            if start > last:
                total += hits[start]
        return total / math.sqrt(max(1, sum(1 for _ in WORD.finditer(folded)))) if total else 0.0

    def matches(self, folded: str) -> tuple[dict[int, float], list[tuple[int, int]]]:
        """Weights of the words that match by where they start, and the ends of the exception phrases."""
        machine = self.machine()
        if not folded or not len(machine):
            return {}, []
        covered, hits, end = [], {}, len(folded)
        for last, (n, whole, beginning, exception) in machine.iter(folded):
            start = last + 1 - n
            if start and (folded[start - 1].isalnum() or folded[start - 1] == "_"):
                continue
            ends = last + 1 == end or not (folded[last + 1].isalnum() or folded[last + 1] == "_")
            if exception and ends:
                covered.append((start, last))
            weight = max(beginning, whole if ends else 0.0)
            if weight > hits.get(start, 0.0):
                hits[start] = weight
        return hits, covered

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.intercept + self.slope * squash(self.signal(text))))))


def squash(signal: float) -> float:
    return math.log1p(8 * signal)


def ratio(k1: int, k0: int, n1: int, n0: int) -> float:
    """Log-likelihood ratio of a feature in ``k1`` of ``n1`` and ``k0`` of ``n0`` documents."""
    out, n, k = 0.0, n1 + n0, k1 + k0
    for seen, rows, both in ((k1, n1, k), (k0, n0, k), (n1 - k1, n1, n - k), (n0 - k0, n0, n - k)):
        if seen:
            out += 2 * seen * math.log(seen * n / (rows * both))
    return out


def fit_scale(counts: dict[int, tuple[int, int]]) -> tuple[float, float]:
    """Intercept and slope of a ridge logistic curve over the histogram {cell: (label 0, label 1)} of squashed signals."""
    x = np.array([c / 8 for c in counts], float)
    n0, n1 = (np.array([v[i] for v in counts.values()], float) for i in (0, 1))
    beta = np.array([-2.0, 1.0])
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        grad = design.T @ (n1 - (n0 + n1) * p) - 1e-2 * (beta - [-2.0, 1.0])
        hess = (design * ((n0 + n1) * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta + np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Lexicon:
    """A lexicon from at most ``rows`` labelled rows (a hash of doc_id picks them): weights, exceptions and scale.

    Rows with a null doc_id or label aren't learned from; repeated ones count as often as they occur. With no labels at
    all the lexicon is empty and every score is the same low one. Every feature that passes the tests becomes an entry:
    their number follows from the ``rows`` texts, whatever the corpus.
    """
    bounded_batches(docs.sparkSession)
    picked = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("__toxic"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id", "__toxic").limit(rows)
    picked = picked.select(F.col("doc_id").alias("__picked"), F.col("__toxic").alias("__toxic"))
    sample = cut(docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("__picked")).select("text", "__toxic"))

    def count(wanted=None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter = Counter()
            for b in batches:
                for text in b.column(0).to_pylist():
                    found = features(fold(text))
                    seen.update(found if wanted is None else found & wanted.value)
                    seen[""] += 1  # documents
            keys = list(seen)
            for s in range(0, len(keys), 50_000):
                part = keys[s : s + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([seen[k] for k in part], pa.int64())], names=["feature", "k"])

        return run

    def counted(label: int, wanted=None) -> DataFrame:
        texts = sample.where(F.col("__toxic") == label).select("text")
        return texts.mapInArrow(count(wanted), "feature string, k long").groupBy("feature").agg(F.sum("k").alias("k"))

    toxic = {f: k for f, k in counted(1).where("feature = '' or k >= 4").toLocalIterator()}  # rarer ones can't reach LEAST_RATIO
    n1 = toxic.pop("", 0)
    clean = {f: k for f, k in counted(0, docs.sparkSession.sparkContext.broadcast(frozenset(toxic))).toLocalIterator()}
    n0 = clean.pop("", 0)
    weights = {}
    for f, k1 in toxic.items():
        k0 = clean.get(f, 0)
        weight = math.log((k1 + 0.5) / (n1 + 1)) - math.log((k0 + 0.5) / (n0 + 1))
        if weight >= LEAST_WEIGHT and ratio(k1, k0, n1, n0) >= LEAST_RATIO:
            weights[f] = round(weight, 6)
    lexicon = Lexicon(dict(sorted(weights.items(), key=lambda x: (-x[1], x[0]))), exceptions=())
    lexicon.exceptions = tuple(dict.fromkeys((*EXCEPTIONS, *_learned_exceptions(sample, lexicon))))
    lexicon._machine = None

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text, toxic in zip(*(c.to_pylist() for c in b.columns), strict=True):
                seen[(min(CELLS - 1, round(8 * squash(lexicon.signal(text)))), toxic)] += 1
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.int32()) for i in (0, 1)] + [pa.array([seen[k] for k in keys], pa.int64())], names=["cell", "toxic", "n"])

    found: dict[int, list[int]] = {}
    for cell, toxic, k in sample.mapInArrow(cells, "cell int, toxic int, n long").groupBy("cell", "toxic").agg(F.sum("n")).toLocalIterator():
        found.setdefault(cell, [0, 0])[toxic] += k
    if found:
        lexicon.intercept, lexicon.slope = fit_scale({k: tuple(v) for k, v in found.items()})
    return lexicon


def _learned_exceptions(sample: DataFrame, lexicon: Lexicon) -> list[str]:
    """Pairs of words around matches that are cleaner than the matching word by ``EXCEPTION_RATIO``, in order."""

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text, toxic in zip(*(c.to_pylist() for c in b.columns), strict=True):
                folded = fold(text)
                hits, _ = lexicon.matches(folded)
                found = set()
                if hits:
                    words = [(m.start(), m.group()) for m in WORD.finditer(folded)]
                    for i, (at, word) in enumerate(words):
                        if at in hits:
                            found.add((word, ""))
                            for a, z in ((i - 1, i), (i, i + 1)):
                                if a >= 0 and z < len(words):
                                    phrase = folded[words[a][0] : words[z][0] + len(words[z][1])]
                                    if phrase == f"{words[a][1]} {words[z][1]}":
                                        found.add((word, phrase))
                seen.update((word, phrase, toxic) for word, phrase in found)
        rows = [(*k, n) for k, n in seen.items()]
        for s in range(0, len(rows), 50_000):
            columns = zip(*rows[s : s + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], names=["word", "phrase", "toxic", "n"])

    counts = sample.mapInArrow(around, "word string, phrase string, toxic int, n long")
    by = [F.coalesce(F.sum(F.when(F.col("toxic") == label, F.col("n"))), F.lit(0)).alias(f"k{label}") for label in (0, 1)]
    counts = cut(counts.groupBy("word", "phrase").agg(*by))
    words = {r.word: (r.k1, r.k0) for r in counts.where("phrase = ''").toLocalIterator()}
    out = set()
    for r in counts.where("phrase <> '' and k0 >= 3 and k0 > 4 * k1").toLocalIterator():
        n1, n0 = words[r.word]
        if r.k1 * n0 < r.k0 * n1 and ratio(r.k1, r.k0, n1, n0) >= EXCEPTION_RATIO:
            out.add(r.phrase)
    return sorted(out)


def scorer(lexicon: Lexicon):
    """A column function that scores texts; null counts as empty, and equal texts, repeated rows too, get equal scores."""

    @F.pandas_udf("double")
    def score(texts):
        return texts.map(lexicon.score)

    return lambda text: score(F.coalesce(text, F.lit("")))


def toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """``docs`` with columns score (0 to 1) and predicted (1 if score >= threshold); they replace columns of these names.

    Null and empty texts have no match and get the score of a text without one. Texts are read whole. Repeated rows
    get equal scores; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    return docs.withColumn("score", scorer(lexicon)(F.col("text"))).withColumn("predicted", (F.col("score") >= F.lit(threshold)).cast("int"))


def drop_toxic_rows(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns as they are, that score under ``threshold``."""
    bounded_batches(docs.sparkSession)
    return docs.where(scorer(lexicon)(F.col("text")) < F.lit(threshold))


def held_out(part: int = 2, of: int = 4):
    """Rows that are kept from learning: crc32 of the doc_id's text modulo ``of`` is ``part``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % F.lit(of) == F.lit(part)
