"""Toxicity by multiple-instance learning: a document is a bag of sentences.

A sentence's probability is a logistic function of its words and of the words'
beginnings (three to seven letters); a document's is the noisy-or of its
sentences, 1 - prod(1 - p). Only documents have labels; the gradient of the
noisy-or deals the blame among sentences. Features are those that labelled toxic
documents hold significantly more often; a sentence without any of them has
probability 0, so long clean documents do not add up to toxic ones.

Sentences are split and features counted in tasks over the labelled sample. Only
the features chosen (at most MOST_FEATURES) and, of each sampled document, the
numbers of those that its sentences hold reach the driver, which fits the weights.

Null and empty texts, and texts without such words, get the rate of toxic
documents among training documents without evidence, at most FLOOR. With no
labels of one class every score is the observed rate. Repeated rows score alike;
extra columns play no part. Whole texts are scored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Cache, bounded, labelled_sample

PER_CLASS = 2500
MOST_FEATURES = 50_000
#: A text without any evidence is never called toxic.
FLOOR = 0.4
SENTENCE = re.compile(r"[^.!?\n]+")
LETTERS = re.compile(r"[^\W\d_]+")
RESULT = "score double, spans array<struct<start:long,end:long,p:double>>"


def features(word: str) -> list[str]:
    return [f"={word}", *(f"^{word[:k]}" for k in range(3, 8) if len(word) >= k)]


def sentences(text: str | None) -> Iterator[list[str]]:
    """The distinct words of each sentence that has any, in order of the alphabet."""
    for m in SENTENCE.finditer(text or ""):
        if words := set(LETTERS.findall(m[0].lower())):
            yield sorted(words)


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    floor: float

    def scorer(self):
        """text -> (score, spans of the sentences with p >= 0.5)."""
        weights, bias, floor = self.weights, self.bias, self.floor
        worth = Cache(lambda word: sum(weights.get(f, 0.0) for f in features(word))).__getitem__

        def score(text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
            clean, spans, seen = 0.0, [], False
            for m in SENTENCE.finditer(text or ""):
                z = [x for x in map(worth, LETTERS.findall(m[0].lower())) if x]
                if z:
                    p = 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + sum(z)))))
                    clean, seen = clean + math.log1p(-p), True
                    if p >= 0.5:
                        spans.append((m.start(), m.end(), p))
            return (max(floor, -math.expm1(clean)) if seen else floor), spans

        return score


def telling(sample: DataFrame, n0: int, n1: int, most: int = MOST_FEATURES) -> list[str]:
    """Features of the sample (doc_id, y, text) that toxic documents hold
    significantly more often, the clearest ``most`` of them, in order.

    A sentence that several documents of one class share counts for the first of
    them only: copies are no further evidence.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(doc_id, y, " ".join(words)) for doc_id, y, text in zip(batch["doc_id"], batch["y"], batch["text"], strict=True) for words in sentences(text)]
            yield pd.DataFrame(out, columns=["doc_id", "y", "words"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[Counter, Counter] = Counter(), Counter()
        now, found = None, set()
        for batch in batches:
            for doc_id, y, words in zip(batch["doc_id"], batch["y"], batch["words"], strict=True):
                if now != (doc_id, y):
                    if now:
                        held[now[1]].update(found)
                    now, found = (doc_id, y), set()
                found.update(f for w in words.split(" ") for f in features(w))
        if now:
            held[now[1]].update(found)
        for y in (0, 1):
            yield pd.DataFrame({"y": y, "feature": list(held[y]), "n": list(held[y].values())}).astype({"feature": "object", "n": "int64"})

    one = bounded(sample).select("doc_id", "y", "text").mapInPandas(split, "doc_id long, y int, words string")
    one = one.groupBy("y", "words").agg(F.min("doc_id").alias("doc_id"))
    parts = one.repartition("doc_id").sortWithinPartitions("doc_id", "y").mapInPandas(count, "y int, feature string, n long")
    both = parts.groupBy("feature").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("held"))
    a, b = F.col("toxic") / n1, F.col("held") / n0
    pooled = (F.col("toxic") + F.col("held") + 1.0) / (n1 + n0 + 2.0)
    both = both.withColumn("z", (a - b) / F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0))).filter((F.col("toxic") >= 4) & (F.col("z") > 4) & (a > 2 * b))
    return sorted(r[0] for r in both.orderBy(F.desc("z"), "feature").limit(most).select("feature").collect())


def evidence(sample: DataFrame, chosen: list[str]) -> DataFrame:
    """doc_id, y, and as packed int32: the numbers of the chosen features in each
    different sentence (``cols``), how many there are (``sizes``) and how often
    the document has that sentence (``times``)."""
    given = sample.sparkSession.sparkContext.broadcast(chosen)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = {f: i for i, f in enumerate(given.value)}
        numbers = Cache(lambda word: [at[f] for f in features(word) if f in at])
        pack = lambda xs: np.array(xs, dtype="<i4").tobytes()
        for batch in batches:
            out = []
            for doc_id, y, text in zip(batch["doc_id"], batch["y"], batch["text"], strict=True):
                found = Counter(tuple(x for w in words for x in numbers[w]) for words in sentences(text))
                found.pop((), None)
                out.append((doc_id, y, pack([x for s in found for x in s]), pack([len(s) for s in found]), pack(list(found.values()))))
            yield pd.DataFrame(out, columns=["doc_id", "y", "cols", "sizes", "times"])

    return bounded(sample).select("doc_id", "y", "text").mapInPandas(look, "doc_id long, y int, cols binary, sizes binary, times binary")


def train(sample: DataFrame, counts: dict[int, int], rounds: int = 150, l1: float = 0.02) -> Model:
    """Fits the model to document labels of ``sample`` (doc_id, y, text).
    ``counts``: labelled rows by class, by which the classes of the sample are weighed."""
    there = {r[0]: r[1] for r in sample.groupBy("y").count().collect()}
    n0, n1 = there.get(0, 0), there.get(1, 0)
    base = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1.0)
    if not n1 or not n0:
        return Model({}, 0.0, base)
    chosen = telling(sample, n0, n1)
    found = sorted(evidence(sample, chosen).collect())
    y = np.array([r[1] for r in found], dtype=float)
    joined = lambda i: np.frombuffer(b"".join(r[i] for r in found), dtype="<i4")
    cols, sizes, times = joined(2), joined(3), joined(4)
    doc_of = np.repeat(np.arange(len(found)), [len(r[3]) // 4 for r in found])
    rows = np.repeat(np.arange(len(sizes)), sizes)
    empty = np.setdiff1d(np.arange(len(found)), doc_of)
    scale = np.where(y == 1, counts[1] / n1, counts[0] / n0)
    scale /= scale.mean()
    without = y[empty] @ scale[empty], scale[empty].sum()
    floor = float((without[0] + 0.5) / (without[1] + 1.0 / base)) if len(empty) else base
    if not len(cols):
        return Model({}, 0.0, floor)
    w, bias = np.full(len(chosen), 0.5), -3.0
    g2, b2, step = np.full(len(chosen), 1e-2), 1e-2, 0.3
    for _ in range(rounds):
        z = np.clip(bias + np.bincount(rows, w[cols], len(doc_of)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        clean = np.exp(np.bincount(doc_of, times * np.log1p(-p), len(y)))[doc_of]
        slope = times * np.where(y[doc_of] == 1, -p * clean / np.maximum(1 - clean, 1e-9), p) * scale[doc_of]
        grad, gb = np.bincount(cols, slope[rows], len(chosen)), slope.sum()
        g2, b2 = g2 + grad * grad, b2 + gb * gb
        rate = step / np.sqrt(g2)
        w = w - rate * grad
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
        bias -= step * gb / math.sqrt(b2)
    return Model({f: float(x) for f, x in zip(chosen, w, strict=True) if abs(x) > 1e-6}, float(bias), min(floor, FLOOR))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, target: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Learns from at most ``per_class`` documents of each class (see
    :func:`labelled_sample`)."""
    return train(*labelled_sample(docs, labels, target, allowed, per_class))


def scored(docs: DataFrame, model: Model, text: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``into``: score and offending spans (code points);
    a column of that name is replaced."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        one = given.value.scorer()
        for texts in batches:
            found = [one(t) for t in texts]
            yield pd.DataFrame({"score": [s for s, _ in found], "spans": [[{"start": a, "end": b, "p": p} for a, b, p in x] for _, x in found]})

    return bounded(docs).withColumn(into, score(F.col(text)))
