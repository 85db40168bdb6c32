"""Quality classifier: logistic regression on hashed word n-grams, learned by
follow-the-regularised-leader (FTRL-proximal) updates, scored as sparse dot products.

The n-grams are of one and two words, over two readings of a text: its words in
lower case, and their shapes (letters become a or A, digits 0, runs are
shortened, other characters stay). A word that repeats one of the eight before
it has a shape of its own. All are hashed into 2**BITS places. A
text's value at a place is its share of the text's n-grams, so length does not
move the score.

Null and empty texts have no n-grams and score the bias; so does every text if
there are no labels of one class. Repeated rows score alike; extra columns play
no part. Whole texts are scored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import WORD, Cache, bounded, labelled_sample

PER_CLASS = 2500
BITS = 20
GAIN = 20.0
WORDS = re.compile(WORD)
AGAIN = zlib.crc32(b"\x00again")


class Kinds(dict):
    """For str.translate: letters become a or A, digits 0, other characters stay."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = "0" if c.isdecimal() else c if not c.isalnum() else "A" if c.isupper() else "a"
        if len(self) < 1 << 16:
            self[code] = kind
        return kind


KINDS = Kinds()
RUN = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    return RUN.sub(r"\1\1", word.translate(KINDS))


#: Hashes of the shapes of translated words, of which there are far fewer than words.
SHAPES = Cache(lambda kinds: zlib.crc32(b"\x01" + RUN.sub(r"\1\1", kinds).encode("utf-8", "surrogatepass")))


def hashes_of(word: str) -> int:
    """Hash of the lower-cased word, then that of its shape, in one number."""
    return zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) << 32 | SHAPES[word.translate(KINDS)]


def places(text: str | None, hashes: Cache) -> np.ndarray:
    """The hashed places of a text's n-grams, with repetitions."""
    words = WORDS.findall(text or "")
    if not words:
        return np.empty(0, dtype=np.int64)
    both = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    low, form = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    again = np.zeros(len(words), dtype=bool)
    for k in range(1, 9):
        again[k:] |= both[k:] == both[:-k]
    form = np.where(again, np.uint64(AGAIN), form)
    mix = np.uint64(0x9E3779B97F4A7C15)
    grams = [low, form]
    grams += [(x[:-1] * mix) ^ (x[1:] + np.uint64(0x7F4A7C15)) for x in (low, form)]
    h = np.concatenate(grams)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scorer(self):
        hashes, weights, bias = Cache(hashes_of), self.weights, self.bias

        def score(text: str | None) -> float:
            at = places(text, hashes)
            z = bias + (GAIN * float(weights[at].sum(dtype=np.float64)) / len(at) if len(at) else 0.0)
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def counted(sample: DataFrame) -> DataFrame:
    """doc_id, y, and as packed numbers: the places of a text's n-grams (``at``,
    int32) and its values there (``x``, float32)."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Cache(hashes_of)
        for batch in batches:
            out = []
            for doc_id, y, text in zip(batch["doc_id"], batch["y"], batch["text"], strict=True):
                at = places(text, hashes)
                where, times = np.unique(at, return_counts=True)
                out.append((doc_id, y, where.astype("<i4").tobytes(), (GAIN * times / max(1, len(at))).astype("<f4").tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "y", "at", "x"])

    return bounded(sample).select("doc_id", "y", "text").mapInPandas(look, "doc_id long, y int, at binary, x binary")


def train(sample: DataFrame, counts: dict[int, int], epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, seed: int = 7) -> Model:
    """FTRL-proximal over ``sample`` (doc_id, y, text) in seeded order, classes
    weighed equally: a score of 0.5 is the balance of two classes of one size.
    Tasks count the n-grams; the driver sees sparse vectors only."""
    total = sum(counts.values())
    found = sorted(counted(sample).collect())
    labels = [r[1] for r in found]
    if not 0 < sum(labels) < len(labels):
        rate = (counts.get(1, 0) + 0.5) / (total + 1.0)
        return Model(np.zeros(1 << BITS, dtype=np.float32), float(np.log(rate / (1 - rate))))
    seen = [(np.frombuffer(r[2], dtype="<i4"), np.frombuffer(r[3], dtype="<f4")) for r in found]
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0
    share = sum(labels) / len(labels)
    weigh = {1: 0.5 / share, 0: 0.5 / (1 - share)}
    order = np.random.default_rng(seed)

    def weights(zi, ni, l1):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for i in order.permutation(len(seen)):
            where, x = seen[i]
            w, b = weights(z[where], n[where], l1), float(weights(np.float64(zb), np.float64(nb), 0.0))
            p = 1 / (1 + np.exp(-np.clip(b + w @ x, -30, 30)))
            g = (p - labels[i]) * weigh[labels[i]]
            gx = g * x
            sigma = (np.sqrt(n[where] + gx * gx) - np.sqrt(n[where])) / alpha
            z[where] += gx - sigma * w
            n[where] += gx * gx
            sigma = (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha
            zb += g - sigma * b
            nb += g * g
    bias = float(weights(np.float64(zb), np.float64(nb), 0.0))
    return Model(weights(z, n, l1).astype(np.float32), bias)


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, target: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Learns from at most ``per_class`` documents of each class (see
    :func:`labelled_sample`)."""
    return train(*labelled_sample(docs, labels, target, allowed, per_class))


def scored(docs: DataFrame, model: Model, text: str = "text", into: str = "quality_score") -> DataFrame:
    """``docs`` with a column ``into``: the probability of label 1; a
    column of that name is replaced."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = given.value.scorer()
        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype="float64")

    return bounded(docs).withColumn(into, score(F.col(text)))
