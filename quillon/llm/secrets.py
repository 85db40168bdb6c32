"""Secret scan: fixed patterns, and character Markov models for what they miss.

Two first-order models over the characters that secrets are written in, one of
random strings and one of ordinary text, are learned from labelled samples. Random
strings are generated by rule, and joined by the values that the patterns find;
ordinary are all other runs of such characters in the whole corpus, and names as
programs have them, made by rule from WORDS. Transitions are counted over every
text in tasks, so only one table of counts reaches the driver. A token is a secret
if its mean log-likelihood ratio exceeds a threshold, which is set above nearly all
names. Spans of the patterns always stay; the models add tokens that overlap none of
them.

Null and empty texts have no spans. With no documents to learn from, the samples
are the generators alone. Repeated rows are scanned alike; extra columns are kept,
but one named like the result is replaced. Whole texts are scanned; offsets are code
points, ends exclusive.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bounded

# The base patterns and the least lengths of their matches.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "markov")

LEAST = 16
#: The threshold is at least this, in nats per character.
LOWEST = 0.5
#: Different characters of a secret, at least: rows of dashes are none.
VARIED = 6
#: Words that names in programs are made of, the labelled sample of ordinary tokens.
WORDS = """access account action active address admin agent alpha answer array author batch block buffer builder button cache
channel chart check client cloud cluster color column command config connection content context control convert counter create current
customer data database debug default delete device document domain driver editor element email engine error event export factory field
file filter folder format function global graph group handler header helper history host image import index input insert instance
interface item iterator label language layer layout library limit line list loader local lock logger main manager map master
matrix member memory menu message method metric model module monitor mouse name network node number object offset option order
output owner package page panel parent parser path pattern payload phone plugin point policy portal position process product profile
project property protocol provider queue random range reader record region register remote render report request resource response
result review router rule sample scanner schema screen script search section select sensor server service session setting shape
signal source stack state status storage stream string student style system table target task template test theme thread time
title topic tracker transport tree type update upload user utils value vector version video view widget window worker writer""".split()
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST)
ALPHABET = string.ascii_letters + string.digits + "+/_.=-"
CODE = {c: i + 1 for i, c in enumerate(ALPHABET)}
SPANS = "array<struct<kind:string,start:long,end:long>>"
MASK = "[secret]"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of the patterns' matches, by start and kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def tokens(text: str):
    """Matches of TOKEN that are not part of a word with other letters."""
    for m in TOKEN.finditer(text):
        a, b = m.span()
        if not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum()):
            yield m


def _codes(token: str) -> np.ndarray:
    return np.fromiter((CODE[c] for c in token), dtype=np.intp, count=len(token))


N = len(ALPHABET) + 1
#: Codes of bytes; 0 for those of no character of ALPHABET, which end a run.
OF_BYTE = np.array([CODE.get(chr(b), 0) for b in range(256)], dtype=np.int64)


def transitions(text: str) -> np.ndarray:
    """Counts of each character after each (0: the start of a run) in the runs of
    ``text``, flat."""
    c = OF_BYTE[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    before = np.concatenate([[0], c[:-1]])
    return np.bincount((before * N + c)[c > 0], minlength=N * N)


def _chain(counts: np.ndarray, smooth: float = 0.5) -> np.ndarray:
    """Log probabilities of each character after each."""
    counts = counts.reshape(N, N)[:, 1:] + smooth
    return np.log(counts / counts.sum(axis=1, keepdims=True))


@dataclass
class Model:
    ratio: np.ndarray
    threshold: float

    def score(self, token: str) -> float:
        """Mean log-likelihood ratio per character, random against ordinary."""
        c = _codes(token)
        return float(self.ratio[np.concatenate([[0], c[:-1]]), c - 1].mean())

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """All spans: those of the patterns, and the models' beside them."""
        text = text or ""
        found = base_spans(text)
        more, at, ends = [], 0, 0  # spans and tokens both come in order: one walk over both
        for m in tokens(text):
            while at < len(found) and found[at][0] < m.end():
                ends = max(ends, found[at][2])
                at += 1
            if ends <= m.start() and len(set(m[0])) >= VARIED and self.score(m[0]) > self.threshold:
                more.append((m.start(), 3, m.end()))
        return sorted(found + more)


def _random_strings(rng: random.Random, n: int) -> list[str]:
    kinds = (string.hexdigits[:16], string.ascii_uppercase + string.digits, string.ascii_letters + string.digits, ALPHABET[:64])
    return ["".join(rng.choices(kinds[i % len(kinds)], k=rng.randint(LEAST, 48))) for i in range(n)]


def _identifiers(rng: random.Random, words: list[str], n: int) -> list[str]:
    """Names as programs have them: joined words, capitals inside, a number at the end."""
    out = []
    for i in range(n):
        parts = rng.choices(words, k=rng.randint(2, 4))
        joined = (["_", "-", ".", "/"][i % 4].join(parts)) if i % 5 else "".join(p.capitalize() for p in parts)
        out.append(joined + (str(rng.randint(0, 2030)) if i % 3 == 0 else ""))
    return out


def corpus_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Transitions of all texts without the patterns' spans, and of the values that
    the patterns find, summed over the whole corpus in tasks."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, values = np.zeros(N * N, dtype=np.int64), np.zeros(N * N, dtype=np.int64)
        for batch in batches:
            for text in batch["text"]:
                if not text:
                    continue
                at = 0
                for a, kind, b in base_spans(text):
                    if a >= at:
                        rest += transitions(text[at:a])
                    at = max(at, b)
                    values += transitions(ASSIGN.match(text, a)[2] if kind == 0 else text[a:b])
                rest += transitions(text[at:])
        for kind, counts in enumerate((rest, values)):
            some = np.flatnonzero(counts)
            yield pd.DataFrame({"kind": np.full(len(some), kind, dtype=np.int32), "at": some.astype(np.int32), "n": counts[some]})

    summed = bounded(docs).select("text").mapInPandas(count, "kind int, at int, n long").groupBy("kind", "at").agg(F.sum("n").alias("n"))
    out = np.zeros((2, N * N))
    for r in summed.collect():
        out[r["kind"], r["at"]] = r["n"]
    return out[0], out[1]


def train(ordinary: np.ndarray, found: np.ndarray, seed: int = 11, names: int = 4000) -> Model:
    """Learns from transitions of ordinary text and of values found by patterns;
    generators add to both. Names weigh as much as the ordinary text, found values
    as much as the generated strings, so that neither drowns the other."""
    rng = random.Random(seed)
    made = _identifiers(rng, WORDS, names)
    scaled = lambda given, own: own + (given * (own.sum() / given.sum()) if given.sum() else 0.0)
    total = lambda xs: transitions("\n".join(xs)).astype(float)
    ratio = _chain(scaled(found, total(_random_strings(rng, names)))) - _chain(scaled(ordinary, total(made)))
    model = Model(ratio, 0.0)
    clean = sorted(model.score(x) for x in made if len(x) >= LEAST)
    rare = clean[min(len(clean) - 1, int(0.9995 * len(clean)))] if clean else 0.0
    return Model(ratio, max(LOWEST, rare + 0.1))


def fit(docs: DataFrame) -> Model:
    """Learns from all documents (see :func:`corpus_counts`)."""
    return train(*corpus_counts(docs))


def _spans(docs: DataFrame, model: Model, text: str) -> Column:
    given = bounded(docs).sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(SPANS)
    def scan(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in given.value.spans(t)] for t in texts], dtype="object")

    return scan(F.col(text))


def scanned(docs: DataFrame, model: Model, text: str = "text", into: str = "secrets") -> DataFrame:
    """``docs`` with a column ``into`` of spans (kind, start, end) in order."""
    return docs.withColumn(into, _spans(docs, model, text))


def described(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, model: Model, mask: str = MASK) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mask``; overlapping
    spans count as one. ``n_chars``, where present, follows the text."""
    given = bounded(docs).sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            found = given.value.spans(t)
            if not found:
                out.append(t)
                continue
            parts, at = [], 0
            for a, _, b in found:
                if a >= at:
                    parts += [t[at:a], mask]
                at = max(at, b)
            out.append("".join([*parts, t[at:]]))
        return pd.Series(out, dtype="object")

    out = docs.withColumn("text", clean(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
