"""Attention over a row's feature vectors as column expressions, without a Python worker.

A row's features are an array of vectors of one length. Weights are literals, outputs
by inputs, as for :func:`quillon.functions.expressions.linear`. Every intermediate is
bound once in a lambda, so an expression is as long as the layer, not as its uses, and
what a layer takes is its products, not these times the outputs of the matrix after them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.expressions import relu, total

Matrix = list[list[float]]


@dataclass(frozen=True)
class Layer:
    """Weights of one encoder layer."""

    query: Matrix
    key: Matrix
    value: Matrix
    out: Matrix
    inner: Matrix
    outer: Matrix


def _bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x evaluated once."""
    return F.transform(F.array(x), f)[0]


def _plain(x: Column, w: Matrix) -> Column:
    """W x. Places are summed in order; a vector of another length gives nulls."""
    made = lambda v: F.array(*[_summed(F.get(v, F.lit(j)) * float(t) for j, t in enumerate(row)) for row in w])
    return _bound(_bound(x, lambda v: F.when(F.size(v) <= len(w[0]), v)), made)


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _summed(terms: Iterable[Column]) -> Column:
    return reduce(lambda s, t: s + t, terms, F.lit(0.0))


def softmax(scores: Column) -> Column:
    def shares(s: Column) -> Column:
        powers = _bound(F.array_max(s), lambda m: F.transform(s, lambda x: F.exp(x - m)))
        return _bound(powers, lambda e: _bound(total(e), lambda t: F.transform(e, lambda x: x / t)))

    return _bound(scores, shares)


def normed(x: Column, eps: float = 1e-5) -> Column:
    """A vector less its mean, over its standard deviation."""
    mean = lambda v: _bound(v, lambda u: total(u) / F.size(u))
    centred = _bound(x, lambda v: _bound(mean(v), lambda m: F.transform(v, lambda t: t - m)))
    return _bound(centred, lambda c: _bound(F.sqrt(mean(F.transform(c, lambda u: u * u)) + eps), lambda d: F.transform(c, lambda t: t / d)))


def attended(vectors: Column, layer: Layer, heads: int) -> Column:
    """Multi-head attention of every vector to all vectors of its row."""
    dim = len(layer.query)
    if dim % heads:
        raise ValueError("heads must divide the length of the vectors")
    size = dim // heads
    view = lambda v: F.struct(_plain(v, layer.query).alias("q"), _plain(v, layer.key).alias("k"), _plain(v, layer.value).alias("v"))
    at = lambda x, j: F.get(x, F.lit(j))

    def head(all_: Column, own: Column, h: int) -> Column:
        places = range(h * size, (h + 1) * size)
        scores = F.transform(all_, lambda o: _summed(at(own["q"], j) * at(o["k"], j) for j in places) / math.sqrt(size))
        part = lambda w, j: total(F.zip_with(w, all_, lambda x, o: x * at(o["v"], j)))
        return _bound(softmax(scores), lambda w: F.array(*[part(w, j) for j in places]))

    return _bound(F.transform(vectors, view), lambda a: F.transform(a, lambda own: _plain(F.concat(*[head(a, own, h) for h in range(heads)]), layer.out)))


def encoded(df: DataFrame, column: str, layers: list[Layer], heads: int) -> DataFrame:
    """``df`` with ``column``, an array of vectors, after encoder layers in a row:
    attention and a perceptron, each added to what went in and normed after. Each half of
    a layer is a projection of its own, so that plans stay shallow."""
    x = F.col(column)
    df = df.withColumn(column, F.transform(x, lambda v: F.transform(v, lambda t: t.cast("double"))))
    for layer in layers:
        df = df.withColumn(column, F.zip_with(x, attended(x, layer, heads), _plus)).withColumn(column, F.transform(x, lambda u: normed(u)))
        df = df.withColumn(column, _perceptron(x, layer))
    return df


def _perceptron(x: Column, layer: Layer) -> Column:
    return F.transform(x, lambda u: normed(_plus(u, _plain(relu(_plain(u, layer.inner)), layer.outer))))


def seeded_layer(dim: int, inner: int, seed: int) -> Layer:
    """A layer with weights by a rule, for tables without trained ones."""
    def matrix(rows: int, columns: int, k: int) -> Matrix:
        return [[math.sin((seed + 1) * 12.9898 + k * 78.233 + i * 3.7 + j * 1.3) / math.sqrt(columns) for j in range(columns)] for i in range(rows)]

    return Layer(*[matrix(dim, dim, k) for k in range(4)], matrix(inner, dim, 4), matrix(dim, inner, 5))
