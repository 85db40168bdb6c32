"""Column expressions: safe casts, hashes, jagged arrays, activations, schedules."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


# --- scalars -----------------------------------------------------------------
def safe_cast(c: Column, to: str, default) -> Column:
    """``c`` as ``to``; ``default`` where it is null or cannot be read."""
    return F.coalesce(c.try_cast(to), F.lit(default).cast(to))


def whole_number(text: Column, to: str, default) -> Column:
    """:func:`safe_cast` of a text to whole numbers. A cast that fails costs an exception,
    so texts that are no whole numbers are told by their look."""
    return safe_cast(F.when(text.rlike(r"^[\x00-\x20\x7f]*[+-]?[0-9]+[\x00-\x20\x7f]*$"), text), to, default)


def hex_id(c: Column) -> Column:
    """A hexadecimal string as bigint; blanks and junk are 0."""
    digits = F.when(c.rlike(r"^[0-9a-fA-F]{1,15}$"), c)
    return F.coalesce(F.conv(digits, 16, 10).cast("long"), F.lit(0).cast("long"))


def split_key(key: Column, share: float, decimals: int = 2) -> Column:
    """Whether a row is on the training side of an index split: the key modulo
    10^decimals is below the share (rounded half to even)."""
    if not 0.0 < share < 1.0:
        raise ValueError("share must be between 0 and 1")
    whole = 10**decimals
    return F.pmod(key, F.lit(whole)) < round(share * whole)


def uniform(*keys: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the keys and the seed only: the first 13
    hexadecimal digits of the MD5 sum of "seed:key:...", as a fraction. Other
    engines can compute it as well."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def modulo_hash(c: Column, size: int) -> Column:
    return F.pmod(c, F.lit(size))


def mixing_hash(c: Column, size: int) -> Column:
    """A multiplicative hash with an xor-shift of 16 bits, without wrap-around.

    The product exceeds 64 bits, so it is split into high and low words of 32
    bits, which a shift by 16 joins again only across one border.
    """
    # The mask and the multiplier of the hash.
    mixed = c.bitwiseXOR(F.lit(0xDEADBEEF).cast("long"))
    product = mixed.cast("decimal(20,0)") * F.lit(2654435761).cast("decimal(10,0)")
    word = F.lit(2**32).cast("decimal(11,0)")
    high = F.floor(product / word).cast("long")
    low = (product - high.cast("decimal(20,0)") * word).cast("long")
    shifted_low = F.shiftright(low, 16).bitwiseOR(F.shiftleft(high.bitwiseAND(F.lit(0xFFFF).cast("long")), 16))
    shifted_high = F.shiftright(high, 16)
    low, high = low.bitwiseXOR(shifted_low), high.bitwiseXOR(shifted_high)
    return F.pmod(F.pmod(high, F.lit(size)) * F.lit(2**32 % size) + F.pmod(low, F.lit(size)), F.lit(size))


def recalibrated(p: Column, coefficient: float) -> Column:
    """p / (p + (1 - p) / c): predictions on the scale before down-sampling."""
    return p / (p + (1.0 - p) / coefficient)


def schedule(step: Column, stages: list[dict]) -> Column:
    """The learning-rate multiplier of ``step`` under consecutive stages.

    A stage has ``policy`` (none, linear, constant, poly, step, inv_sqrt,
    cosine), ``max_iters``, ``value`` and, by policy, ``decay_iters``,
    ``lr_scale`` and ``sgdr_period``.
    """
    out, start = F.lit(stages[-1].get("lr_scale", 1.0) * 1.0), 0
    branches = []
    for s in stages:
        i, value, scale, most = (step - start).cast("double"), s.get("value", 1.0), s.get("lr_scale", 1.0), s["max_iters"]
        policy = s["policy"]
        if policy == "linear":
            m = value + (1.0 - value) * i / float(most)
        elif policy == "constant":
            m = F.lit(float(value))
        elif policy == "poly":
            m = F.pow(1.0 - i / float(most), F.lit(float(value)))
        elif policy == "step":
            m = F.pow(F.lit(float(value)), F.floor(i / s["decay_iters"]))
        elif policy == "inv_sqrt":
            m = 1.0 / F.sqrt(F.greatest(i, F.lit(1.0)))
        elif policy == "cosine":
            period = float(s.get("sgdr_period", most))
            m = 0.5 * (1.0 + F.cos(F.lit(math.pi) * (i % period) / period))
        else:
            m = F.lit(1.0)
        branches.append((start, start + most, m * scale))
        start += most
    for a, b, m in reversed(branches):
        out = F.when((step >= a) & (step < b), m).otherwise(out)
    return out


def metric_key(namespace: Column, task: Column, name: Column, prefix: str = "", description: str = "") -> Column:
    """``namespace-task|prefix+name+description``."""
    return F.concat(namespace, F.lit("-"), task, F.lit("|" + prefix), name, F.lit(description))


def metric_key_pattern(namespace: str, name: str, prefix: str = "") -> str:
    """A regular expression for a metric's keys over all tasks."""
    return rf"^{namespace}-.+\|{prefix}{name}$"


# --- jagged arrays -----------------------------------------------------------
def padded(values: Column, width: int, pad) -> Column:
    """Exactly ``width`` elements: the first ones, padded at the end."""
    return F.slice(F.concat(values, F.array_repeat(pad, width)), 1, width)


def left_padded(values: Column, width: int, pad) -> Column:
    """Exactly ``width`` elements: the last ones, padded at the start."""
    missing = F.greatest(F.lit(width) - F.size(values), F.lit(0))
    last = F.slice(values, F.greatest(F.size(values) - width, F.lit(0)) + 1, F.lit(width))
    return F.concat(F.array_repeat(pad, missing), last)


def from_dense_lengths(row: Column, length: Column) -> Column:
    return F.slice(row, F.lit(1), length)


def position_weights(values: Column, weights: list[float]) -> Column:
    """The weight of each element's position; a bag longer than the weights is an error."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.when(F.size(values) <= len(weights), F.slice(w, F.lit(1), F.size(values))).otherwise(
        F.raise_error(F.lit("a bag is longer than its position weights")))


def regrouped(groups: dict[str, list[Column]]) -> Column:
    """A struct of the concatenations of each group's vectors."""
    return F.struct(*[F.concat(*cols).alias(k) for k, cols in groups.items()])


def jagged_equal(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


# --- vectors -----------------------------------------------------------------
def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def vector_sum(vectors: list[Column]) -> Column:
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), vectors)


def pairwise_dots(vectors: list[Column]) -> Column:
    """Dots of all pairs i < j of a few vectors, in order."""
    return F.array(*[dot(vectors[i], vectors[j]) for i in range(len(vectors)) for j in range(i + 1, len(vectors))])


def factorization(vectors: list[Column]) -> Column:
    """Half of (square of the sum less sum of the squares), over all components."""
    s = vector_sum([F.transform(v, lambda x: x.cast("double")) for v in vectors])
    return 0.5 * (dot(s, s) - reduce(lambda a, b: a + b, [dot(v, v) for v in vectors]))


def linear(x: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """W x + b for literal weights, an array of the outputs."""
    row = lambda w: F.array(*[F.lit(float(v)) for v in w])
    return F.array(*[dot(x, row(w)) + float(b) for w, b in zip(weights, bias, strict=True)])


def relu(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(v, F.lit(0.0)))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def perceptron(x: Column, weights: list[list[float]], bias: list[float], activation=relu) -> Column:
    return activation(linear(x, weights, bias))


def mlp(x: Column, layers: list[tuple[list[list[float]], list[float]]], activation=relu, last=True) -> Column:
    """Perceptrons in a row; ``last``: whether the last one is activated."""
    for i, (w, b) in enumerate(layers):
        x = perceptron(x, w, b, activation if last or i + 1 < len(layers) else (lambda v: v))
    return x


def _times_plus(x0: Column, y: Column, x: Column) -> Column:
    return F.transform(F.arrays_zip(x0.alias("a"), y.alias("b"), x.alias("c")), lambda t: t["a"] * t["b"] + t["c"])


def cross_layer(x0: Column, x: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """x0 * (W x + b) + x."""
    return _times_plus(x0, linear(x, weights, bias), x)


def vector_cross_layer(x0: Column, x: Column, weights: list[float], bias: list[float]) -> Column:
    """x0 * (x . w) + b + x."""
    d = dot(x, F.array(*[F.lit(float(v)) for v in weights]))
    b = F.array(*[F.lit(float(v)) for v in bias])
    return F.transform(F.arrays_zip(x0.alias("a"), b.alias("b"), x.alias("c")), lambda t: t["a"] * d + t["b"] + t["c"])


def low_rank_cross_layer(x0: Column, x: Column, v: list[list[float]], u: list[list[float]], bias: list[float]) -> Column:
    """x0 * (U (V x) + b) + x."""
    return _times_plus(x0, linear(linear(x, v, [0.0] * len(v)), u, bias), x)


def swish_layer_norm(x: Column, eps: float = 1e-5) -> Column:
    """x * sigmoid(layer norm of x)."""
    n = F.size(x)
    mean = total(x) / n
    variance = F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / n
    return F.transform(x, lambda v: v * sigmoid((v - mean) / F.sqrt(variance + eps)))


def mixture_cross_layer(x0: Column, x: Column, experts: list[tuple[list, list, list]], bias: list[float], gates: list[list[float]] | None = None, activation=relu) -> Column:
    """sum over experts of gate * x0 * (U act(C act(V x)) + b), plus x. ``experts``:
    (U, C, V) each; ``gates``: one weight row each, softmax over experts; without
    gates there is one expert."""
    zero = lambda w: [0.0] * len(w)
    outs = [linear(activation(linear(activation(linear(x, v, zero(v))), c, zero(c))), u, bias) for u, c, v in experts]
    shares = [F.lit(1.0)]
    if gates is not None:
        raw = [F.exp(dot(x, F.array(*[F.lit(float(g)) for g in row]))) for row in gates]
        shares = [r / reduce(lambda a, b: a + b, raw) for r in raw]
    scaled = lambda o, g: F.transform(o, lambda e: e * g)
    mixed = vector_sum([scaled(o, g) for o, g in zip(outs, shares, strict=True)])
    return _times_plus(x0, mixed, x)


def projected_interaction(vectors: list[Column], dim: int, left: list[tuple[list, list]], right: list[tuple[list, list]]) -> Column:
    """The first vector, then the products of two projections of all vectors: a
    perceptron gives rows of ``dim``, the other one columns of it."""
    flat = F.concat(*vectors)
    a, b = mlp(flat, left), mlp(flat, right)
    n, m = len(left[-1][0]) // dim, len(right[-1][0]) // dim
    cell = lambda i, j: reduce(lambda s, t: s + t, [F.get(a, F.lit(i * dim + d)) * F.get(b, F.lit(d * m + j)) for d in range(dim)])
    return F.concat(vectors[0], F.array(*[cell(i, j) for i in range(n) for j in range(m)]))


def deep_factorization(dense: Column, sparse: list[Column], deep: list[tuple[list, list]], over: tuple[list[float], float]) -> Column:
    """Probability of the factorization model: the dense vector, a deep part over
    all vectors and their factorization, through one logistic unit."""
    every = [dense, *sparse]
    x = F.concat(dense, mlp(F.concat(*every), deep), F.array(factorization(every)))
    return sigmoid(linear(x, [over[0]], [over[1]])[0])


def seeded_weights(rows: int, columns: int, seed: int = 0) -> list[list[float]]:
    """Literal weights in [-0.5, 0.5) by a rule, for tables and tests without trained ones."""
    return [[((i * 31 + j * 17 + seed * 13) % 101) / 101.0 - 0.5 for j in range(columns)] for i in range(rows)]


def seeded_vector(id_: Column, dim: int, low: float = -1.0, high: float = 1.0, seed: int = 0) -> Column:
    """A first vector for an id: uniform components that depend on id, place and seed."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: low + (high - low) * uniform(id_, i, seed=seed))
