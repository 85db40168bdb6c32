"""Next items of histories: vectors by join, an encoder on batches of rows, the best
items by products in blocks. Inference only; parameters are inputs.

Only what is bounded by the model (places, blocks of attention, gains) travels with
the tasks. Item and output vectors are tables of any size: the former meet the
histories by an equi-join on the item, the latter are shuffled to each part of the states.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import copies
from quillon.operators.lookup import Extent, sent

#: States and items of a block of :func:`best_items`: its scores take 32 MiB.
STATES, ITEMS = 1024, 4096
#: Elements of the items that a task of :func:`best_items` holds: 256 MiB of floats.
HELD = 1 << 26
#: Elements of the vectors that a task gathers for its windows: 32 MiB of doubles.
GATHERED = 1 << 22


def attention(q: np.ndarray, k: np.ndarray, v: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Scaled dot products of (..., places, dim) arrays; where ``mask`` is false a
    place is not looked at. If all are masked, all count alike."""
    scores = q @ np.swapaxes(k, -1, -2) / np.sqrt(q.shape[-1])
    if mask is not None:
        scores = np.where(mask, scores, -1e9)
    scores = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return scores / scores.sum(axis=-1, keepdims=True) @ v


def normed(x: np.ndarray, gain: np.ndarray, bias: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    """``x`` less its mean, over its standard deviation, taken over as many last axes
    as ``gain`` has."""
    over = tuple(range(-gain.ndim, 0))
    return (x - x.mean(axis=over, keepdims=True)) / np.sqrt(x.var(axis=over, keepdims=True) + eps) * gain + bias


@dataclass
class Block:
    """Weights (inputs by outputs) and biases of the four projections of an attention,
    of its perceptron, and gains and biases of the norms before both."""

    projections: dict[str, tuple[np.ndarray, np.ndarray]]
    inner: tuple[np.ndarray, np.ndarray]
    outer: tuple[np.ndarray, np.ndarray]
    norms: tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass
class SequenceModel:
    """Vectors of the places of a window, the vector of a place without item, gain and
    bias of the norm over a whole window, and blocks."""

    places: np.ndarray
    padding: np.ndarray
    gain: np.ndarray
    bias: np.ndarray
    blocks: list[Block] = field(default_factory=list)
    heads: int = 2

    @classmethod
    def seeded(cls, width: int, dim: int, heads: int = 2, layers: int = 2, seed: int = 0) -> SequenceModel:
        """A model with normal parameters, for tests and dry runs."""
        rng = np.random.default_rng(seed)
        weights = lambda a, b: (rng.normal(0, a ** -0.5, (a, b)), rng.normal(0, 0.1, b))
        gains = lambda *shape: (rng.normal(1, 0.1, shape), rng.normal(0, 0.1, shape))
        blocks = [Block({name: weights(dim, dim) for name in ("query", "key", "value", "out")}, weights(dim, 4 * dim), weights(4 * dim, dim), (gains(dim), gains(dim))) for _ in range(layers)]
        return cls(rng.normal(0, 1, (width, dim)), rng.normal(0, 1, dim), *gains(width, dim), blocks, heads)

    def encode(self, x: np.ndarray, known: np.ndarray) -> np.ndarray:
        """(rows, width, dim) of item vectors, and which places hold one, to states."""
        x = np.where(known[..., None], x, self.padding) + self.places
        x = normed(x, self.gain, self.bias)
        rows, width, dim = x.shape
        split = lambda z: z.reshape(rows, width, self.heads, -1).transpose(0, 2, 1, 3)
        for b in self.blocks:
            z = normed(x, *b.norms[0])
            q, k, v = (split(z @ w + c) for w, c in (b.projections[name] for name in ("query", "key", "value")))
            met = attention(q, k, v, known[:, None, None, :]).transpose(0, 2, 1, 3).reshape(rows, width, dim)
            x = x + met @ b.projections["out"][0] + b.projections["out"][1]
            z = np.maximum(normed(x, *b.norms[1]) @ b.inner[0] + b.inner[1], 0)
            x = x + z @ b.outer[0] + b.outer[1]
        return x


def states(seqs: DataFrame, user: str, items: str, table: DataFrame, model: SequenceModel, rows: int = 256, users: int | None = None) -> DataFrame:
    """(user, state): the encoder's output at the last place of each user's window.

    The window holds the last items, at its end; places before them, null items and
    items without a vector in ``table`` (id, vec) are padding, which no place looks at.
    A user without items has a window of padding. A user's different windows are rows
    of their own, equal ones are one; ``rows`` windows are computed at a time. Users are
    counted and dealt out, so that the vectors which a task gathers fit its memory
    whatever the number of users.
    """
    width, dim = model.places.shape
    given = seqs.sparkSession.sparkContext.broadcast(model)
    last = F.coalesce(F.col(items).cast("array<long>"), F.array().cast("array<long>"))
    last = F.slice(last, F.greatest(F.size(last) - width, F.lit(0)) + 1, width)
    users = seqs.select(user).count() if users is None else users
    parts = max(seqs.sparkSession.sparkContext.defaultParallelism, -(-users * width * dim // GATHERED))
    windows = seqs.select(F.col(user).alias("user"), last.alias("ids")).repartition(parts, "user").withColumn("window", F.xxhash64("ids"))
    long = windows.select("user", "window", (F.lit(width) - F.size("ids")).alias("free"), F.posexplode_outer("ids").alias("at", "item"))
    vectors = table.select(F.col("id").cast("long").alias("_id"), F.col("vec").cast("array<double>").alias("vec"))
    met = long.join(sent(vectors, "vec"), F.col("item") == F.col("_id"), "left")
    place = F.when(F.col("vec").isNotNull(), F.struct((F.col("free") + F.col("at")).alias("at"), "vec"))
    gathered = met.groupBy("user", "window").agg(F.collect_list(place).alias("places"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = given.value
        for batch in batches:
            for start in range(0, len(batch), rows):
                part = batch.iloc[start:start + rows]
                x, known = np.zeros((len(part), width, dim)), np.zeros((len(part), width), dtype=bool)
                for i, found in enumerate(part["places"]):
                    for p in found:
                        x[i, p["at"]], known[i, p["at"]] = p["vec"], True
                yield pd.DataFrame({"user": part["user"], "state": list(own.encode(x, known)[:, -1])})

    kind = seqs.schema[user].dataType.simpleString()
    return gathered.select("user", "places").mapInPandas(run, f"user {kind}, state array<double>").withColumnRenamed("user", user)


def best_items(of: DataFrame, user: str, out: DataFrame, k: int = 10, n_states: int = STATES, n_items: int = ITEMS, users: int | None = None) -> DataFrame:
    """(user, rank, item, score): the ``k`` items of ``out`` (id, vec, bias) with the
    largest vec . state + bias for each row of ``of`` (user, state); ties go to the
    smaller item. All items are scored: states are dealt into parts, to each of which the
    items are shuffled once, and meet them there, a block of states against a block of
    items at a time, keeping ``k`` a state. Items without id, vector or bias are none; of a
    repeated user the least state counts. ``users``: how many there are at most; without it
    ``of`` is made once more to count them.
    """
    of = of.select(F.col(user).alias("user"), "state")
    out = out.filter("id IS NOT NULL AND vec IS NOT NULL AND bias IS NOT NULL").select(F.col("id").cast("long").alias("id"), "vec", F.col("bias").cast("double").alias("bias"))
    parts = min(copies.spread(of.sparkSession), max(1, -(-(of.count() if users is None else users) // n_states)))
    blocks = max(1, -(-Extent.of(out, "vec").elements // HELD))
    both = copies.handed(copies.beside(of, out, parts, ["user"], ["state"], blocks).select("_at", "_table", "user", "state"))

    def best(states: np.ndarray, ids: np.ndarray, vectors: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, score), rows in order and the best items of each first."""
        row, item, score, least = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), None
        for at in range(0, len(ids), n_items):
            scores = states @ vectors[at:at + n_items].astype(np.float64).T
            scores += bias[at:at + n_items]
            if least is None:
                least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(states), -np.inf)
            r, c = np.nonzero(scores >= least[:, None])
            row, item, score = np.concatenate([row, r]), np.concatenate([item, ids[at + c]]), np.concatenate([score, scores[r, c]])
            order = np.lexsort((item, -score, row))
            row, item, score = row[order], item[order], score[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, item, score = row[kept], item[kept], score[kept]
            n = np.bincount(row, minlength=len(states))
            full = n >= k
            least = np.full(len(states), -np.inf)
            least[full] = score[np.cumsum(n)[full] - 1]
        return row, item, score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = copies.read(batches)
        if not held:
            return
        ids, vectors, bias = np.concatenate([x.flatten()[0].to_numpy() for x in held]), copies.matrix(held), np.concatenate([x.flatten()[2].to_numpy() for x in held])
        held.clear()
        before = None
        for batch in rows:
            first = np.flatnonzero(copies.changed([batch.column("user")], before))
            before = [batch.column("user").slice(len(batch) - 1)]
            for start in range(0, len(first), n_states):
                own = batch.take(pa.array(first[start:start + n_states]))
                row, item, score = best(own.column("state").flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1), ids, vectors, bias)
                rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
                yield pa.RecordBatch.from_arrays([own.column("user").take(pa.array(row)), pa.array(rank.astype(np.int32)), pa.array(item), pa.array(score)], names=["user", "rank", "item", "score"])

    kind = of.schema["user"].dataType.simpleString()
    found = both.mapInArrow(run, f"user {kind}, rank int, item long, score double")
    if blocks > 1:
        order = Window.partitionBy("user").orderBy(F.desc("score"), "item")
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return found.select(F.col("user").alias(user), "rank", "item", "score")


def next_items(seqs: DataFrame, user: str, items: str, table: DataFrame, out: DataFrame, model: SequenceModel, k: int = 10) -> DataFrame:
    """(user, rank, item, score): the ``k`` items with the highest output after each
    user's items; see :func:`states` and :func:`best_items`."""
    users = seqs.select(user).count()
    return best_items(states(seqs, user, items, table, model, users=users), user, out, k, users=users)
