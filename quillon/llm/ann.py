"""Approximate nearest neighbours by a permutation index.

PIVOTS vectors, chosen by a hash of their id (at most one for eight vectors),
order every vector: its permutation is the list of its PREFIX nearest pivots,
nearest first. Candidates lie in blocks by a hash of their id. A block posts each of
its vectors, with the pivot's rank, in the inverted files of the pivots of its
prefix. A query walks the files of its own prefix, which hold PREFIX * PREFIX /
PIVOTS postings for each candidate, two in a large table, and adds up the footrule
distance (ranks beyond the prefix count as PREFIX); the SHARE of the block's distinct
vectors with the smallest footrule, at least LEAST, is ranked anew by Euclidean
distance in double precision, and the block's best go on. Every vector is indexed and
every block is searched, so a query's neighbours are the best of all blocks.

The share that has to be ranked anew does not fall with the table where vectors are
spread evenly in all directions: no index finds nine in ten of the neighbours there
without a constant share of the vectors. Work is then queries times candidates.

Blocks are the units of work: queries in blocks meet candidates in blocks. A
vector that is stored many times is one entry of its block, which keeps its
smallest ids: no group depends on the data.

Vectors that are null, empty, zero or hold null or non-finite components take no
part, nor do those of another length than most pivots, nor rows without id. Ties
go to the smaller id. Rows repeated under one id are a query once, by the least of
their vectors, and candidates as often as they occur. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIVOTS, PREFIX = 2048, 64
SHARE, LEAST = 0.10, 512
#: Candidates in a block: a 64th of all, within these bounds.
BLOCK_FROM, BLOCK_TO = 8192, 65536
#: Queries that meet a block together; a candidate is shuffled once for each such lot.
QUERY_BLOCK = 16384
RESULT = "query_id long, vec_id long, score double"


def valid(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def pivots_of(vectors: DataFrame, there: int, n: int = PIVOTS) -> np.ndarray:
    """At most ``n`` of the ``there`` vectors, of one length, the first by a hash of
    their id. A threshold on the hash admits few more, so little is moved."""
    share = 1.0 if there <= n else min(1.0, (1.1 * n + 100) / there)
    h = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 52))
    rows = vectors.select("vec_id", "embedding", h.alias("h")).filter(F.col("h") < int(share * (1 << 52))).orderBy("h", "vec_id", "embedding").limit(n).collect()
    if not rows:
        return np.empty((0, 0))
    size = Counter(len(r[1]) for r in rows).most_common(1)[0][0]
    return np.array([r[1] for r in rows if len(r[1]) == size], dtype=np.float64)


def permutations(x: np.ndarray, pivots: np.ndarray, prefix: int, rows: int = 2048) -> np.ndarray:
    """The ``prefix`` nearest pivots of every row of ``x``, nearest first."""
    norms, out = (pivots**2).sum(axis=1)[None, :], np.empty((len(x), prefix), dtype=np.int64)
    for at in range(0, len(x), rows):
        d = norms - 2 * x[at:at + rows] @ pivots.T
        near = np.sort(np.argpartition(d, prefix - 1, axis=1)[:, :prefix], axis=1) if prefix < d.shape[1] else np.broadcast_to(np.arange(prefix), (len(d), prefix))
        order = np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable")
        out[at:at + rows] = np.take_along_axis(near, order, 1)
    return out


class Block:
    """The index of one block of candidates."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, prefix: int, k: int):
        order = np.argsort(ids, kind="stable")
        self.x, group = np.unique(x[order], axis=0, return_inverse=True)
        ids, group = ids[order], group.ravel()
        self.norms = (self.x**2).sum(axis=1)
        rank = np.argsort(group, kind="stable")
        starts = np.searchsorted(group[rank], np.arange(len(self.x)))
        self.ids = [ids[rank[a:min(a + k + 1, b)]] for a, b in zip(starts, [*starts[1:], len(rank)], strict=True)]
        self.prefix = min(prefix, len(pivots))
        perm = permutations(self.x, pivots, self.prefix)
        rows = np.repeat(np.arange(len(perm)), self.prefix)
        ranks = np.tile(np.arange(self.prefix), len(perm))
        by_pivot = np.argsort(perm.ravel(), kind="stable")
        borders = np.searchsorted(perm.ravel()[by_pivot], np.arange(len(pivots) + 1))
        self.files = [(rows[by_pivot[a:b]], ranks[by_pivot[a:b]]) for a, b in zip(borders[:-1], borders[1:], strict=True)]

    def search(self, query_id: int, q: np.ndarray, perm: np.ndarray, k: int, share: float, least: int) -> list[tuple[int, int, float]]:
        few = max(least, int(np.ceil(share * len(self.x))))
        if few < len(self.x):
            met = [self.files[p] for p in perm]
            rows = np.concatenate([f[0] for f in met])
            r = np.repeat(np.arange(len(met)), [len(f[0]) for f in met])
            ranks = np.concatenate([f[1] for f in met])
            footrule = np.bincount(rows, np.abs(ranks - r) + ranks + r - 2.0 * self.prefix, len(self.x))
            chosen = np.argpartition(footrule, few - 1)[:few]
        else:
            chosen = np.arange(len(self.x))
        rough = self.norms[chosen] - 2 * (self.x[chosen] @ q)
        if len(rough) > 4 * k + 8:  # those within rounding of the k-th nearest are measured exactly
            edge = np.partition(rough, k)[k]
            chosen = chosen[rough <= edge + 1e-9 * (1.0 + abs(edge) + float(q @ q))]
        d = np.sqrt(((self.x[chosen] - q) ** 2).sum(axis=1))
        near = chosen[np.argsort(d, kind="stable")]
        d, out, at = np.sort(d, kind="stable"), [], 0
        while at < len(near) and len(out) < k:
            end = at
            while end < len(near) and d[end] == d[at]:
                end += 1
            tied = sorted(int(i) for j in near[at:end] for i in self.ids[j] if i != query_id)
            out += [(query_id, i, float(d[at])) for i in tied[:k - len(out)]]
            at = end
        return out


def nearest(vectors: DataFrame, queries: Column, k: int = 10, pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance) of the
    ``k`` nearest found for each row of ``vectors`` (vec_id, embedding) that
    the condition ``queries`` admits; a row is no neighbour of its own id."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"), queries.alias("is_query"))
    rows = rows.filter(F.col("vec_id").isNotNull() & valid(F.col("embedding")))
    there = rows.count()
    chosen = pivots_of(rows, there, max(1, min(pivots, there // 8)))
    size = chosen.shape[1]
    rows = rows.filter(F.size("embedding") == size)
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if("is_query")).first()
    blocks = -(-n // int(np.clip(n / 64, BLOCK_FROM, BLOCK_TO))) if n else 1
    query_blocks = max(1, -(-n_queries // QUERY_BLOCK))
    given = vectors.sparkSession.sparkContext.broadcast(chosen)

    def search(candidates: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(candidates) and len(asked):
            own = given.value
            block = Block(candidates["vec_id"].to_numpy(), np.array(candidates["embedding"].tolist(), dtype=np.float64), own, prefix, k)
            q = np.array(asked["embedding"].tolist(), dtype=np.float64)
            for i, x, p in zip(asked["vec_id"], q, permutations(q, own, block.prefix), strict=True):
                out += block.search(int(i), x, p, k, share, least)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    hashed = F.xxhash64("vec_id", F.lit(17))
    left = rows.select("vec_id", "embedding", F.pmod(hashed, F.lit(blocks).cast("long")).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"))
    asked = rows.filter("is_query").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    right = asked.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"), F.pmod(hashed, F.lit(query_blocks)).cast("int").alias("q"))
    found = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInPandas(search, RESULT)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
