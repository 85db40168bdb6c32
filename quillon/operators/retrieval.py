"""Approximate retrieval: inverted lists of coarse cells with product-quantized
residuals, over tables of vectors.

Cells and code books are fitted on a bounded, hashed sample; every vector is
assigned and encoded. A query meets the vectors of its nearest cells only, by an
equi-join on the cell: cells of many vectors are cut into chunks, so no group grows
with the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.sources.store import Store

SAMPLE = 20_000
CHUNK = 16_384


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Centres by Lloyd's rounds from seeded rows; an empty centre takes the row
    that is farthest from its own."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near, far = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        for c in np.flatnonzero(n == 0):
            worst = int(far.argmax())
            centres[c], far[worst] = x[worst], 0.0
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)[None]
    return d.argmin(axis=1), d.min(axis=1)


@dataclass
class Index:
    """Centres of the cells, and for each part of a residual its code book."""

    cells: np.ndarray
    books: list[np.ndarray]

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return np.split(x, len(self.books), axis=1)


def fitted(vectors: DataFrame, cells: int = 64, parts: int = 8, bits: int = 8, sample: int = SAMPLE, seed: int = 0) -> Index:
    """An index for (id, vec), fitted on at most ``sample`` rows."""
    there = vectors.filter("vec IS NOT NULL").withColumn("_h", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)))
    n = there.count()
    share = 1.0 if n <= sample else min(1.0, (1.1 * sample + 100) / n)  # a threshold first: few rows are ordered
    rows = there.filter(F.col("_h") < int(share * (1 << 52))).orderBy("_h", "id").limit(sample).select("vec").collect()
    x = np.array([r[0] for r in rows], dtype=np.float64)
    if not len(x) or x.shape[1] % parts:
        raise ValueError("the index needs vectors whose length its parts divide")
    centres = kmeans(x, cells, seed=seed)
    rest = x - centres[nearest(x, centres)[0]]
    return Index(centres, [kmeans(p, 1 << bits, seed=seed + 1 + i) for i, p in enumerate(np.split(rest, parts, axis=1))])


def encoded(vectors: DataFrame, index: Index) -> DataFrame:
    """(id, cell, code): every vector's cell and the codes of its residual's parts."""
    given = vectors.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = given.value
        for batch in batches:
            if not len(batch):
                continue
            x = np.array(batch["vec"].tolist(), dtype=np.float64)
            cell = nearest(x, own.cells)[0]
            codes = np.stack([nearest(p, b)[0] for p, b in zip(own.parts(x - own.cells[cell]), own.books, strict=True)], axis=1).astype("<u2")
            yield pd.DataFrame({"id": batch["id"], "cell": cell, "code": [c.tobytes() for c in codes]})

    return vectors.filter("id IS NOT NULL AND vec IS NOT NULL").select(F.col("id").cast("long").alias("id"), "vec").mapInPandas(run, "id long, cell int, code binary")


def searched(queries: DataFrame, codes: DataFrame, index: Index, k: int = 10, probes: int = 8, chunk: int = CHUNK) -> DataFrame:
    """(query, rank, id, distance): the ``k`` nearest by approximate squared
    distance among the vectors of each query's ``probes`` nearest cells; a row is no
    neighbour of its own id, ties go to the smaller one."""
    given = queries.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("array<int>")
    def probed(vecs: pd.Series) -> pd.Series:
        x = np.array(vecs.tolist(), dtype=np.float64)
        if not len(x):
            return pd.Series([], dtype="object")
        own = given.value.cells
        d = (own**2).sum(axis=1)[None] - 2 * x @ own.T
        return pd.Series(list(np.argsort(d, axis=1, kind="stable")[:, :probes].astype(np.int32)))

    def search(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out: list = []
        if len(c) and len(q):
            own = given.value
            code = np.frombuffer(b"".join(c["code"]), dtype="<u2").reshape(len(c), -1)
            ids, cell = c["id"].to_numpy(), int(c["cell"].iloc[0])
            for i, x in zip(q["query"], np.array(q["vec"].tolist(), dtype=np.float64), strict=True):
                rest = own.parts((x - own.cells[cell])[None])
                d = sum(((b - p) ** 2).sum(axis=1)[code[:, j]] for j, (p, b) in enumerate(zip(rest, own.books, strict=True)))
                best = np.lexsort((ids, d))[:k + 1]
                out += [(int(i), int(ids[j]), float(d[j])) for j in best if ids[j] != i][:k]
        return pd.DataFrame(out, columns=["query", "id", "distance"]).astype({"query": "int64", "id": "int64", "distance": "float64"})

    sizes = codes.groupBy(F.col("cell").alias("_cell")).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("long").alias("_n"))
    left = codes.join(F.broadcast(sizes), F.col("cell") == F.col("_cell")).withColumn("part", F.pmod(F.xxhash64("id"), F.col("_n"))).select("cell", "part", "id", "code")
    asked = queries.filter("id IS NOT NULL AND vec IS NOT NULL").select(F.col("id").cast("long").alias("query"), "vec").withColumn("cell", F.explode(probed("vec")))
    asked = asked.join(F.broadcast(sizes), F.col("cell") == F.col("_cell")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).select("cell", "part", "query", "vec")
    found = left.groupBy("cell", "part").cogroup(asked.groupBy("cell", "part")).applyInPandas(search, "query long, id long, distance double")
    order = Window.partitionBy("query").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "rank", "id", "distance")


class StoredIndex:
    """An index as tables in a folder: centres, code books, and for each cell the
    codes and vectors of its rows. It is built once, appended to without fitting
    again, and read by any session. A search takes candidates by their codes and ranks
    ``rerank`` times k of them by their vectors."""

    FIELDS = "cell int, id long, code binary, vec array<double>"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        self.store = Store(spark, f"{self.path}/rows", self.FIELDS, ["cell", "id"], buckets, ["cell"])
        self._fitted: Index | None = None

    @property
    def fitted(self) -> Index:
        if self._fitted is None:
            read = lambda name: self.spark.read.parquet(f"{self.path}/{name}").orderBy("part", "row").collect()
            cells, books = np.array([r["vec"] for r in read("cells")]), {}
            for r in read("books"):
                books.setdefault(r["part"], []).append(r["vec"])
            self._fitted = Index(cells, [np.array(books[p]) for p in sorted(books)])
        return self._fitted

    def build(self, vectors: DataFrame, **options) -> StoredIndex:
        """Fits cells and code books on a bounded sample of ``vectors`` (id, vec), writes
        them, and appends all of them."""
        index = fitted(vectors, **options)
        table = lambda parts: self.spark.createDataFrame([(p, i, [float(x) for x in v]) for p, rows in enumerate(parts) for i, v in enumerate(rows)], "part int, row int, vec array<double>")
        table([index.cells]).coalesce(1).write.parquet(f"{self.path}/cells")
        table(index.books).coalesce(1).write.parquet(f"{self.path}/books")
        self.append(vectors, 0)
        return self

    def append(self, vectors: DataFrame, epoch: int | None = None) -> bool:
        """Adds vectors with the cells and code books there are; one that an id had in the
        same cell is replaced. A batch whose ``epoch`` is in already adds nothing."""
        rows = encoded(vectors, self.fitted).withColumnRenamed("id", "_id").join(vectors.filter("vec IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")), F.col("id") == F.col("_id"))
        return self.store.put(rows.select("cell", "id", "code", "vec"), epoch)

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8, rerank: int = 10) -> DataFrame:
        """(query, rank, id, distance): the ``k`` nearest found for each query (id, vec), by
        exact squared distance; ties go to the smaller id, a row is no neighbour of itself."""
        rows = self.store.read()
        found = searched(queries, rows.select("id", "cell", "code"), self.fitted, k * rerank, probes).select("query", "id")
        asked = queries.select(F.col("id").cast("long").alias("query"), F.col("vec").cast("array<double>").alias("_q"))
        near = found.join(rows.select("id", "vec"), "id").join(asked, "query")
        exact = F.aggregate(F.zip_with("vec", "_q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        order = Window.partitionBy("query").orderBy("distance", "id")
        return near.select("query", "id", exact.alias("distance")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "rank", "id", "distance")
