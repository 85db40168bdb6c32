"""Large tables beside the rows: a copy of the table for each of a few parts of the rows.

A join by id moves a vector for each id. Where ids are many times the vectors, less is
moved if rows are dealt into parts by what keeps them together and one copy of the table
is shuffled to each part. A task then reads its copy, of a size that the caller bounds,
and lets its rows stream past: bags may be of any size, and nothing goes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType

#: Parts of the rows at most, whatever the number of cores: so often a table is written.
COPIES = 48


def spread(spark: SparkSession) -> int:
    """Parts for two rounds of tasks."""
    return max(1, min(COPIES, 2 * spark.sparkContext.defaultParallelism))


def beside(rows: DataFrame, table: DataFrame, parts: int, by: Sequence[str], order: Sequence[str] = (), blocks: int = 1) -> DataFrame:
    """Rows in ``parts`` by the hash of ``by``, sorted by that, ``by`` and ``order``;
    before them in each part the rows of ``table`` as ``_table``, with a null ``_at``.
    With ``blocks`` the table is cut by id and the rows meet each block in a part of its own."""
    block = lambda c: F.explode(F.sequence(F.lit(0), F.lit(c - 1)))
    given = rows.withColumn("_at", F.xxhash64(*by))
    given = given.select("*", F.pmod("_at", F.lit(parts)).cast("int").alias("_i"), (block(blocks) if blocks > 1 else F.lit(0)).alias("_j"))
    cut = table.select(F.struct(*table.columns).alias("_table"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("_j")).select("_table", "_j", block(parts).alias("_i"))
    part = (F.col("_i") * blocks + F.col("_j")).alias("_part")
    both = cut.select("_table", part).unionByName(given.select(*rows.columns, "_at", part), allowMissingColumns=True)
    return both.repartitionById(parts * blocks, "_part").sortWithinPartitions(F.asc_nulls_first("_at"), *by, *order)


def handed(both: DataFrame) -> DataFrame:
    """Rows of :func:`beside` as a Python worker is handed them: empty arrays for null ones,
    of which Arrow's writer passes over all before in a batch for each."""
    none = lambda t: (F.array() if isinstance(t, ArrayType) else F.lit("") if isinstance(t, BinaryType) else F.lit(None)).cast(t)
    kind = both.schema["_table"].dataType
    lists = {f.name: F.coalesce(f.name, none(f.dataType)) for f in both.schema if isinstance(f.dataType, ArrayType)}
    return both.withColumns(lists | {"_table": F.coalesce("_table", F.struct(*[none(f.dataType).alias(f.name) for f in kind]))})


def read(batches: Iterator[pa.RecordBatch]) -> tuple[pa.StructArray | None, Iterator[pa.RecordBatch]]:
    """The table of a part, and the batches of rows after it."""
    held, rest = [], None
    for batch in batches:
        n = batch.column("_at").null_count
        if n:
            held.append(batch.column("_table").slice(0, n))
        if n < len(batch):
            rest = batch.slice(n)
            break

    def rows() -> Iterator[pa.RecordBatch]:
        if rest is not None:
            yield rest
            yield from batches

    return held, rows()


def matrix(held: list[pa.StructArray], at: int = 1, opened: Callable[[pa.Array], np.ndarray] | None = None) -> np.ndarray:
    """The vectors of a table's rows, all of one length, as one array."""
    opened = opened or (lambda x: x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1))
    n, done, out = sum(map(len, held)), 0, None
    for part in held:
        x = opened(part.flatten()[at])
        out = np.empty((n, x.shape[1]), x.dtype) if out is None else out
        out[done:done + len(part)] = x
        done += len(part)
    return out


class Places:
    """Where the ids of a table are in its matrix; an id may be there more than once."""

    def __init__(self, ids: np.ndarray):
        self.order = np.argsort(ids, kind="stable")
        self.ids = ids[self.order]
        self.low, n = (int(self.ids[0]), len(ids)) if len(ids) else (0, 0)
        span = int(self.ids[-1]) - self.low + 1 if n else 0
        self.once = bool((self.ids[1:] != self.ids[:-1]).all())
        self.direct = None
        if self.once and span <= 4 * n + 1024:
            self.direct = np.full(span, -1, dtype=np.int64)
            self.direct[self.ids - self.low] = self.order

    def of(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``wanted``, place): a pair for each match, in the order of ``wanted``."""
        if self.direct is not None:
            at = wanted - self.low
            inside = np.flatnonzero((wanted >= self.low) & (wanted <= self.ids[-1])) if len(self.direct) else np.empty(0, np.int64)
            place = self.direct[at[inside]]
            return inside[place >= 0], place[place >= 0]
        first, last = np.searchsorted(self.ids, wanted, "left"), np.searchsorted(self.ids, wanted, "right")
        n = last - first
        which = np.repeat(np.arange(len(wanted)), n)
        return which, self.order[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(which))]


def changed(columns: list[pa.Array], before: list[pa.Array] | None) -> np.ndarray:
    """Which rows differ from the one before them; ``before``: the row before the first."""
    out = np.zeros(len(columns[0]), dtype=bool)
    out[:1] = before is None
    for i, c in enumerate(columns):
        x = c if before is None else pa.concat_arrays([before[i], c])
        a, b = x.slice(1), x.slice(0, len(x) - 1)
        ne = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
        out[len(out) - len(ne):] |= ne
    return out


def _listed(values: np.ndarray, there: np.ndarray, none: np.ndarray | None = None) -> pa.Array:
    """Rows of ``values`` as lists, null where not ``there``; ``none``: rows whose elements are null."""
    n, dim = values.shape
    flat = pa.array(values.reshape(-1), mask=None if none is None else np.repeat(none, dim))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), flat, mask=pa.array(~there))


def features(long: DataFrame, table: DataFrame, of: dict[str, tuple[str | None, str]], by: Sequence[str], parts: int, dim: int, order: Sequence[str] = (), opened: Callable[[pa.Array], np.ndarray] | None = None) -> DataFrame:
    """(by, a column for each of ``of``): features (key, kind) pooled over the ids with
    that key, or over all, of a unit of rows that agree in ``by``. ``kind`` is sum
    (weighted), mean or sequence (by ``order``); a feature without ids is null. Units
    without a match are left out. ``opened`` makes vectors of doubles of a table's column where they are held."""
    by, keyed, weighted = list(by), any(k is not None for k, _ in of.values()), any(kind == "sum" for _, kind in of.values())
    extra = ["key"] * (keyed and "key" not in by) + ["weight"] * weighted
    given = long.filter("id IS NOT NULL").select(*dict.fromkeys([*by, *extra, *order]), F.col("id").cast("long").alias("id"))
    given = given.withColumn("weight", F.col("weight").cast("double")) if weighted else given
    both = beside(given, table.filter("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), "vec"), parts, by, order)
    both = handed(both.select("_at", "_table", "id", *by, *extra))
    element = "double" if opened is not None else table.schema["vec"].dataType.elementType.simpleString()
    kinds = ", ".join(f"`{c}` {f'array<array<{element}>>' if kind == 'sequence' else 'array<double>'}" for c, (_, kind) in of.items())
    schema = ", ".join([*(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in by), kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = read(batches)
        if not held:
            return
        vectors, places = matrix(held, opened=opened), Places(np.concatenate([x.flatten()[0].to_numpy() for x in held]))
        held.clear()
        open_, unit = None, None  # the last unit, which may go on

        def out(units: list[pa.Array], state: dict, lo: int, hi: int) -> pa.RecordBatch:
            made = []
            for name, (_, kind) in of.items():
                s = state[name]
                if kind == "sequence":
                    flat = np.concatenate([*s["at"][lo:hi], np.empty(0, np.int64)]) if hi > lo else np.empty(0, np.int64)
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in s["at"][lo:hi]])]).astype(np.int32)
                    inner = _listed(vectors[flat], np.ones(len(flat), bool))
                    made.append(pa.ListArray.from_arrays(pa.array(ends), inner, mask=pa.array(s["n"][lo:hi] == 0)))
                else:
                    n = s["n"][lo:hi]
                    total = s["sum"][lo:hi] / np.maximum(n, 1)[:, None] if kind == "mean" else s["sum"][lo:hi]
                    none = (n > 0) & (s["valid"][lo:hi] == 0)
                    made.append(_listed(total, n > 0, none if none.any() else None))
            return pa.RecordBatch.from_arrays([*[u.slice(lo, hi - lo) for u in units], *made], names=[*by, *of])

        for batch in rows:
            which, place = places.of(batch.column("id").to_numpy())
            if not len(which):
                continue
            columns = [batch.column(c).take(pa.array(which)) for c in by]
            new = changed(columns, unit)
            goes_on = not new[0]
            new[0] = True
            starts, segment = np.flatnonzero(new), np.cumsum(new) - 1
            count = len(starts)
            key = batch.column("key").take(pa.array(which)) if keyed else None
            w = batch.column("weight").take(pa.array(which)) if weighted else None
            good = None if w is None or not w.null_count else w.is_valid().to_numpy(zero_copy_only=False)
            w = None if w is None else pc.fill_null(w, 0.0).to_numpy(zero_copy_only=False)
            state = {}
            for name, (k, kind) in of.items():
                own = np.arange(len(which)) if k is None else np.flatnonzero(pc.fill_null(pc.equal(key, k), False).to_numpy(zero_copy_only=False))
                s = state[name] = {"n": np.bincount(segment[own], minlength=count)}
                if kind == "sequence":
                    s["at"] = np.split(place[own], np.cumsum(s["n"])[:-1])
                    continue
                counted = own if kind == "mean" or good is None else own[good[own]]
                s["valid"] = np.bincount(segment[counted], minlength=count)
                s["sum"] = np.zeros((count, dim))
                if len(counted):
                    x = vectors[place[counted]].astype(np.float64)
                    if kind == "sum":
                        x *= w[counted][:, None]
                    at = segment[counted]
                    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                    s["sum"][at[first]] = np.add.reduceat(x, first, axis=0)
            if open_ is not None and goes_on:
                for name, s in state.items():
                    for c in s:
                        if c == "at":
                            s[c][0] = np.concatenate([open_[name][c][0], s[c][0]])
                        else:
                            s[c][0] = open_[name][c][0] + s[c][0]
            elif open_ is not None:
                yield out(unit, open_, 0, 1)
            units = [c.take(pa.array(starts)) for c in columns]
            if count > 1:
                yield out(units, state, 0, count - 1)
            unit, open_ = [u.slice(count - 1) for u in units], {name: {c: v[count - 1:] for c, v in s.items()} for name, s in state.items()}
        if open_ is not None:
            yield out(unit, open_, 0, 1)

    return both.mapInArrow(run, schema)
