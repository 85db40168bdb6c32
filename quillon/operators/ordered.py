"""Rows in a total order over all tasks: numbers, running sums, and the first n.

Rows are range-partitioned by the whole order, so rows that tie in its first columns
are cut apart like any others and no value makes a task of its own. They are written
once with their task and place; numbers are places plus the small table of rows a
task, and plans on top start from that table however long the plan before was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources.scratch import Scratch

#: Rows that a task keeps in its heap; a larger n is found by order alone.
HEAP_ROWS = 1 << 20


def numbered(df: DataFrame, order: list[str | Column], into: str, by: list[str] = (), sums: dict[str, Column] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """``df`` with ``into``: the number of rows before, in ``order`` and within each
    group of ``by``; and for each of ``sums`` the sum of a whole number over the
    rows before. ``order`` must tell all rows of a group apart for the result to be
    fixed. Writes the rows once. Nulls come first where ``order`` does not say."""
    sums = sums or {}
    rows = df.withColumns({f"_v_{k}": v.cast("long") for k, v in sums.items()}) if sums else df
    rows = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id())
    rows = (scratch or Scratch(df.sparkSession)).stored(rows)
    task = F.shiftright("_at", 33)
    totals = rows.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"_v_{k}").alias(f"_n_{k}") for k in sums])
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    # a row a task
    starts = totals.select("_task", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_n", *[f"_n_{k}" for k in sums])])
    out = rows.withColumn("_task", task).join(F.broadcast(starts), "_task")
    inside = Window.partitionBy("_task").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    numbers = {into: F.col("_n") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))} | {k: F.col(f"_n_{k}") + F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0)) for k in sums}
    out = out.select(*df.columns, *[c.alias(k) for k, c in numbers.items()])
    if not by:
        return out
    # a group's rows are one range: what came before its first row is taken off
    firsts = out.groupBy(*[F.col(c).alias(f"_k_{c}") for c in by]).agg(*[F.min(k).alias(f"_f_{k}") for k in numbers])
    out = out.join(firsts, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by])
    return out.select(*df.columns, *[(F.col(k) - F.col(f"_f_{k}")).alias(k) for k in numbers])


def first_rows(table: pa.Table, order: list[str], n: int) -> pa.Table:
    """The n first rows of a table, by a heap; in no order."""
    if table.num_rows <= n:
        return table
    keys = {}
    for i, c in enumerate(order):  # a null is before all values
        keys[f"{i}v"], keys[f"{i}x"] = pc.is_valid(table[c]).cast(pa.int8()), table[c]
    return table.take(pc.select_k_unstable(pa.table(keys), n, [(k, "ascending") for k in keys]))


def _bounded(frames: Iterator[pa.RecordBatch], order: list[str], n: int) -> Iterator[pa.RecordBatch]:
    """The n first rows of a task: at most 2 n rows and a batch are held."""
    held: list[pa.RecordBatch] = []
    for frame in frames:
        held.append(frame)
        if sum(f.num_rows for f in held) > 2 * n + 4096:
            held = first_rows(pa.Table.from_batches(held), order, n).combine_chunks().to_batches()
    if held:
        yield from first_rows(pa.Table.from_batches(held), order, n).to_batches()


def n_smallest(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The ``n`` rows of ``df`` that come first in ascending ``order``, null first; the
    columns of ``order`` together tell rows apart.

    Each task keeps its n smallest in a bounded heap; heaps are merged by ordering
    what they hold, at most n rows a task, over all tasks. Ties cost nothing, as
    rows are compared by the whole order, and no task sees all rows.
    """
    if n <= 0:
        return df.limit(0)
    held = df
    if n <= HEAP_ROWS:
        held = df.mapInArrow(lambda frames: _bounded(frames, order, n), df.schema)
    return numbered(held, list(order), "_r").filter(F.col("_r") < n).drop("_r")
