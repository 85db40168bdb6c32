"""Running totals, ranks and ordered pairs over whole tables without one task for all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators.ordered import numbered
from quillon.sources.scratch import Scratch

BUCKETS = 256
#: Buckets of an octave of magnitudes.
FINE = 1024


def running_total(df: DataFrame, order: list[str | Column], bucket: Column, value: Column, into: str, by: list[str] = ()) -> DataFrame:
    """``df`` with ``into``: the sum of ``value`` over all rows before, in order
    of ``bucket`` and then ``order``."""
    return running_totals(df, order, bucket, {into: value}, by)


def running_totals(df: DataFrame, order: list[str | Column], bucket: Column, values: dict[str, Column], by: list[str] = ()) -> DataFrame:
    """``df`` with a column for each of ``values``: its sum over all rows before,
    in order of ``bucket`` and then ``order``.

    Buckets must follow the order, null before all others; there are so few that their totals are a small
    table, which is cumulated on its own. Rows are cumulated within buckets.
    """
    rows = df.withColumn("_b", F.coalesce(bucket.cast("long"), F.lit(-1 << 62))).withColumns({f"_v_{k}": v for k, v in values.items()})
    keys = [*by, "_b"]
    totals = rows.groupBy(*keys).agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in values])
    line = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(k).alias(f"_k{k}") for k in keys], *[F.coalesce(F.sum(f"_t_{k}").over(line), F.lit(0)).alias(f"_s_{k}") for k in values])
    rows = rows.join(starts, [F.col("_b") == F.col("_k_b"), *[F.col(k).eqNullSafe(F.col(f"_k{k}")) for k in by]])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(*df.columns, *[(F.col(f"_s_{k}") + F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0))).alias(k) for k in values])


def magnitude(x: Column) -> Column:
    """A bucket number that follows the order of a number: FINE buckets an octave
    on either side of zero. No look at the data is needed. NaN comes last, as
    when sorting; null is null."""
    x = x.cast("double")
    # log2 of 0 is null; magnitudes beyond 2^4000 are infinite
    size = F.greatest(F.lit(1), 2000 * FINE + F.floor(F.least(F.log2(F.abs(x)), F.lit(4000.0)) * FINE))
    return F.when(F.isnan(x), 9000 * FINE).otherwise(F.signum(x) * F.when(x != 0, size).otherwise(0)).cast("long")


def ordered_buckets(df: DataFrame, column: str, n: int = BUCKETS) -> Column:
    """A bucket number that follows the ascending order of any sortable column, of
    about equal buckets: approximate quantiles of the number that the value is, or
    of a text's first six bytes. Nulls come first."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType | T.BinaryType):
        key = F.conv(F.rpad(F.hex(F.substring(F.col(column).cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    elif isinstance(kind, T.DateType):
        key = F.unix_date(column).cast("double")
    elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
        key = F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    elif isinstance(kind, T.NumericType | T.BooleanType):
        key = F.col(column).cast("int" if isinstance(kind, T.BooleanType) else "double").cast("double")
    else:
        return F.lit(0)
    cuts = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 4 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    if not cuts:
        return F.lit(0)
    return F.when(key.isNull(), -1).otherwise(_halved(key, cuts, 0, len(cuts)))


def _halved(key: Column, cuts: list[float], low: int, high: int) -> Column:
    """The number of cuts that are not above ``key``, by halving: a few comparisons a row."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(key < F.lit(cuts[middle]), _halved(key, cuts, low, middle)).otherwise(_halved(key, cuts, middle + 1, high))


def ranked(df: DataFrame, order: list[str], into: str, start: int = 0, by: list[str] = ()) -> DataFrame:
    """``df`` with ``into``: the number of the row in ascending order, from ``start``."""
    return numbered(df, order, into, by).withColumn(into, F.col(into) + start)


# --- ordered pairs ------------------------------------------------------------------
def _dominance(group: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each row j the weight of the rows i of its group with a_i < a_j and
    b_i < b_j, by bits of the rank of b: the rows that first differ from j in a
    lower bit are those before it, in order of a, in one sorted run."""
    n = len(group)
    out = np.zeros(n)
    if n < 2:
        return out
    rank = np.unique(b, return_inverse=True)[1].ravel()
    at = np.lexsort((-rank, a, group))  # equal a: falling b, so that they do not count
    group, rank, weight = np.unique(group, return_inverse=True)[1].ravel()[at].astype(np.int64), rank[at].astype(np.int64), w[at]
    for k in range(int(rank.max()).bit_length()):
        run = (group << 32) | (rank >> (k + 1))
        order = np.argsort(run, kind="stable")
        high = (rank[order] >> k) & 1
        low = np.cumsum(np.where(high == 0, weight[order], 0.0))
        starts = np.flatnonzero(np.r_[True, run[order][1:] != run[order][:-1]])
        base = np.repeat(np.r_[0.0, low][starts], np.diff(np.r_[starts, n]))
        out[at[order]] += np.where(high == 1, low - base, 0.0)
    return out


def ordered_pairs(df: DataFrame, by: list[str], a: Column, b: Column, weight: Column) -> DataFrame:
    """by, ``pairs``: the sum of w_i * w_j over the pairs of rows of each group with
    a_i < a_j and b_i < b_j, without listing pairs.

    Both values are cut into ordered buckets of all rows. Pairs within a bucket of
    a, and pairs within a bucket of b whose buckets of a differ, are counted from
    sorted rows; all others from the sums of the grid of buckets. So a group, be it
    a third of all rows, is many small ones. Rows of one group that agree in both
    values are one row from the start, as they make no pair among themselves: values
    that many rows share are few rows. There are about as many buckets as the third
    root of the rows, so that neither a bucket nor the grid of a group grows as fast as the
    rows do. Rows with a null or NaN count nowhere.
    """
    rows = df.select(*by, a.cast("double").alias("_a"), b.cast("double").alias("_b"), weight.cast("double").alias("_w")).filter("_a IS NOT NULL AND _b IS NOT NULL AND _w IS NOT NULL AND NOT isnan(_a) AND NOT isnan(_b)")
    rows = Scratch(df.sparkSession).stored(rows.groupBy(*by, "_a", "_b").agg(F.sum("_w").alias("_w")))  # read by three parts below
    n = min(1024, max(64, round(rows.count() ** (1 / 3))))
    rows = rows.withColumns({"_p": ordered_buckets(rows, "_a", n), "_q": ordered_buckets(rows, "_b", n)})
    names = [f"_g{i}" for i in range(len(by))]
    group = F.xxhash64(*by) if by else F.lit(0).cast("long")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left: list[pd.DataFrame] = []  # the parts of the last run, put together once it is whole

        def done(x: pd.DataFrame) -> pd.DataFrame:
            found = _dominance(x["_run"].to_numpy(), x["_x"].to_numpy(), x["_b"].to_numpy(), x["_w"].to_numpy()) * x["_w"].to_numpy()
            return x.assign(pairs=found).groupby("_run", sort=False).agg({**{c: "first" for c in names}, "pairs": "sum"})[[*names, "pairs"]]

        for x in frames:  # sorted by _run: all but the last run of a frame are whole
            if not len(x):
                continue
            last = x["_run"] == x["_run"].iloc[-1]
            if last.all() and (not left or left[-1]["_run"].iloc[0] == x["_run"].iloc[0]):
                left.append(x)
                continue
            yield done(pd.concat([*left, x[~last]], ignore_index=True))
            left = [x[last]]
        if left:
            yield done(pd.concat(left, ignore_index=True))

    keep = [F.col(c).alias(n) for c, n in zip(by, names, strict=True)]
    fields = "".join(f"{n} {df.schema[c].dataType.simpleString()}, " for c, n in zip(by, names, strict=True))
    within_p = rows.select(*keep, F.xxhash64(group, F.lit(0), "_p").alias("_run"), F.col("_a").alias("_x"), "_b", "_w")
    within_q = rows.select(*keep, F.xxhash64(group, F.lit(1), "_q").alias("_run"), F.col("_p").cast("double").alias("_x"), "_b", "_w")
    grid = rows.groupBy(*by, "_p", "_q").agg(F.sum("_w").alias("_w"))
    cells = grid.select(*keep, F.xxhash64(group, F.lit(2)).alias("_run"), F.col("_p").cast("double").alias("_x"), F.col("_q").cast("double").alias("_b"), "_w")
    parts = within_p.union(within_q).union(cells).repartition("_run").sortWithinPartitions("_run").mapInPandas(count, f"{fields}pairs double")
    return parts.groupBy(*names).agg(F.sum("pairs").alias("pairs")).select(*[F.col(n).alias(c) for c, n in zip(by, names, strict=True)], "pairs")
