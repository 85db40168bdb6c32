"""A keyed bijection of row numbers: every row's place in a shuffle, without a shuffle.

Numbers below ``n`` are pairs of a little more than sqrt(n) by sqrt(n); rounds add a
hash of one half to the other in turn, which can be undone, so pairs are permuted (a
Feistel network). Pairs that stand for no number below n are permuted on until they do.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 6
#: Steps until a number below n is met; each misses with a chance of about 1 / sqrt(n) at most.
WALK = 64


def sides(n: int) -> tuple[int, int]:
    a = math.isqrt(max(n - 1, 0)) + 1
    return a, -(-max(n, 1) // a)


def permuted(index: Column, n: int, seed: int = 0) -> Column:
    """The place of row number ``index`` among ``n`` rows; distinct numbers have
    distinct places. A number outside [0, n) is an error, null stays null."""
    a, b = sides(n)
    index = index.cast("long")

    def step(x: Column) -> Column:
        start = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))

        def mixed(s: Column, i: Column) -> Column:
            left = F.pmod(s["l"] + F.pmod(F.xxhash64(F.lit(seed), i, s["r"]), F.lit(a)), F.lit(a)).cast("long")
            right = F.pmod(s["r"] + F.pmod(F.xxhash64(F.lit(seed), -i, left), F.lit(b)), F.lit(b)).cast("long")
            return F.struct(left.alias("l"), right.alias("r"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, mixed, lambda s: s["l"] * b + s["r"])

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(min(WALK, a * b - n + 1))), step(index), lambda x, _: F.when(x < n, x).otherwise(step(x)))
    wrong = F.raise_error(F.concat(F.lit(f"no place among {n} rows for "), index.cast("string"))).cast("long")
    return F.when(index.isNull(), F.lit(None).cast("long")).when((index < 0) | (index >= n), wrong).otherwise(F.transform(F.array(walked), lambda x: F.when(x < n, x).otherwise(wrong))[0])


def dealt(index: Column, n: int, ranks: int, seed: int = 0) -> Column:
    """struct(rank, row): the worker that gets a row when all rows are shuffled and cut
    into ``ranks`` runs of equal length (the last may be shorter), and its place there."""
    each = -(-n // ranks)
    return F.transform(F.array(permuted(index, n, seed)), lambda p: F.struct(F.floor(p / each).cast("int").alias("rank"), F.pmod(p, F.lit(each)).cast("long").alias("row")))[0]
