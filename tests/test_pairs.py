"""Running totals, ranks and ordered pairs against brute force."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import metrics, prefix, prep, ranking

VALUES = [0.0, -0.0, 1.0, -1.0, 0.3, 0.30000001, 1e-300, -1e-300, 1e300, -1e300, 5e-324, float("inf"), float("-inf"), float("nan"), 2.0, 3.0, 4.0, -2.0, -3.0, 1 / 3]


def test_magnitude_follows_the_order(spark):
    got = spark.createDataFrame([(v,) for v in VALUES] + [(None,)], "v double").select("v", prefix.magnitude(F.col("v")).alias("m")).collect()
    key = lambda v: math.inf if math.isnan(v) else v
    ranked = sorted((r for r in got if r["v"] is not None and not math.isnan(r["v"])), key=lambda r: key(r["v"]))
    assert all(a["m"] <= b["m"] for a, b in itertools.pairwise(ranked))
    assert max(r["m"] for r in ranked) < next(r["m"] for r in got if r["v"] is not None and math.isnan(r["v"]))
    assert [r["m"] for r in got if r["v"] is None] == [None]


@pytest.mark.parametrize("kind, values", [
    ("long", [3, -5, None, 3, 2**40, 0, 7, -5]),
    ("double", [0.5, -1.0, None, 0.5, 3.25, 2.0]),
    ("string", ["b", "a", "", None, "aaaaaaab", "aaaaaaaa", "é", "z"]),
    ("boolean", [True, False, None, True]),
])
def test_ranks_equal_a_sort(spark, kind, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values * 7)], f"i long, v {kind}")
    got = prefix.ranked(df, ["v", "i"], "n", 2).collect()
    key = lambda r: (r["v"] is not None, r["v"].encode() if isinstance(r["v"], str) else r["v"] or 0, r["i"])
    assert [r["n"] for r in sorted(got, key=key)] == list(range(2, 2 + len(got)))


def rows_of(seed, n, groups):
    rng = random.Random(seed)
    return [(rng.randrange(groups) if rng.random() > 0.4 else 0, rng.randrange(12) / 4, rng.randrange(9) / 3, rng.randrange(1, 5) / 2) for _ in range(n)]


@pytest.mark.parametrize("seed, n, groups", [(1, 0, 1), (2, 1, 1), (3, 400, 1), (4, 500, 9), (5, 300, 120)])
def test_ordered_pairs_equal_a_self_join(spark, seed, n, groups):
    rows = rows_of(seed, n, groups)
    df = spark.createDataFrame(rows, "g long, a double, b double, w double").repartition(3)
    got = {r["g"]: r["pairs"] for r in prefix.ordered_pairs(df, ["g"], F.col("a"), F.col("b"), F.col("w")).collect()}
    want: dict = {}
    for x, y in itertools.permutations(rows, 2):
        if x[0] == y[0] and x[1] < y[1] and x[2] < y[2]:
            want[x[0]] = want.get(x[0], 0.0) + x[3] * y[3]
    for g in {r[0] for r in rows}:
        assert got.get(g, 0.0) == pytest.approx(want.get(g, 0.0))


def test_pair_metrics_on_a_hot_group(spark):
    rows = rows_of(9, 600, 40)
    df = spark.createDataFrame(rows, "g long, prediction double, label double, weight double")
    agree = whole = 0.0
    inverted: dict = {}
    for i, j in itertools.combinations(range(len(rows)), 2):
        x, y = rows[i], rows[j]
        if x[0] == y[0]:
            sign = lambda d: (d > 0) - (d < 0)
            whole += x[3] * y[3]
            agree += x[3] * y[3] * (sign(x[1] - y[1]) == sign(x[2] - y[2]))
            inverted[x[0]] = inverted.get(x[0], 0) + ((x[1] - y[1]) * (x[2] - y[2]) < 0)
    assert metrics.concordance(df, "g").first()[0] == pytest.approx(agree / whole)
    for r in metrics.regression_auc(df, ["g"]).collect():
        n = sum(x[0] == r["g"] for x in rows)
        assert r["rauc"] == (None if n < 2 else pytest.approx(1 - inverted.get(r["g"], 0) / (n * (n - 1) / 2)))


def test_area_does_not_depend_on_buckets(spark):
    rng = random.Random(3)
    rows = [(rng.choice([rng.random(), 0.25, 0.5, rng.random() * 1e-9]), float(rng.random() < 0.3), rng.random()) for _ in range(500)]
    got = ranking.auc(spark.createDataFrame(rows, "prediction double, label double, weight double"), []).first()[0]
    num = sum(x[2] * y[2] * (1.0 if x[0] > y[0] else 0.5 if x[0] == y[0] else 0.0) for x in rows if x[1] for y in rows if not y[1])
    assert got == pytest.approx(num / (sum(x[2] for x in rows if x[1]) * sum(y[2] for y in rows if not y[1])))


def test_null_is_a_value_when_encoding(spark):
    df = spark.createDataFrame([(0, None), (1, "b"), (2, None), (3, "a")], "i int, c string")
    got = prep.encoded(df, prep.contiguous_ids(df, "c", ["i"], 1), "c").collect()
    assert sorted((r["i"], r["c"]) for r in got) == [(0, 2), (1, 3), (2, 2), (3, 4)]
    got = prep.dense_index(df, "c", 5).collect()
    assert sorted((r["i"], r["c"]) for r in got) == [(0, 5), (1, 7), (2, 5), (3, 6)]


def test_values_that_most_rows_share_are_few_rows(spark):
    """90 % of the rows agree in both values: the parts that are sorted hold few rows."""
    rows = [(0, 1.0, 2.0, 1.0) if i % 10 else (0, float(i % 70), float(i % 90), 1.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "g long, a double, b double, w double")
    found = prefix.ordered_pairs(df, ["g"], F.col("a"), F.col("b"), F.col("w"))
    got = found.first()["pairs"]
    kept = {}
    for r in rows:
        kept[r[1:3]] = kept.get(r[1:3], 0) + 1
    assert got == sum(m * n for (a, b), m in kept.items() for (c, d), n in kept.items() if a < c and b < d)
    written = {f.rsplit("/", 1)[0] for f in found.inputFiles()}
    assert {spark.read.parquet(f).count() for f in written} == {len(kept)} and len(kept) < len(rows) / 5


@pytest.mark.parametrize("n", [0, 1, 2, 5, 63, 255])
def test_halving_counts_cuts(spark, n):
    rng = random.Random(n)
    cuts = sorted(rng.sample(range(500), n))
    got = spark.range(-1, 501).select("id", prefix._halved(F.col("id").cast("double"), [float(c) for c in cuts], 0, n).alias("b")).collect()
    assert all(r["b"] == sum(c <= r["id"] for c in cuts) for r in got)
