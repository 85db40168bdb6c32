"""Packed rows against numpy, and the keyed bijection of row numbers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import packed, permutation
from quillon.operators import lookup

EDGES = [0.0, -0.0, 1.0, -1.0, 2.0**-24, 2.0**-25, 3 * 2.0**-25, 6e-8, 6.1e-5, 6.103515625e-05, 65504.0, 65519.9, 65520.0, 1e6, -1e9, 0.1, 1 / 3, 1023.5, 2047.5, 2048.5, 2049.5, 4.0, 8.0, 1e-9]


def test_half_numbers_are_those_of_numpy(spark):
    rng = random.Random(1)
    xs = EDGES + [rng.uniform(-1, 1) * 10 ** rng.randrange(-9, 6) for _ in range(3000)] + [2.0**k for k in range(-26, 17)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", packed.half_bits(F.col("x")).alias("b")).select("x", "b", packed.half_value(F.col("b")).alias("v")).collect()
    with np.errstate(over="ignore"):
        for r in got:
            want = np.float16(r["x"])
            assert r["b"] % 0x8000 == int(want.view(np.uint16)) % 0x8000 and (r["v"] == float(want))


def slow_row(v, bits):
    """A row by numpy, in 32-bit arithmetic."""
    v = np.array(v, dtype=np.float32)
    bias = np.float16(v.min())
    width = v.max() - np.float32(bias)
    scale = np.float16(np.float32(1.0) if width == 0 else width / np.float32(2**bits - 1))
    scale = np.float16(1.0) if scale == 0 else scale
    inverse = np.float32(1.0) / np.float32(scale)
    code = np.clip(np.rint((v - np.float32(bias)) * inverse), 0, 2**bits - 1).astype(int)
    per = 8 // bits
    body = bytes(sum(int(c) << (j * bits) for j, c in enumerate(code[k:k + per])) for k in range(0, len(code), per))
    return body + scale.tobytes() + bias.tobytes(), code * float(scale) + float(bias)


@pytest.mark.parametrize("bits, dim", [(2, 8), (2, 5), (4, 8), (4, 7), (8, 6)])
def test_packed_rows_are_those_of_numpy(spark, bits, dim):
    rng = random.Random(bits * dim)
    rows = [[rng.uniform(-1, 1) * 10 ** rng.randrange(-4, 4) for _ in range(dim)] for _ in range(60)] + [[0.0] * dim, [7.25] * dim, [1e-9 * k for k in range(dim)], [-(2.0**k) for k in range(dim)]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)] + [(-1, None), (-2, [])], "id long, vec array<float>")
    table = lookup.packed_table(df, bits)
    got = {r["id"]: r for r in table.withColumn("vec", packed.unpacked(F.col("row"), dim, bits)).collect()}
    for i, r in enumerate(rows):
        row, vec = slow_row(r, bits)
        assert bytes(got[i]["row"]) == row and got[i]["vec"] == pytest.approx(list(vec), rel=1e-12, abs=1e-12)
    assert got[-1]["row"] is None and got[-2]["row"] is None and len(got[0]["row"]) == -(-dim * bits // 8) + 4


@pytest.mark.parametrize("bits", [2, 4, 8, 16, 32])
def test_lookups_over_packed_rows_equal_lookups_of_what_they_hold(spark, bits):
    rng = random.Random(bits)
    table = spark.createDataFrame([(i, [rng.uniform(-2, 2) for _ in range(6)]) for i in range(9)], "id long, vec array<float>")
    long = spark.createDataFrame([(r, "k", p, rng.randrange(12), 0.5 + p) for r in range(7) for p in range(r)], "row int, key string, pos int, id long, weight double")
    small = lookup.packed_table(table, bits, rows=8)
    plain = lookup.unpacked_table(small, 6, bits)
    assert small.count() == 8
    as_rows = lambda d, c: sorted((r["row"], np.round(np.array(r[c], dtype=float), 6).tolist()) for r in d.collect())
    for mode in ("sum", "mean"):
        assert as_rows(lookup.packed_pooled(long, small, 6, bits, mode), "vec") == as_rows(lookup.pooled(long, plain, mode, 6), "vec")
    assert as_rows(lookup.packed_sequence(long, small, 6, bits), "vecs") == as_rows(lookup.sequence_lookup(long, plain), "vecs")


@pytest.mark.parametrize("n", [1, 2, 3, 10, 17, 1000, 4099])
def test_every_row_has_a_place_of_its_own(spark, n):
    places = [{r[0]: r[1] for r in spark.range(n).select("id", permutation.permuted(F.col("id"), n, seed)).collect()} for seed in (1, 1, 2)]
    assert sorted(places[0].values()) == list(range(n)) == sorted(places[2].values()) and places[0] == places[1]
    if n >= 1000:
        order = np.array([places[0][i] for i in range(n)])
        assert places[0] != places[2] and abs(np.corrcoef(np.arange(n), order)[0, 1]) < 0.1 and abs(np.corrcoef(order[1:], order[:-1])[0, 1]) < 0.1


def test_ranks_are_even_and_nothing_is_shuffled(spark):
    df = spark.range(1003).select("id", permutation.dealt(F.col("id"), 1003, 4, 3).alias("at"))
    got = df.groupBy("at.rank").agg(F.count("at.row"), F.count_distinct("at.row"), F.max("at.row")).collect()
    assert sorted(map(tuple, got)) == [(0, 251, 251, 250), (1, 251, 251, 250), (2, 251, 251, 250), (3, 250, 250, 249)]
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert spark.sql("SELECT CAST(NULL AS BIGINT) AS i").select(permutation.permuted(F.col("i"), 5)).first()[0] is None
    with pytest.raises(Exception, match="no place among 5 rows"):
        spark.range(6).select(permutation.permuted(F.col("id"), 5)).collect()
