"""Attention expressions, flat pools and dealt queries against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon import queries
from quillon.functions import attention
from quillon.operators import jagged

SF = "/root/testdata/sf0.001"


def slow_layer(x, layer, heads):
    q, k, v = (x @ np.array(w).T for w in (layer.query, layer.key, layer.value))
    size, out = x.shape[1] // heads, []
    for i in range(len(x)):
        parts = []
        for h in range(heads):
            s = slice(h * size, (h + 1) * size)
            e = np.exp(np.array([q[i, s] @ k[j, s] / math.sqrt(size) for j in range(len(x))]))
            parts.append((e / e.sum()) @ v[:, s])
        out.append(np.concatenate(parts) @ np.array(layer.out).T)
    norm = lambda u: (u - u.mean()) / math.sqrt(u.var() + 1e-5)
    mixed = [norm(a + b) for a, b in zip(x, out, strict=True)]
    return np.array([norm(u + np.maximum(u @ np.array(layer.inner).T, 0) @ np.array(layer.outer).T) for u in mixed])


@pytest.mark.parametrize("heads, layers", [(1, 1), (2, 2), (4, 1)])
def test_attention_equals_numpy(spark, heads, layers):
    rng = np.random.default_rng(heads)
    x = rng.normal(size=(5, 3, 8))
    made = [attention.seeded_layer(8, 12, i) for i in range(layers)]
    got = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, x array<array<double>>").withColumn("y", F.col("x"))
    got = attention.encoded(got, "y", made, heads).orderBy("i")
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    for r, own in zip(got.collect(), x, strict=True):
        for layer in made:
            own = slow_layer(own, layer, heads)
        assert np.allclose(r["y"], own)
    with pytest.raises(ValueError, match="divide"):
        attention.attended(F.col("x"), made[0], 3)


@pytest.mark.parametrize("step", [attention.normed, attention.softmax, lambda c: attention._plain(c, [[1.0, 2.0], [3.0, 4.0]]), lambda c: attention.attended(F.array(c), attention.seeded_layer(2, 3, 0), 1)])
def test_what_goes_into_a_step_is_evaluated_once(spark, step):
    got = spark.createDataFrame([([1.0, 2.0],)], "x array<double>").select(step(F.reverse("x")).alias("y"))
    assert got._jdf.queryExecution().analyzed().toString().count("reverse(") == 1


def test_vectors_of_another_length_or_null_give_nulls(spark):
    rows = spark.createDataFrame([([1.0, 2.0],), ([1.0],), ([1.0, 2.0, 3.0],), (None,), ([1.0, None],)], "x array<double>")
    got = [r[0] for r in rows.select(attention._plain(F.col("x"), [[1.0, 2.0], [3.0, 4.0]])).collect()]
    assert got == [[5.0, 11.0]] + [[None, None]] * 4


def test_attention_query_covers_whole_vectors(spark):
    got = {r["vec_id"]: [float(x) for x in r["features"].split(",")] for r in queries.attention_interaction(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/embeddings.parquet").limit(20).collect():
        x = np.array(r["embedding"], dtype=np.float64).reshape(8, 8)
        for i in range(2):
            x = slow_layer(x, attention.seeded_layer(8, 16, i), 2)
        assert np.allclose(got[r["vec_id"]], x.ravel(), atol=1e-5)


@pytest.mark.parametrize("width", [1, 4, 7, 4096])
def test_flat_pools_give_bags_back(spark, width):
    rng = random.Random(width)
    bags = {i: [rng.randrange(100) for _ in range(rng.choice([0, 1, 3, 9, 20]))] for i in rng.sample(range(60), 30)}
    df = spark.createDataFrame([*bags.items(), (99, None), (None, [1])], "id long, values array<long>").repartition(3)
    index, blocks = jagged.flat_pool(df, width)
    assert blocks.agg(F.max(F.size("values"))).first()[0] <= width
    asked = [(n, rng.randrange(70)) for n in range(80)] + [(100, 99), (101, None)]
    got = jagged.flat_select(index, blocks, spark.createDataFrame(asked, "n long, id long"), width).collect()
    assert sorted((r["n"], r["values"]) for r in got) == sorted((n, bags.get(i, [])) for n, i in asked)


def test_dealt_events_have_places_of_their_own(spark):
    got = queries.rank_deal(spark, SF).collect()
    assert len({(r["rank"], r["row"]) for r in got}) == len(got) and {r["rank"] for r in got} == set(range(8))


def test_chain_of_intervals_equals_a_slow_table(spark):
    from test_ordered import Slow

    events = sorted((r["event_id"], r["user_id"]) for r in spark.read.parquet(f"{SF}/events.parquet").collect())
    slow, ends = Slow(40, "distance_lfu"), events[-1][0] + 1
    for now in range(10):
        ids = [u for e, u in events if e * 10 // ends == now]
        slow.update({u: ids.count(u) for u in ids}, now)
    assert {r["id"]: (r["slot"], r["count"], r["last"]) for r in queries.remap_chain(spark, SF).collect()} == slow.entries


def test_registered_placements_equal_slow_tables(spark):
    from test_placement import slow

    from quillon.operators import remap, transformers

    rows = [(r["id"], r["hour"], r["event_id"]) for r in queries._event_hours(spark, SF).collect()]
    seen = {i for i, _, _ in rows}
    got = sorted(map(tuple, queries.multi_probe_oldest(spark, SF).collect()))
    buckets = max(1, round(max(r[2] for r in got) / 16 + 0.5))
    for n in range(max(1, buckets - 1), buckets + 4):  # the number of buckets is an estimate
        bucket, home = remap.probe_home(F.col("id"), n, 16)
        homes = {r[0]: (r[1], r[2]) for r in spark.createDataFrame([(i,) for i in seen], "id long").select("id", bucket, home).collect()}
        if got == slow(homes, [(h, i) for i, h, _ in rows], 16, 8, 24, "oldest"):
            break
    else:
        raise AssertionError("no number of buckets gives these places")
    placed = {r["event_id"]: r["slot"] for r in queries.line_placement(spark, SF).collect()}
    assert set(placed) == {e for _, _, e in rows}
    by_id = {i: {placed[e] for j, _, e in rows if j == i} for i in seen}
    held = [next(iter(s)) for s in by_id.values() if s != {None}]
    assert all(len(s) == 1 for s in by_id.values()) and len(held) == len(set(held)) and transformers.TIME_BITS
