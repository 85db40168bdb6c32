"""Sequence model, quantized retrieval, slots with records, pools, click logs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon import queries
from quillon.operators import lookup, models, prep, remap, retrieval, transformers
from quillon.sources import readers

SF = "/root/testdata/sf0.001"


def slow_norm(v, gain, bias):
    return (v - v.mean()) / math.sqrt(v.var() + 1e-5) * gain + bias


def slow_state(m, vectors):
    """The model place by place, head by head; None is a place without item."""
    x = np.array([m.padding if v is None else v for v in vectors]) + m.places
    x = list(slow_norm(x, m.gain, m.bias))
    for b in m.blocks:
        z = [slow_norm(v, *b.norms[0]) for v in x]
        q, k, v = ([u @ b.projections[w][0] + b.projections[w][1] for u in z] for w in ("query", "key", "value"))
        size = len(q[0]) // m.heads
        out = []
        for i in range(len(vectors)):
            heads = []
            for h in range(m.heads):
                part = slice(h * size, (h + 1) * size)
                s = [-1e9 if vectors[j] is None else float(q[i][part] @ k[j][part]) / math.sqrt(size) for j in range(len(vectors))]
                e = [math.exp(t - max(s)) for t in s]
                heads.append(sum((t / sum(e)) * v[j][part] for j, t in enumerate(e)))
            out.append(x[i] + np.concatenate(heads) @ b.projections["out"][0] + b.projections["out"][1])
        x = [u + np.maximum(slow_norm(u, *b.norms[1]) @ b.inner[0] + b.inner[1], 0) @ b.outer[0] + b.outer[1] for u in out]
    return x[-1]


@pytest.fixture
def items(spark):
    rng = np.random.default_rng(9)
    x = {i: rng.normal(0, 1, 8) for i in range(1, 40)}
    return x, spark.createDataFrame([(i, v.tolist(), 0.01 * i) for i, v in x.items()] + [(None, [0.0] * 8, 0.0), (50, None, 0.0)], "id long, vec array<double>, bias double")


def test_next_items_equal_a_slow_model(spark, items):
    x, known = items
    m = models.SequenceModel.seeded(6, 8, layers=2, seed=4)
    seqs = {1: [3, 4, 5], 2: list(range(1, 12)), 3: [29, 99, None, 2], 4: [7], 5: [], 6: None, 7: [7, 50], 8: [3, 3, 3, 3, 3, 3, 3]}
    given = spark.createDataFrame([(u, s, "x") for u, s in seqs.items()], "u long, items array<int>, vec string")
    got = models.next_items(given, "u", "items", known, known, m, 3).toPandas()
    assert len(got) == 3 * len(seqs)
    for u, s in seqs.items():
        last = [x.get(i) for i in (s or [])[-6:]]
        state = slow_state(m, [None] * (6 - len(last)) + last)
        want = {i: float(v @ state) + 0.01 * i for i, v in x.items()}
        best = sorted(want, key=lambda i: (-want[i], i))[:3]
        own = got[got.u == u].sort_values("rank")
        assert own["item"].tolist() == best and own["score"].tolist() == pytest.approx([want[i] for i in best])


def test_windows_of_a_repeated_user(spark, items):
    x, known = items
    m = models.SequenceModel.seeded(4, 8, layers=1, seed=1)
    given = spark.createDataFrame([(1, [1, 2]), (1, [1, 2]), (1, [3])], "u long, items array<long>")
    got = models.states(given, "u", "items", known, m).collect()
    want = sorted(slow_state(m, [None] * (4 - len(s)) + [x[i] for i in s]).tolist() for s in ([1, 2], [3]))
    assert np.allclose(sorted(r["state"] for r in got), want)
    assert models.best_items(models.states(given, "u", "items", known, m), "u", known, 2).count() == 2
    assert models.next_items(given.limit(0), "u", "items", known, known, m).count() == 0
    assert models.next_items(given, "u", "items", known.limit(0), known.limit(0), m).count() == 0


def test_best_items_do_not_depend_on_blocks(spark):
    """Ties go to the smaller item, in a block and across blocks."""
    rng = np.random.default_rng(2)
    vectors = rng.integers(-2, 3, (300, 3)).astype(float)
    out = spark.createDataFrame([(i, v.tolist(), 0.0) for i, v in enumerate(vectors)], "id long, vec array<double>, bias double").repartition(3)
    of = rng.integers(-2, 3, (50, 3)).astype(float)
    given = spark.createDataFrame([(f"u{i}", v.tolist()) for i, v in enumerate(of)], "u string, state array<double>")
    for n_states, n_items in ((1024, 4096), (20, 100)):
        got = models.best_items(given, "u", out, 5, n_states, n_items).collect()
        want = {(f"u{i}", r + 1, j, float(vectors[j] @ s)) for i, s in enumerate(of) for r, j in enumerate(sorted(range(300), key=lambda j: (-float(vectors[j] @ s), j))[:5])}
        assert {tuple(r) for r in got} == want


def test_quantized_retrieval_finds_neighbours(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 4, (40, 16))
    x = centres[rng.integers(0, 40, 3000)] + rng.normal(0, 0.6, (3000, 16))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(None, [0.0] * 16), (5000, None)], "id long, vec array<double>").repartition(4)
    index = retrieval.fitted(v, cells=20, parts=16, bits=6, sample=1500)
    codes = retrieval.encoded(v, index)
    assert codes.count() == 3000
    got = retrieval.searched(v.filter("id % 100 = 0"), codes, index, 10, probes=6, chunk=200).toPandas()
    again = retrieval.searched(v.filter("id % 100 = 0"), codes, index, 10, probes=6, chunk=10_000).toPandas()
    key = lambda d: sorted(zip(d["query"], d["rank"], d["id"], strict=True))
    assert key(got) == key(again)
    found = 0
    for q in range(0, 3000, 100):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        found += len(set(np.argsort(d)[:10]) & set(got[got["query"] == q]["id"]))
    assert found / 300 > 0.6


def test_records_pack_power_and_time(spark):
    got = spark.createDataFrame([(7, 123), (31, (1 << 27) + 5)], "p int, t long").select(transformers.record(F.col("p"), F.col("t")).alias("r")).select("r", transformers.power_of(F.col("r")), transformers.time_of(F.col("r"))).collect()
    assert [(r[1], r[2]) for r in got] == [(7, 123), (31, 5)] and got[0][0] == 7 << 27 | 123


def test_power_grows_with_the_logarithm_of_uses(spark):
    df = spark.range(2000).select("id", transformers.touched(F.lit(None).cast("long"), F.col("id"), F.lit(1), 1).alias("a"), transformers.touched(F.lit(None).cast("long"), F.col("id"), F.lit(1), 400).alias("b"))
    a, b = df.agg(F.min(transformers.power_of(F.col("a"))) + F.max(transformers.power_of(F.col("a"))), F.avg(transformers.power_of(F.col("b")))).first()
    assert a == 10 and 7.5 < b < 9.5


def test_slots_fill_fail_and_come_back(spark):
    state = spark.createDataFrame([], transformers.STATE)
    ids = spark.createDataFrame([(i, at) for at, i in enumerate([30, 10, 30, 20])], "id long, at long")
    done, state = transformers.transformed(state, ids, 4, 1, "at")
    assert sorted(map(tuple, done.select("at", "slot").collect())) == [(0, 0), (1, 1), (2, 0), (3, 2)]
    state = spark.createDataFrame(state.collect(), transformers.STATE)
    more = spark.createDataFrame([(i, at) for at, i in enumerate([10, 50, 60, 70])], "id long, at long")
    done, full = transformers.transformed(state, more, 4, 2, "at")
    assert sorted((r["id"], r["slot"]) for r in done.collect() if r["slot"] is not None) == [(10, 1), (50, 3)]
    assert full.count() == 4
    done, after, gone = transformers.transformed_or_evicted(state, more, 4, 2, "at", share=1.0)
    assert {r["id"] for r in gone.collect()} == {20, 30}
    assert sorted((r["id"], r["slot"]) for r in done.collect()) == [(10, 1), (50, 0), (60, 2), (70, 3)]
    assert sorted(r["slot"] for r in after.collect()) == [0, 1, 2, 3]


def test_policies_and_rules_can_be_functions(spark):
    state = spark.createDataFrame([(1, 0, 5, 0), (2, 1, 9, 0)], "id long, slot long, count long, last int")
    batch = spark.createDataFrame([(3, 1), (4, 2)], "id long, count long")
    got = remap.updated(state, batch, 3, lambda now, decay: F.col("id").cast("double"))
    assert {r["id"] for r in got.collect()} == {3, 4}
    assert {r["id"] for r in remap.admitted(batch, lambda c: c.filter("id = 4")).collect()} == {4}
    with pytest.raises(ValueError, match="no policy"):
        remap.updated(state, batch, 3, "none")


def test_multi_probe_equals_a_plain_table(spark):
    got = sorted(map(tuple, queries.multi_probe_remap(spark, SF).collect()))
    hours = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000)
    h = F.xxhash64(F.lit(3), "id")
    seen = spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").alias("id"), hours.alias("hour")).distinct()
    seen = seen.select("id", "hour", F.pmod(h, F.lit(4)).alias("bucket"), F.pmod(F.shiftright(h, 20), F.lit(16)).alias("home")).collect()
    table, want = {}, []
    for r in sorted(seen, key=lambda r: (r["bucket"], r["hour"], r["id"])):
        places = [r["bucket"] * 16 + (r["home"] + j) % 16 for j in range(8)]
        held = [p for p in places if p in table and table[p][0] == r["id"]]
        empty = [p for p in places if p not in table]
        old = [p for p in places if p in table and table[p][1] < r["hour"]]
        at, kind = (held[0], "hit") if held else (empty[0], "inserted") if empty else (old[0], "evicted") if old else (places[0], "collided")
        if kind != "collided":
            table[at] = (r["id"], r["hour"] + 24)
        want.append((r["id"], r["hour"], at, kind))
    assert got == sorted(want)


def test_negatives_of_the_query_are_unseen_and_complete(spark):
    got = queries.negative_samples(spark, SF).groupBy("u").agg(F.collect_set("item").alias("items"), F.count("item").alias("n")).collect()
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").groupBy("l_suppkey").agg(F.collect_set("l_partkey").alias("seen"))
    seen = {r["l_suppkey"]: set(r["seen"]) for r in lines.collect()}
    universe = set().union(*seen.values())
    assert {r["u"] for r in got} == {u for u, s in seen.items() if universe - s}
    for r in got:
        assert r["n"] == len(set(r["items"])) == min(5, len(universe - seen[r["u"]])) and not set(r["items"]) & seen[r["u"]]


def test_planned_tables_fit_and_are_whole(spark):
    got = queries.plan_tables(spark, SF).collect()
    shards: dict = {}
    for r in got:
        shards.setdefault((r["table"], r["sharding"], r["kernel"]), set()).add(r["shard"])
        assert 0 <= r["rank"] < queries.TOPOLOGY.world
    assert len(shards) == 25 and all(s == set(range(len(s))) for s in shards.values())


def test_random_examples_keep_their_bounds(spark):
    df = queries.random_examples(spark, SF)
    rows = df.collect()
    assert len(rows) == 1000 and rows == queries.random_examples(spark, SF).collect()
    assert all(len(r["f1"]) == 3 and all(0 <= x < 100 for x in r["f1"]) and len(r["f2"]) == 5 and all(0 <= x < 1000 for x in r["f2"]) for r in rows)
    for c, mean, spread in (("dense_0", 0, 1), ("dense_1", 0, 1), ("label", 0.5, 0.5)):
        xs = np.array([r[c] for r in rows], dtype=float)
        assert abs(xs.mean() - mean) < 0.12 and abs(xs.std() - spread) < 0.12


def test_jagged_pool_checks_its_updates(spark):
    pool = spark.createDataFrame([(0, [1], ["x"]), (1, [], None)], "id long, a array<int>, b array<string>")
    updates = spark.createDataFrame([(["p"], [5, 6], 1, 1), (["q"], [7], 1, 2), ([], [8], 3, 1)], "b array<string>, a array<int>, id long, at int")
    got = lookup.keyed_pool_update(pool, updates, "at", {"a": 2, "b": 1})
    assert sorted(map(tuple, got.collect())) == [(0, [1], ["x"]), (1, [7], ["q"]), (3, [8], [])]
    ids = spark.createDataFrame([(3,), (1,), (2,), (1,)], "id long")
    assert sorted(map(tuple, lookup.keyed_pool_lookup(got, ids, 4, ["b", "a"]).select("id", "b", "a").collect())) == [(1, ["q"], [7]), (1, ["q"], [7]), (2, [], []), (3, [], [8])]
    with pytest.raises(Exception, match="longer than 1"):
        lookup.keyed_pool_update(pool, updates, "at", {"a": 1, "b": 1}).collect()
    with pytest.raises(Exception, match="outside the pool"):
        lookup.keyed_pool_lookup(got, ids, 3, ["a"]).collect()


def click_lines(rng, n, labelled=True):
    out = []
    for _ in range(n):
        label = [str(rng.randrange(2))] if labelled else []
        out.append("\t".join([*label, *(rng.choice(["", "7", "-3", "x"]) for _ in range(13)), *(rng.choice(["", f"{rng.randrange(16**8):08x}", "zz"]) for _ in range(26))]))
    return out


def test_click_logs_are_read_as_written(spark, tmp_path):
    rng = random.Random(1)
    lines = click_lines(rng, 30)
    for i in range(3):
        (tmp_path / f"day_{i}").write_text("\n".join(lines[10 * i:10 * i + 10]) + "\n")
    number = lambda s: int(s) if s.lstrip("-").isdigit() else 0
    hexed = lambda s: int(s, 16) if s and all(c in "0123456789abcdef" for c in s) else 0
    want = sorted(tuple([int(f[0]), *map(number, f[1:14]), *map(hexed, f[14:])]) for f in (x.split("\t") for x in lines))
    got = readers.click_log(spark, [str(tmp_path / f"day_{i}") for i in range(3)], hashed=True)
    assert sorted(tuple(r)[:-1] for r in got.collect()) == want
    text = readers.click_log(spark, str(tmp_path / "day_0")).select("cat_0", "int_0").collect()
    assert sorted(map(tuple, text)) == sorted((x.split("\t")[14], number(x.split("\t")[1])) for x in lines[:10])
    (tmp_path / "test").write_text("\n".join(click_lines(rng, 5, labelled=False)) + "\n")
    assert {r["label"] for r in readers.click_log(spark, str(tmp_path / "test"), labelled=False).collect()} == {-1}


def test_last_day_is_cut_into_halves(spark, tmp_path):
    rng = random.Random(2)
    for i, n in enumerate((4, 6, 7)):
        (tmp_path / f"day_{i}").write_text("\n".join(click_lines(rng, n)) + "\n")
    got = readers.click_days(spark, [str(tmp_path / f"day_{i}") for i in range(3)])
    assert {(r["day"], r["stage"]): r["count"] for r in got.groupBy("day", "stage").count().collect()} == {(0, "train"): 4, (1, "train"): 6, (2, "val"): 4, (2, "test"): 3}


def test_ratings_are_read_and_joined(spark, tmp_path):
    (tmp_path / "ratings.csv").write_text("userId,movieId,rating,timestamp\n1,10,4.5,100\n2,20,3.0,200\n")
    (tmp_path / "movies.csv").write_text('movieId,title,genres\n10,"A, B (1990)",X|Y\n20,C,Z\n')
    assert sorted(map(tuple, readers.ratings(spark, str(tmp_path)).collect())) == [(1, 10, 4.5, 100), (2, 20, 3.0, 200)]
    got = readers.ratings(spark, str(tmp_path), movies=True)
    assert sorted((r["userId"], r["title"], r["genres"]) for r in got.collect()) == [(1, "A, B (1990)", "X|Y"), (2, "C", "Z")]


def test_copies_of_windows_are_masked_differently(spark):
    df = spark.createDataFrame([(1, list(range(1, 60)))], "u long, items array<int>")
    got = prep.masked_windows(df, "u", F.col("items"), 20, 0.4, -1, 100, copies=3, seed=1).collect()
    one = prep.masked_windows(df, "u", F.col("items"), 20, 0.4, -1, 100, seed=1).collect()
    assert len(got) == 3 * len(one) and sorted(r["tokens"] for r in got if r["copy"] == 0) == sorted(r["tokens"] for r in one)
    assert len({tuple(r["tokens"]) for r in got if r["start"] == 0}) == 3


def test_first_vectors_are_bounded_and_seeded(spark):
    from quillon.functions import expressions as X

    got = [r[0] for r in spark.range(50).select(X.seeded_vector(F.col("id"), 8, -0.5, 0.5)).collect()]
    assert got == [r[0] for r in spark.range(50).repartition(3).sort("id").select(X.seeded_vector(F.col("id"), 8, -0.5, 0.5)).collect()]
    assert all(-0.5 <= x < 0.5 for v in got for x in v) and len({tuple(v) for v in got}) == 50
