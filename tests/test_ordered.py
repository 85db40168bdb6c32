"""Numbers in a total order, bounded heaps, and chains of remapping intervals, against brute force."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.operators import ordered, remap, transformers


@pytest.mark.parametrize("seed, n, same", [(1, 0, 0.0), (2, 1, 0.0), (3, 500, 0.3), (4, 800, 0.95)])
def test_numbers_equal_a_sort(spark, seed, n, same):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, "a", "b"]), None if rng.random() < 0.05 else 7 if rng.random() < same else rng.randrange(-50, 50), rng.randrange(5)) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, g string, v long, w int").repartition(3)
    got = {r["id"]: (r["n"], r["s"]) for r in ordered.numbered(df, [F.desc_nulls_last("v"), "id"], "n", ["g"], {"s": F.col("w")}).collect()}
    want, at = {}, {}
    for i, g, _, w in sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0])):
        k, s = at.get(g, (0, 0))
        want[i], at[g] = (k, s), (k + 1, s + w)
    assert got == want


def test_ties_do_not_make_one_task_of_all_rows(spark):
    df = spark.range(20000).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(1).alias("v"))
    placed = df.repartitionByRange(8, "v", "id").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in placed) < 20000 / 4  # 90 % of the values are equal
    got = ordered.numbered(df, ["v", "id"], "n").filter("v = 1").agg(F.min("n"), F.max("n")).first()
    assert tuple(got) == (1, 18000)  # 0 is before them


@pytest.mark.parametrize("n", [0, 1, 7, 300, 5000])
def test_first_rows_of_a_heap(spark, n):
    rng = random.Random(n)
    rows = [(i, None if rng.random() < 0.02 else 3 if rng.random() < 0.8 else rng.randrange(-9, 9)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, v int").repartition(5)
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))[:n]
    assert sorted(map(tuple, ordered.n_smallest(df, ["v", "id"], n).collect()), key=str) == sorted(want, key=str)


def test_a_heap_holds_a_bounded_number_of_rows(monkeypatch):
    most = []
    first_rows = ordered.first_rows
    monkeypatch.setattr(ordered, "first_rows", lambda t, *a: most.append(t.num_rows) or first_rows(t, *a))
    frames = (pa.RecordBatch.from_pydict({"v": [5] * 1000, "id": list(range(k * 1000, k * 1000 + 1000))}) for k in reversed(range(50)))
    got = pa.Table.from_batches(list(ordered._bounded(frames, ["v", "id"], 10)))
    assert sorted(got["id"].to_pylist()) == list(range(10)) and max(most) <= 2 * 10 + 4096 + 1000


def test_least_used_is_the_head_of_a_sort(spark):
    rng = random.Random(5)
    rows = [(i, i, 9 if rng.random() < 0.9 else rng.randrange(20)) for i in range(700)]
    got = transformers.least_used(spark.createDataFrame(rows, transformers.STATE).repartition(4), 123).collect()
    assert sorted(r["id"] for r in got) == sorted(i for i, _, _ in sorted(rows, key=lambda r: (r[2], r[0]))[:123])


class Slow:
    """A table of slots by lists: the best stay, newcomers take the free slots in order."""

    def __init__(self, size, policy):
        self.size, self.policy, self.entries = size, policy, {}

    def update(self, counts, now):
        new = dict(self.entries)
        for i, n in counts.items():
            slot, c, _ = new.get(i, (None, 0, 0))
            new[i] = (slot, c + n, now)
        score = {"lfu": lambda e: e[1], "lru": lambda e: e[2], "distance_lfu": lambda e: e[1] / (now - e[2] + 1)}[self.policy]
        best = sorted(new, key=lambda i: (-score(new[i]), new[i][0] is None, new[i][0] or 0, i))[:self.size - 1]
        free = iter(sorted(set(range(self.size - 1)) - {new[i][0] for i in best}))
        self.entries = {i: (new[i][0] if new[i][0] is not None else next(free), *new[i][1:]) for i in best}


@pytest.mark.parametrize("policy", ["lfu", "lru", "distance_lfu"])
def test_ten_intervals_equal_a_slow_table(spark, policy):
    rng = random.Random(policy)
    mapper, slow, begun, plans = remap.Remapper(spark, 12, policy), Slow(12, policy), time.monotonic(), []
    for now in range(10):
        ids = [rng.randrange(25) if rng.random() < 0.7 else now for _ in range(30)]
        state = mapper.update(spark.createDataFrame([(i,) for i in ids], "id long"), now)
        slow.update({i: ids.count(i) for i in ids}, now)
        plans.append(len(state._jdf.queryExecution().analyzed().toString().splitlines()))
        assert {r["id"]: (r["slot"], r["count"], r["last"]) for r in state.collect()} == slow.entries
    assert len(set(plans)) == 1 and time.monotonic() - begun < 60
    found = {r["id"]: r["slot"] for r in mapper.lookup(spark.range(30)).collect()}
    assert found == {i: slow.entries[i][0] if i in slow.entries else 11 for i in range(30)}


def test_plans_of_chained_updates_do_not_grow(spark):
    state, sizes = spark.createDataFrame([], "id long, slot long, count long, last int"), []
    for now in range(6):
        state = remap.updated(state, spark.range(now, now + 9).select("id", F.lit(1).cast("long").alias("count")), 6, "lru", now)
        sizes.append(len(state._jdf.queryExecution().analyzed().toString().splitlines()))
    assert len(set(sizes)) == 1 and {r["id"] for r in state.collect()} == {5, 6, 7, 8, 9}


def test_tables_with_states_of_their_own(spark):
    rng = random.Random(8)
    mapper, slow = remap.Remapper(spark, 6, "lfu", by=["t"]), {t: Slow(6, "lfu") for t in "abc"}
    for now in range(3):
        ids = [(rng.choice("aaaab" if now < 2 else "abc"), rng.randrange(9)) for _ in range(40)]
        mapper.update(spark.createDataFrame(ids, "t string, id long"), now)
        for t in slow:
            mine = [i for x, i in ids if x == t]
            slow[t].update({i: mine.count(i) for i in mine}, now)
    got = {(r["t"], r["id"]): (r["slot"], r["count"], r["last"]) for r in mapper.state.collect()}
    assert got == {(t, i): e for t, s in slow.items() for i, e in s.entries.items()}


def test_free_slots_are_the_gaps(spark, monkeypatch):
    monkeypatch.setattr(remap, "SLOT_BLOCK", 4)
    used = spark.createDataFrame([(s,) for s in (0, 1, 5, 6, 7, 4, 9)], "slot long")
    got = {r["_k"]: r["slot"] for r in remap.free_slots(used, 11).collect()}
    assert got == {0: 2, 1: 3, 2: 8, 3: 10}
    assert remap.free_slots(used, 0).count() == 0
