"""Stores by bucket and version, and metric state in a stream."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import metrics, ranking
from quillon.sources.store import ParameterStore, Store, storing
from quillon.streaming import streams
from quillon.streaming.metric_state import MetricState


def test_store_equals_a_dictionary(spark, tmp_path):
    rng, store, want = random.Random(1), Store(spark, str(tmp_path / "s"), "id long, x double, y string", ["id"], 5), {}
    assert store.read().count() == 0 and store.fetch(spark.range(2)).collect() == [(0, None, None), (1, None, None)]
    for epoch in range(6):
        if epoch % 3 == 2:
            gone = rng.sample(range(40), 12)
            store.remove(spark.createDataFrame([(i,) for i in gone], "id long"), epoch)
            want = {i: v for i, v in want.items() if i not in gone}
        else:
            rows = [(rng.randrange(40), rng.random(), rng.choice("ab"), n) for n in range(25)]
            store.put(spark.createDataFrame(rows, "id long, x double, y string, at int"), epoch, "at")
            want |= {i: (x, y) for i, x, y, _ in rows}
        assert {r["id"]: (r["x"], r["y"]) for r in store.read().collect()} == want
    asked = {r["id"]: (r["x"], r["y"]) for r in store.fetch(spark.range(50)).collect()}
    assert asked == {i: want.get(i, (None, None)) for i in range(50)}


def test_a_change_is_made_once_and_touches_its_buckets_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), "id long, n long", ["id"], 8)
    store.put(spark.range(100).withColumn("n", F.lit(0)), 0)
    before = store.commit()
    one = spark.createDataFrame([(7, 1)], "id long, n long")
    assert store.put(one, 1) and not store.put(one.withColumn("n", F.lit(9)), 1)  # the retried batch
    after = store.commit()
    assert sum(before["buckets"][b] != after["buckets"][b] for b in before["buckets"]) == 1
    assert store.read().filter("n = 1").count() == 1 and store.read(0).agg(F.sum("n")).first()[0] == 0
    store.vacuum()
    assert store.versions() == [1] and store.read().count() == 100
    with pytest.raises(ValueError, match="no version"):
        store.read(0)


def test_two_writers_cannot_share_a_version(spark, tmp_path):
    a, b = (Store(spark, str(tmp_path / "s"), "id long", ["id"], 2) for _ in range(2))
    record = b.commit()
    a.put(spark.range(3))
    with pytest.raises(Exception, match="exist"):
        b._record(record["version"] + 1, None, {})
    assert a.read().count() == 3


def test_rows_are_pushed_and_pulled(spark, tmp_path):
    store = ParameterStore(spark, str(tmp_path / "p"), "vec array<float>, record long", 4)
    rows = spark.createDataFrame([("t", 1, [1.0, 2.0], 5), ("u", 1, [3.0, 4.0], 6)], "table string, id long, vec array<float>, record long")
    store.evict(rows, 0)
    got = {(r["table"], r["id"]): r["vec"] for r in store.pull(spark.createDataFrame([("t", 1), ("t", 2), ("u", 1)], "table string, id long"), F.array(F.lit(0.0), F.lit(0.0))).collect()}
    assert got == {("t", 1): [1.0, 2.0], ("t", 2): [0.0, 0.0], ("u", 1): [3.0, 4.0]}


def test_a_stream_into_a_store_goes_on_after_a_restart(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), "id long, n long", ["id"], 4)

    def run(part):
        spark.range(part * 10, part * 10 + 15).select("id", F.lit(part).cast("long").alias("n")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = streams.file_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
        q = source.writeStream.foreachBatch(storing(store)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    for part in range(3):
        run(part)
    assert {r["id"]: r["n"] for r in store.read().collect()} == {i: min(i // 10, 2) for i in range(35)}


def measured(rows, suite, window, most):
    """The batch query: all rows, and those of the newest batches."""
    sizes = rows.groupBy("task", "batch").agg(F.count(F.lit(1)).alias("n"))
    last = rows.join(ranking.sliding_batches(sizes.filter("batch IS NOT NULL"), "batch", "n", window, ["task"], most).select("task", "batch"), ["task", "batch"])
    whole = {r["task"]: r for r in suite.compute(rows, ["task"]).collect()}
    return whole, {r["task"]: r for r in suite.compute(last, ["task"]).collect()}


@pytest.mark.parametrize("window, most", [(60, 1000), (10000, 3), (2, 5)])
def test_metric_state_equals_the_batch_query_after_a_restart(spark, tmp_path, window, most):
    rng, suite = random.Random(window), metrics.Suite.of("ne", "ctr", "mse", "serving_calibration")
    kind = "task string, batch long, label double, prediction double, weight double"
    made = [(rng.choice("aaaab"), b, float(rng.random() < 0.3), rng.random(), rng.choice([0.0, 1.0, 2.0])) for b in range(12) for _ in range(rng.randrange(1, 25))] + [("c", 0, 1.0, 0.5, 0.0), ("a", None, 1.0, 0.5, 1.0)]
    for n in range(4):
        spark.createDataFrame([r for r in made if (r[1] or 0) // 3 == n], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{n // 2}"))
    for n in range(2):  # the second stream starts anew, from the same checkpoint and store
        state = MetricState(spark, str(tmp_path / "state"), suite, window, {"task": "string"}, most=most, buckets=3)
        if n:
            for f in (tmp_path / "in1").glob("*.parquet"):
                f.rename(tmp_path / "in0" / f.name)
        state.follow(streams.file_stream(spark, str(tmp_path / "in0"), spark.createDataFrame([], kind).schema), str(tmp_path / "c"))
    before = {r["task"]: r for r in state.values().collect()}
    assert not state.absorb(spark.createDataFrame(made[:5], kind), 0)  # a retried trigger
    whole, last = measured(spark.createDataFrame(made, kind), suite, window, most)
    assert set(before) == set(whole)
    for t, r in before.items():
        for c in ("ne", "ctr", "mse", "serving_calibration", "total_examples"):
            assert r[f"lifetime_{c}"] == pytest.approx(whole[t][c])
            assert r[f"window_{c}"] == (pytest.approx(last[t][c]) if t in last else None)
    early = {r["task"]: r for r in state.values(state.store.versions()[0]).collect()}  # a snapshot is still there
    assert early["a"]["lifetime_ctr"] != before["a"]["lifetime_ctr"]
