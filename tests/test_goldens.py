"""Hand-computed values of metrics, jagged operators and remapping."""

import math

import pytest
from pyspark.sql import functions as F

from quillon.functions import expressions as X
from quillon.operators import jagged, layout, lookup, metrics, prep, ranking, remap
from quillon.plans import planner
from quillon.streaming import streams


def scored(spark, predictions, labels, weights, sessions):
    rows = [(i, float(p), float(y), float(w), s) for i, (p, y, w, s) in enumerate(zip(predictions, labels, weights, sessions, strict=True))]
    return spark.createDataFrame(rows, "pos int, prediction double, label double, weight double, session int")


def test_auc_with_weights(spark):
    df = scored(spark, [.2, .6, .8, .4, .9], [1, 0, 0, 1, 1], [.13, .2, .5, .8, .75], [1] * 5)
    assert ranking.auc(df, []).first()[0] == pytest.approx(0.4464, abs=1e-4)


def test_auc_without_signal(spark):
    assert ranking.auc(scored(spark, [.1, .2], [1, 1], [1, 1], [1, 1]), []).first()[0] == 0.5


@pytest.mark.parametrize("predictions, labels, sizes, value, n", [
    ([.9, .8, .7, .6, .5], [1, 0, 1, 1, 0], [3, 2], 0.75, 2),
    ([.3, .9, .1, .8, .2, .8, .7, .6, .5, .5], [1, 1, 1, 0, 0, 1, 0, 1, 1, 0], [2, 3, 3, 2], 0.25, 2),
])
def test_session_auc(spark, predictions, labels, sizes, value, n):
    sessions = [i for i, k in enumerate(sizes) for _ in range(k)]
    got = ranking.session_auc(scored(spark, predictions, labels, [1] * len(labels), sessions), "session", ["pos"]).first()
    assert (got[0], got[1]) == (pytest.approx(value, abs=1e-6), n)


@pytest.mark.parametrize("exponential, value", [(True, 0.6748), (False, 0.6463)])
def test_ndcg(spark, exponential, value):
    df = scored(spark, [.1, .2, .3, .4, .5, .1, .2, .3], [0, 1, 0, 0, 2, 2, 1, 0], [1, 1, 1, 1, 2, 1, 1, 3], [1] * 5 + [2] * 3)
    assert ranking.ndcg(df, "session", ["pos"], exponential=exponential).first()[0] == pytest.approx(value, abs=1e-4)


def test_session_recall(spark):
    p, y = [1, 0, .51, .8, 1, 0, .51, .8, 1, 0, .51, .8], [1, 1, 0, 0, 1, 1, 0, 0, 1, 1, 0, 0]
    df = scored(spark, p, y, [1] * 12, [1] * 7 + [-1] * 5)
    assert ranking.session_threshold(df, "session", 3).first()[0] == pytest.approx(0.5)


def test_normalized_entropy_of_the_mean_is_one(spark):
    df = scored(spark, [.25] * 4, [1, 0, 0, 0], [1] * 4, [1] * 4)
    assert metrics.Suite.of("ne").compute(df, []).first()[0] == pytest.approx(1.0)


def test_zero_weights_give_zero(spark):
    df = scored(spark, [.25, .5], [1, 0], [0, 0], [1, 1])
    assert metrics.Suite.of("ne", "ctr").compute(df, []).first().asDict() == {"ne": 0, "ctr": 0}


def test_multiclass_recall(spark):
    rows = [([.9, .1, 0., 0., 0.], 0, 1.), ([.1, .2, .25, .15, .3], 3, .25), ([0., 1., 0., 0., 0.], 1, .5), ([0., 0., .2, .7, .1], 2, .25)]
    got = metrics.multiclass_recall(spark.createDataFrame(rows, "scores array<double>, label int, weight double"), 5).orderBy("k").collect()
    assert [round(r[1] * 2, 6) for r in got] == [1.5, 1.75, 1.75, 2.0, 2.0]


def test_contiguous_ids(spark):
    rows = [(0, "abc"), (1, "iop"), (2, "iop"), (3, "lkj")]
    df = spark.createDataFrame(rows, "pos int, c string")
    got = {r[0]: r[1] for r in prep.contiguous_ids(df, "c", ["pos"], 2).collect()}
    assert got == {"abc": 1, "iop": 2, "lkj": 1}


def test_padding_keeps_the_first(spark):
    df = spark.createDataFrame([([1, 2],), ([],), ([6, 7, 8],)], "v array<int>")
    assert [r[0] for r in df.select(X.padded(F.col("v"), 2, F.lit(10))).collect()] == [[1, 2], [10, 10], [6, 7]]


def test_lfu_eviction(spark):
    state = spark.createDataFrame([(4, 0, 10, 0), (5, 1, 1, 0)], "id long, slot long, count long, last int")
    batch = spark.createDataFrame([(i, n) for i, n in ((3, 1), (4, 1), (5, 1), (6, 3), (7, 3), (8, 3), (9, 1), (10, 1))], "id long, count long")
    got = {r["id"]: r["count"] for r in remap.updated(state, batch, 5, "lfu", 1).collect()}
    assert got == {4: 11, 6: 3, 7: 3, 8: 3}


def test_slots_are_unique_and_bounded(spark):
    state = spark.createDataFrame([], "id long, slot long, count long, last int")
    for step in range(3):
        batch = spark.createDataFrame([(i, 1 + (i * 7 + step) % 5) for i in range(step * 4, step * 4 + 9)], "id long, count long")
        state = remap.updated(state, batch, 8, "distance_lfu", step)
    slots = [r["slot"] for r in state.collect()]
    assert len(slots) == len(set(slots)) <= 7 and all(0 <= s < 7 for s in slots)


def test_mixing_hash_is_exact(spark):
    xs = [0, 1, 2, 17, 123456789, 2**31, 2**40 + 3]
    def direct(x, n):
        x = (x ^ 0xDEADBEEF) * 2654435761
        return (x ^ (x >> 16)) % n
    got = spark.createDataFrame([(x,) for x in xs], "x long").select("x", X.mixing_hash(F.col("x"), 1000)).collect()
    assert {r[0]: r[1] for r in got} == {x: direct(x, 1000) for x in xs}


def test_lookup_plans_agree(spark):
    long = spark.createDataFrame([(r, "k", p, (r * 3 + p) % 4, 0.5 + p) for r in range(5) for p in range(r)], "row int, key string, pos int, id long, weight double")
    table = spark.createDataFrame([(i, [float(i), float(i * i)]) for i in range(4)], "id long, vec array<float>")
    as_rows = lambda d: sorted((r["row"], [round(x, 6) for x in r["vec"]]) for r in d.collect())
    for mode in ("sum", "mean"):
        assert as_rows(lookup.pooled(long, table, mode)) == as_rows(lookup.pooled(long, table, mode, dim=2, dedup=True)) == as_rows(lookup.pooled(long.repartition(3), table.repartition(3), mode))


def test_quantized_rows_are_near(spark):
    table = spark.createDataFrame([(0, [0.0, 0.5, 1.0]), (1, [2.0, 2.0, 2.0])], "id long, vec array<double>")
    got = {r["id"]: r["vec"] for r in lookup.dequantized(lookup.quantized(table, 8)).collect()}
    assert all(math.isclose(a, b, abs_tol=1 / 255) for a, b in zip(got[0] + got[1], [0.0, 0.5, 1.0, 2.0, 2.0, 2.0], strict=True))


def test_validator_names_faults(spark):
    lengths = spark.createDataFrame([("a", 0, 2), ("b", 0, -1), ("c", 0, 1)], "key string, row int, length int")
    assert jagged.violations(lengths, 2, ["a", "b"], 3) == ["a length is negative", "a key is unknown", "lengths are not divisible by keys", "there are not as many weights as values"]


def test_shards():
    assert layout.row_shards(10, 4) == [(3, 0), (3, 3), (3, 6), (1, 9)]
    assert layout.column_shards(10, 4) == [(4, 0), (6, 4)]


def test_plan_that_cannot_fit(spark):
    tables = spark.createDataFrame([("t", 1000, 8, 4, 1.0, 16)], "table string, rows long, dim int, bytes int, pooling_factor double, batch int")
    with pytest.raises(ValueError, match="no plan fits"):
        planner.planned(tables, planner.Topology(world=2, memory=100))


def test_batches_cover_rows_once(spark):
    for total in (0, 5, 130, 131, 385, 1000):
        got = prep.batch_plan(spark.range(total), "id", total, 32, 3).groupBy("rank", "batch_id").count().collect()
        assert sum(r["count"] for r in got) == total
        last = [r["count"] for r in got if r["batch_id"] == max((x["batch_id"] for x in got), default=0)]
        assert not last or max(last) - min(last) <= 32


def test_remap_stream_keeps_bounds(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(k % (7 + i), i) for k in range(40)], "id long, hour long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = streams.file_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    out = streams.run_available(streams.remap_stream(source, 2, 4), "remapped")
    assert out.count() == 120 and out.agg(F.max("slot")).first()[0] < 8


def test_event_time_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = streams.file_stream(spark, str(tmp_path / "in"), events.schema)
    measured = lambda d: streams.windowed_metrics(streams.event_time(d).select("ts", F.lit(1.0).alias("label"), F.col("value").alias("prediction"), F.lit(1.0).alias("weight")), metrics.Suite.of("weighted_avg"), "1 day")
    streamed = streams.run_available(measured(source), "windows", "complete")
    key = lambda d: sorted((r["w"]["start"], round(r["weighted_avg"], 9)) for r in d.collect())
    assert key(streamed) == key(measured(events))
