"""Training windows and negative samples on small tables."""

import pytest
from pyspark.sql import functions as F

from quillon import queries
from quillon.operators import prep


@pytest.mark.parametrize("width", [5, 20, 40])
def test_every_item_lies_in_a_window(spark, width):
    rows = [(n, list(range(1, n + 1))) for n in (0, 1, width - 1, width, width + 1, 43, 58, 101)]
    got = prep.masked_windows(spark.createDataFrame(rows, "u int, items array<int>"), "u", F.col("items"), width, 0.0, -1, 1000).collect()
    for n, items in rows:
        own = [r for r in got if r["u"] == n]
        assert {x for r in own for x in r["tokens"] if x} == set(items)
        step = max(1, width // 10)
        assert sorted(r["start"] for r in own) == sorted([*range(n - width, 0, -step), 0])


def test_training_rows_reach_the_last_event(spark):
    sf = "/root/testdata/sf0.001"
    sizes = {r["user_id"]: r["count"] for r in spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").count().collect()}
    ends = {r["user_id"]: r["e"] for r in queries.masked_training_rows(spark, sf).groupBy("user_id").agg((F.max("start") + 20).alias("e")).collect()}
    assert ends == {u: max(n, 20) for u, n in sizes.items()}


@pytest.mark.parametrize("popularity", [None, "popularity"])
def test_every_user_gets_its_negatives(spark, popularity):
    universe = spark.createDataFrame([(i, 100000 if i < 50 else 1) for i in range(100)], "item long, popularity long")
    seen = {1: range(50), 2: range(97), 3: range(100), 4: [], 5: [0, 1], 6: range(50, 100), None: range(60)}
    seqs = spark.createDataFrame([(u, list(x)) for u, x in seen.items()], "u long, items array<long>")
    runs = [sorted(map(tuple, prep.negatives(d, "u", F.col("items"), universe, 5, popularity, seed=2).collect()), key=str) for d in (seqs, seqs.repartition(3))]
    assert runs[0] == runs[1]
    for u, x in seen.items():
        got = [i for v, i in runs[0] if v == u]
        assert len(got) == len(set(got)) == min(5, 100 - len(x)) and not set(got) & set(x)


def test_items_of_a_user_do_not_travel_with_its_draws(spark):
    """Beside a user's draws its long list of items is moved once for each join with what was found."""
    ids = spark.range(400).withColumnRenamed("id", "item").withColumn("popularity", F.lit(1).cast("long"))
    seqs = spark.range(8).select(F.col("id").alias("u"), F.sequence(F.lit(10000).cast("long"), F.lit(30000).cast("long")).alias("items")).repartition(2)
    sc = spark.sparkContext

    def stages() -> dict[int, int]:
        listed = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {x.stageId(): x.shuffleWriteBytes() for x in map(listed.apply, range(listed.size()))}

    seqs = seqs.select("u", F.transform("items", lambda x: F.xxhash64(x, "u")).alias("items"))  # does not compress
    before = max(stages(), default=-1)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the places of the items were many
    try:
        assert prep.negatives(seqs, "u", F.col("items"), ids, 5, "popularity", seed=2).count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sum(n for i, n in stages().items() if i > before) < 10 * 8 * 20000 * 8
