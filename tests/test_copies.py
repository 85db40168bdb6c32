"""Tables that are shuffled once to each of a few parts of the rows."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon import queries
from quillon.functions import expressions as X
from quillon.functions import packed
from quillon.operators import copies, lookup, models

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_items_are_copied_to_a_few_parts_whatever_the_number_of_users(spark):
    of = spark.range(40).select(F.col("id").alias("u"), F.array(F.col("id") * 1.0, F.lit(1.0)).alias("state"))
    out = spark.range(50).select("id", F.array(F.sin("id"), F.cos("id")).alias("vec"), F.lit(0.0).alias("bias"))
    got = models.best_items(of, "u", out, 2, users=10**7)
    (parts,) = set(re.findall(r"shufflepartitionidpassthrough\(.*?, (\d+)\)", plan(got)))
    assert int(parts) <= copies.COPIES and "Generate explode(sequence" not in plan(got)
    assert got.count() == 80


def test_best_items_do_not_depend_on_item_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors, of = rng.integers(-2, 3, (60, 3)).astype(float), rng.integers(-2, 3, (30, 3)).astype(float)
    out = spark.createDataFrame([(i, v.tolist(), 0.5) for i, v in enumerate(vectors)], "id long, vec array<float>, bias double")
    given = spark.createDataFrame([(i // 2, v.tolist()) for i, v in enumerate(of)], "u long, state array<double>")  # two states a user, of which the least counts
    want = {(i, r + 1, j, float(vectors[j] @ s) + 0.5) for i in range(15) for s in [min(of[2 * i:2 * i + 2].tolist())] for r, j in enumerate(sorted(range(60), key=lambda j: (-float(vectors[j] @ s), j))[:7])}
    for held in (models.HELD, 50):
        monkeypatch.setattr(models, "HELD", held)
        assert {tuple(r) for r in models.best_items(given, "u", out, 7, 4, 9).collect()} == want


@pytest.mark.parametrize("name", ["row_sharded_lookup", "tower_collection", "packed_bags", "ebc_mean", "column_sharded_lookup", "ebc_sum", "ebc_concatenated", "quant_lookup", "click_model_forward", "ec_sequence", "ebc_position_weighted"])
def test_vectors_of_large_tables_are_not_shuffled_for_each_id(spark, monkeypatch, name):
    before, value = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), lambda v: float("inf") if v is None else v
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    want = queries.QUERIES[name](spark, SF).toPandas()
    monkeypatch.setattr(lookup, "SMALL", queries.table(spark, SF, "embeddings").count() * queries.DIM // 6)  # the table is six times as large
    got = queries.QUERIES[name](spark, SF)
    try:
        assert "shufflepartitionidpassthrough" in plan(got) and not re.search(r"Exchange hashpartitioning\(id", plan(got).partition("shufflepartitionidpassthrough")[0])
        got = got.toPandas()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    keys = [c for c in want if want[c].dtype != float]
    want, got = (x.sort_values(keys).reset_index(drop=True) for x in (want, got))
    assert want.dtypes.equals(got.dtypes) and len(want) == len(got) > 0 and want[keys].equals(got[keys])
    for c in set(want) - set(keys):
        assert np.allclose(want[c], got[c], rtol=1e-9, atol=1.1e-3 if name in ("quant_lookup", "packed_bags") else 1.1e-4) and (want[c] != got[c]).mean() < 1e-4


@pytest.mark.parametrize("dense", [True, False])
def test_bags_of_any_size_and_odd_ids_are_pooled_as_by_a_join(spark, monkeypatch, dense):
    """A bag goes on over many batches; ids are unknown, null or twice in the table, weights, rows and keys null."""
    rng = np.random.default_rng(8)
    spread = 1 if dense else 10**7
    table = spark.createDataFrame([(i * spread, rng.normal(0, 1, 3).tolist()) for i in [*range(20), *([] if dense else [4, 4])]], "id int, vec array<float>")
    rows = [(int(r) if r else None, "ab"[int(r) % 2] if r % 5 else None, p, int(i) * spread if i < 24 and i % 11 else None, float(p % 3) if i % 7 else None) for p, (r, i) in enumerate(zip(rng.integers(0, 12, 900) * (rng.random(900) < 0.5), rng.integers(-2, 26, 900)))]
    rows += [(99, "c", 0, 3 * spread, None), (98, "c", 0, 999 * spread, 1.0)]
    long = spark.createDataFrame(rows, "row long, key string, pos long, id long, weight double").repartition(3)
    towers = [lookup.Tower(["a", "b"], X.pairwise_dots), lookup.Tower(["a"], lambda x: x[0], "mean"), lookup.Tower(["b"], lambda x: F.array(F.size(x[0]).cast("double")), "sequence")]
    ids = spark.range(100).select(F.col("id").alias("row"))
    made = {"sum": lambda: lookup.pooled(long, table), "mean": lambda: lookup.pooled(long, table, "mean", dim=3), "shards": lambda: lookup.sharded_pooled(long.withColumn("s", F.col("id") % 4), table, 3, "s"),
            "keys": lambda: lookup.keyed_pooled(long.fillna(1.0, "weight"), table, ["b", "a", "none"], 3), "sequence": lambda: lookup.sequence_lookup(long, table), "towers": lambda: lookup.towers(ids, long.fillna(1.0, "weight"), table, towers, 3)}
    rounded = lambda v: tuple(rounded(x) for x in v) if isinstance(v, (list, tuple)) else round(v, 9) + 0.0 if isinstance(v, float) else v
    collected = lambda: {k: sorted((rounded(tuple(r)) for r in f().collect()), key=repr) for k, f in made.items()}
    want = collected()
    monkeypatch.setattr(lookup, "SMALL", 20)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        for k, f in made.items():
            assert "shufflepartitionidpassthrough" in plan(f()), k
        got = collected()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for k in made:
        if k == "sequence":  # equal places in the order of their vectors
            assert [x[:2] for x in want[k]] == [x[:2] for x in got[k]] and [sorted(x[2]) for x in want[k]] == [sorted(x[2]) for x in got[k]]
        else:
            assert want[k] == got[k], k


def test_few_ids_are_not_met_by_copies(spark, monkeypatch):
    table = spark.range(30).select("id", F.array_repeat(F.lit(0.5), 5).alias("vec"))
    long = spark.range(30).select(F.col("id").alias("row"), F.lit("a").alias("key"), "id", F.lit(1.0).alias("weight"))
    monkeypatch.setattr(lookup, "SMALL", 100)
    assert "shufflepartitionidpassthrough" not in plan(lookup.pooled(long, table))


def test_shards_that_are_large_together_are_not_sent(spark, monkeypatch):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    shards = [spark.range(30).select("id", F.array_repeat(F.lit(float(i)), 5).alias("vec")) for i in range(4)]
    monkeypatch.setattr(lookup, "SMALL", 200)  # each has 150 elements
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Broadcast" not in plan(lookup.side_by_side(shards))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("bits", [2, 4, 8])
def test_packed_rows_are_read_alike_by_columns_and_by_numpy(spark, bits):
    rng = np.random.default_rng(bits)
    table = spark.createDataFrame([(i, rng.normal(0, 3, 13).tolist()) for i in range(20)], "id long, vec array<float>")
    rows = lookup.packed_table(table, bits).select("row", packed.unpacked(F.col("row"), 13, bits).alias("vec")).collect()
    assert np.allclose(packed.decoded(pa.array([bytes(r["row"]) for r in rows]), 13, bits), [r["vec"] for r in rows], rtol=1e-12)
