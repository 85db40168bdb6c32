"""Numbers of text click logs: told by their look, equal to a cast that may fail."""

from pyspark.sql import functions as F

from quillon import queries
from quillon.functions import expressions as X

ODD = ["1", " 5 ", "+5", "-7", "-", "", "x12", "1.5", "1e3", "99999999999", "2147483647", "2147483648", "-2147483648", "5\n", "\t8", "1 2", "007", "\x7f3", "２", None, "null", "--1", "1_0", " 4"]
HEX = ["ff", "FF", "0", "", None, "g1", "0x1f", "123456789abcdef", "0123456789abcdef", "aB", "-1", " a"]


def test_whole_numbers_equal_try_cast(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string")
    for to in ("int", "long"):
        got = df.select("t", X.whole_number(F.col("t"), to, 0).alias("a"), X.safe_cast(F.col("t"), to, 0).alias("b")).collect()
        assert [r["a"] for r in got] == [r["b"] for r in got]


def test_junk_never_meets_a_cast(spark):
    """A text that is no whole number is told before the cast, which would cost an exception."""
    got = spark.range(1).select(X.whole_number(F.lit("x1"), "int", 0).alias("a"))
    assert "RLIKE" in got._jdf.queryExecution().analyzed().toString()
    assert got.first()["a"] == 0


def test_hex_ids_of_odd_texts(spark):
    df = spark.createDataFrame([(t,) for t in HEX], "t string")
    assert [r[0] for r in df.select(X.hex_id(F.col("t"))).collect()] == [255, 255, 0, 0, 0, 0, 0, 0x123456789abcdef, 0, 171, 0, 0]


def test_the_least_numbers_are_sent_to_the_clicks(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries.QUERIES["click_shifted_logs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
