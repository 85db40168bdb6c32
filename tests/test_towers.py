"""Towers over bags, and click logs converted to a typed table."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import expressions as X
from quillon.operators.lookup import Tower, towers
from quillon.sources import readers

LONG = "row long, key string, pos long, id long, weight double"


def test_towers_equal_a_loop(spark):
    rng = np.random.default_rng(3)
    x = {i: rng.normal(0, 1, 4) for i in range(20)}
    table = spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "id long, vec array<double>")
    long = [(r, k, p, int(rng.integers(0, 24)), float(rng.integers(1, 4))) for r in range(8) for k in "abc" for p in range(int(rng.integers(0, 4)))]
    long += [(1, "a", 9, None, 1.0), (None, "a", 0, 3, 1.0), (99, "a", 0, 3, 1.0)]
    first = lambda v: F.array(F.coalesce(F.get(F.get(v[0], F.lit(0)), F.lit(0)), F.lit(-1.0)), F.size(v[0]).cast("double"))
    of = [Tower(["b", "a"], lambda v: F.concat(v[0], X.pairwise_dots(v))), Tower(["a"], lambda v: v[0], "mean"), Tower(["c"], first, "sequence"), Tower(["a"], first, "sequence")]
    rows = spark.createDataFrame([(r,) for r in [*range(8), 8, 8]], "row long")
    got = {r["row"]: r["vec"] for r in towers(rows, spark.createDataFrame(long, LONG).repartition(3), table, of, 4).collect()}
    assert sorted(got) == list(range(9))
    for r, vec in got.items():
        bag = {k: [(x[i], w) for a, b, p, i, w in sorted(t for t in long if t[0] == r and t[1] == k and t[3] in x)] for k in "abc"}
        total = {k: sum((v * w for v, w in bag[k]), np.zeros(4)) for k in "ab"}
        mean = sum((v for v, _ in bag["a"]), np.zeros(4)) / max(1, len(bag["a"]))
        seq = [[bag[k][0][0][0] if bag[k] else -1.0, float(len(bag[k]))] for k in "ca"]
        assert np.allclose(vec, [*total["b"], total["b"] @ total["a"], *mean, *seq[0], *seq[1]])


def test_towers_without_rows_or_of_no_kind(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0])], "id long, vec array<double>")
    none = spark.createDataFrame([], LONG)
    rows = spark.createDataFrame([(1,)], "row long")
    of = [Tower(["a"], lambda v: v[0])]
    assert towers(rows, none, table, of, 2).first()["vec"] == [0.0, 0.0]
    assert towers(rows.limit(0), none, table, of, 2).count() == 0
    for bad in ([], [Tower(["a"], lambda v: v[0], "max")]):
        with pytest.raises(ValueError):
            towers(rows, none, table, bad, 2)


def line(label, ints, cats):
    return "\t".join([label, *ints, *cats])


def test_logs_become_one_table(spark, tmp_path):
    lines = {"day_0": [line("1", ["-3", "", *["5"] * 11], ["ff", "", *["a"] * 24]), line("", ["x", *["2"] * 12], ["zz", *["1f"] * 25])], "day_1": [line("0", ["7"] * 13, ["10"] * 26)]}
    for name, rows in lines.items():
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    into = str(tmp_path / "table")
    for paths in ([str(tmp_path / "day_0")], [str(tmp_path / "day_0"), str(tmp_path / "day_1")], [str(tmp_path / "day_1")]):
        got = readers.converted_clicks(spark, paths, into, sizes=[16] * 26)
    assert readers.shape(spark, into) == (3, 1 + 13 + 26 + 1)
    rows = {(r["file"], r["label"]): r for r in got.collect()}
    a, b, c = rows["day_0", 1], rows["day_0", 0], rows["day_1", 0]
    assert [a["int_0"], a["int_1"], a["int_2"], b["int_0"], b["int_1"], c["int_0"]] == pytest.approx([math.log(n) for n in (2, 5, 10, 5, 7, 2)])
    assert [a["cat_0"], a["cat_1"], a["cat_2"], b["cat_0"], b["cat_1"], c["cat_0"]] == [15, 0, 10, 0, 15, 0]


def test_files_of_one_name_are_refused(spark, tmp_path):
    for d in "ab":
        (tmp_path / d).mkdir()
        (tmp_path / d / "day").write_text(line("1", ["1"] * 13, ["1"] * 26) + "\n")
    with pytest.raises(ValueError, match="day"):
        readers.converted_clicks(spark, [str(tmp_path / d / "day") for d in "ab"], str(tmp_path / "t"))
    with pytest.raises(ValueError, match="size"):
        readers.converted_clicks(spark, str(tmp_path / "a"), str(tmp_path / "t"), sizes=[1])


def test_logarithms_of_no_rows_and_missing_numbers(spark):
    rows = spark.createDataFrame([(None, 4, None), (None, 6, 5), ("f", None, None)], "file string, int_0 int, int_1 int")
    got = {(r["file"], r["int_0"] is None): (r["int_0"], r["int_1"]) for r in readers.shifted_logs(rows.filter("int_0 IS NULL OR int_0 < 6"), "file", ["int_0", "int_1"]).collect()}
    assert got == {(None, False): (pytest.approx(math.log(2)), None), ("f", True): (None, None)}
    assert readers.shifted_logs(rows.limit(0), "file", ["int_0", "int_1"]).count() == 0
