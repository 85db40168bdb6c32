"""The stored retrieval index against exact search."""

import numpy as np
import pytest

from quillon import queries
from quillon.operators.retrieval import StoredIndex


def exact(x, ids, q, k):
    d = ((x - x[q]) ** 2).sum(axis=1)
    d[q] = np.inf
    return [int(ids[j]) for j in np.lexsort((ids, d))[:k]]


def test_search_after_appends_and_in_a_new_session(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 4, (40, 16))
    x = centres[rng.integers(0, 40, 3000)] + rng.normal(0, 0.6, (3000, 16))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(None, [0.0] * 16), (5000, None)], "id long, vec array<double>").repartition(4)
    index = StoredIndex(spark, str(tmp_path / "i"), 8).build(v.filter("id < 2000 OR id IS NULL"), cells=20, parts=8, bits=6, sample=1500)
    assert index.append(v.filter("id >= 2000"), 1) and not index.append(v.filter("id >= 2000"), 1)
    again = StoredIndex(spark, str(tmp_path / "i"), 8)  # read from its folder
    assert again.store.read().count() == 3000
    curve = []
    for probes in (1, 6):
        got = again.search(v.filter("id % 100 = 0"), 10, probes=probes, rerank=10).toPandas()
        assert (got.groupby("query")["rank"].max() == 10).all() and (got["query"] != got["id"]).all()
        assert got.apply(lambda r: abs(r["distance"] - ((x[int(r["id"])] - x[int(r["query"])]) ** 2).sum()) < 1e-9, axis=1).all()
        curve.append(np.mean([len(set(exact(x, np.arange(3000), q, 10)) & set(got[got["query"] == q]["id"])) / 10 for q in range(0, 3000, 100)]))
    assert curve[1] >= 0.9 and curve[0] <= curve[1]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_query_finds_nine_in_ten(spark, sf):
    t = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").toPandas()
    ids, x = t["vec_id"].to_numpy(), np.array(t["embedding"].tolist(), dtype=np.float64)
    got = queries.retrieval_reranked(spark, f"/root/testdata/{sf}").toPandas()
    asked = [j for j, i in enumerate(ids) if i % 50 == 0]
    found = [len(set(exact(x, ids, j, 5)) & set(got[got["query"] == ids[j]]["id"])) / 5 for j in asked]
    assert np.mean(found) >= 0.9
