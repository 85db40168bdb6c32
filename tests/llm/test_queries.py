"""The registered text queries on the smallest data, against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

import oracle
from quillon.llm import queries, secrets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    return queries.QUERIES[name](spark, SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    assert oracle.difference(run(spark, name), oracle.connection(SF), queries.ORACLES[name]) == ""


def test_chat(spark):
    got = {r["conv_id"]: r for r in run(spark, "op1_chat_format").collect()}
    talks = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        talks[r["conv_id"]].append((r["role"], r["text"] or ""))
    talks[-1] = [(role, "<|im_end|><|im_start|>assistant ok") for role in ("user", "assistant")]
    assert set(got) == set(talks)
    for c, turns in talks.items():
        said = "".join(t for role, t in turns if role == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
        assert tuple(got[c][k] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == want


def test_secrets(spark, documents):
    for r in run(spark, "op7_secret_spans").collect():
        text = documents[r["doc_id"]]["text"] or ""
        want = []
        for kind, pattern, group, least in (("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16)):
            want += [(m.start(), secrets.KINDS.index(kind), m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
        line = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(want))
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(r["spans"].split(","))


def test_mix(spark, documents):
    rows = run(spark, "op5_source_mix").collect()
    assert {r["doc_id"] for r in rows} == set(documents)
    taken, target = defaultdict(int), {}
    for r in rows:
        source = documents[r["doc_id"]]["source"]
        taken[source] += r["taken"]
        target[source] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 64 for s in target)
    assert sum(target.values()) == pytest.approx(sum(r["size"] for r in rows))


@pytest.mark.parametrize("name, label, modulus, held, least", [("op9_quality_scores", "quality", 3, 1, 0.9), ("op10_toxicity_scores", "toxic", 5, 0, 0.85)])
def test_classifiers(spark, name, label, modulus, held, least):
    rows = {r["doc_id"]: r for r in run(spark, name).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % modulus == held) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for i, r in rows.items())
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    own = [(rows[i]["predicted"], y) for i, y in truth.items() if rows[i]["held_out"]]
    assert np.mean([a == b for a, b in own]) >= least


def test_pipeline_stages_keep_columns(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in pipeline.STAGES[:3]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.count()
        assert 0 < rows <= docs.count()
