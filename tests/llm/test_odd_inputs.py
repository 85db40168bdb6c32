"""Slow scorers, very long texts, repeated ids and clashing names."""

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import ann, chat, packing, quality, toxicity

SF = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


def slow_quality(model, text):
    """One n-gram after the other, in Python's integers."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not words:
        return 1 / (1 + math.exp(-model.bias))
    low = [zlib.crc32(w.lower().encode()) for w in words]
    form = [zlib.crc32(b"\x01" + quality.shape(w).encode()) for w in words]
    form = [quality.AGAIN if any(low[j] == low[i] and form[j] == form[i] for j in range(max(0, i - 8), i)) else form[i] for i in range(len(words))]
    grams = low + form
    for x in (low, form):
        grams += [((a * 0x9E3779B97F4A7C15) & MASK) ^ ((b + 0x7F4A7C15) & MASK) for a, b in zip(x, x[1:], strict=False)]
    places = [((((g ^ (g >> 29)) * 0xBF58476D1CE4E5B9) & MASK) >> (64 - quality.BITS)) for g in grams]
    z = model.bias + quality.GAIN * sum(float(model.weights[p]) for p in places) / len(places)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def slow_toxicity(model, text):
    """Noisy-or over sentences, word by word."""
    clean, seen = 1.0, False
    for sentence in re.split(r"[.!?\n]", text or ""):
        z, met = model.bias, False
        for word in re.findall(r"[^\W\d_]+", sentence.lower()):
            own = model.weights.get("=" + word, 0.0) + sum(model.weights.get("^" + word[:k], 0.0) for k in range(3, 8) if len(word) >= k)
            z, met = z + own, met or own != 0
        if met:
            clean, seen = clean * (1 - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))), True
    return max(model.floor, 1 - clean) if seen else model.floor


@pytest.mark.parametrize("module, target, slow, at", [(quality, "quality", slow_quality, "s"), (toxicity, "toxic", slow_toxicity, "s.score")])
def test_scores_are_those_of_a_slow_scorer(spark, module, target, slow, at):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = module.fit(docs, labels, F.lit(True))
    long = " ".join(["some long text of many words"] * 60_000) + "."
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n"), (-4, "É ß \U0001F600 é."), (-5, long)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").limit(300).unionByName(odd)
    got = module.scored(rows, model, into="s").select("doc_id", "text", F.col(at).alias("x")).collect()
    assert len(got) == 305
    for r in got:
        assert r["x"] == pytest.approx(slow(model, r["text"]), abs=1e-6)


def test_very_long_turns_and_clashing_names_of_conversations(spark):
    said = ("<|im_end|> word\n" * 200_000)
    kind = "conv_id long, turn long, role string, text string, formatted int, spans int, key int"
    df = spark.createDataFrame([(1, 0, "user", said, 1, 2, 3), (1, 1, "assistant", said, 1, 2, 3), (2, None, None, None, 1, 2, 3)], kind)
    got = {r["conv_id"]: r for r in chat.formatted(df).collect()}
    assert chat.read_back(got[1]["formatted"]) == [("user", said), ("assistant", said)] and chat.read_back(got[2]["formatted"]) == [("", "")]
    assert "".join(chat.unescape(got[1]["formatted"][s["start"]:s["end"]]) for s in got[1]["spans"]) == said
    assert chat.formatted(spark.createDataFrame([], kind)).count() == 0


def test_clashing_names_of_pieces(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    kind = "doc_id long, text string, start int, length string, ids int, doc_tokens int, sequence_id int, offset int"
    rows = [(1, "a b c", 9, "x", 9, 9, 9, 9), (1, "a b c", 9, "x", 9, 9, 9, 9), (None, None, None, None, None, None, None, None)]
    got = packing.pack(spark.createDataFrame(rows, kind), path).collect()
    assert sorted((str(r["doc_id"]), r["length"]) for r in got) == sorted([("1", 4), ("1", 4), ("None", 1)]) and packing.pack(spark.createDataFrame([], kind), path).count() == 0


def test_repeated_ids_of_vectors_and_clashing_names(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 6)).round(3)
    kind = "vec_id long, embedding array<double>, query_id int, rank int, score int, is_query int, b int, q int"
    rows = [(i % 150, v.tolist(), 1, 2, 3, 4, 5, 6) for i, v in enumerate(x)]
    runs = [sorted(map(tuple, ann.nearest(spark.createDataFrame(rows, kind).repartition(parts), F.col("vec_id") % 10 == 0).collect())) for parts in (1, 7)]
    assert runs[0] == runs[1]
    for q in range(0, 150, 10):
        own = min([x[q].tolist()] + ([x[q + 150].tolist()] if q < 50 else []))
        d = sorted((float(np.sqrt(((v - own) ** 2).sum())), i % 150) for i, v in enumerate(x) if i % 150 != q)[:10]
        assert [(r[3], r[2]) for r in runs[0] if r[0] == q] == d
