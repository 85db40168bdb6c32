"""Registered queries and the pipeline against brute force on whole small tables."""

import random
import re
import string
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import ann, common, html, mixing, neardup, packing, quality, queries, rules, secrets, toxicity

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))


def rebuilt(rows, library, texts):
    """Pieces hold each id of each text once, and sequences are gapless."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for i, text in texts.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at:at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding


def test_packed_ids_are_rebuilt(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert rebuilt(queries.op2_packed_sequences(spark, SF).collect(), library, texts) == 0


def test_main_texts_are_blocks_of_their_pages(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op3_main_text(spark, SF).collect()
    assert {r["page_id"] for r in got} == set(pages)
    for r in got:
        found = html.blocks(pages[r["page_id"]])
        assert r["text"] == " ".join(t for t, f, _ in found if html.verdict(html.trained(), f)) and r["n_chars"] == len(r["text"])
        plain = re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", html.html.unescape(pages[r["page_id"]])))
        assert all(SPACE.findall(t)[0] in plain for t, _, _ in found)


def counted(text):
    words = SPACE.findall(text or "")
    places, seen = set(), defaultdict(list)
    for i in range(len(words) - 7):
        seen[tuple(words[i:i + 8])].append(i)
    for at in seen.values():
        if len(at) > 1:
            places.update(j for i in at for j in range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(places)


def test_rules_query_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op4_quality_rules(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        n, chars, symbols, dup, repeat = counted(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 20 or 100 * repeat > 30 * n) and not (r["base_failed"] and r["kept"])


def test_rules_judge_documents_they_did_not_learn_from(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    side = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    found = rules.judged(docs, rules.fit(docs, labels.filter(side == 0))).join(labels.filter(side == 1), "doc_id").filter("NOT base_failed")
    right, n = found.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("double")), F.count("doc_id")).first()
    assert n > 50 and right > 0.9


def test_nearest_vectors_are_nearly_all_found(spark):
    sf = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    ids, x = table["vec_id"].to_numpy(), np.array(table["embedding"].tolist(), dtype=np.float64)
    at = {i: j for j, i in enumerate(ids)}
    got = defaultdict(list)
    for r in queries.op6_nearest_vectors(spark, sf).orderBy("query_id", "rank").collect():
        assert r["score"] == np.sqrt(((x[at[r["vec_id"]]] - x[at[r["query_id"]]]) ** 2).sum())
        got[r["query_id"]].append(r["vec_id"])
    assert set(got) == {i for i in ids if i % 100 == 0}
    found = 0
    for q, near in got.items():
        d = np.sqrt(((x - x[at[q]]) ** 2).sum(axis=1))
        d[at[q]] = np.inf
        found += len(set(near) & set(ids[np.argsort(d, kind="stable")[:10]]))
    assert found / (10 * len(got)) >= 0.95


def test_large_index_keeps_its_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (12_000, 24)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)
    got = defaultdict(set)
    for r in ann.nearest(rows, F.col("vec_id") % 200 == 0).collect():
        got[r["query_id"]].add(r["vec_id"])
    x, found = x.astype(np.float64), 0
    for q, near in got.items():
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        found += len(near & set(np.argsort(d)[:10]))
    assert len(got) == 60 and found / 600 >= 0.9


def test_secrets_beyond_the_patterns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = secrets.fit(docs)
    rng = random.Random(77)
    for alphabet in (string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits, "0123456789ABCDEF", string.ascii_lowercase + string.digits):
        drawn = ["".join(rng.choices(alphabet, k=rng.choice([20, 24, 32, 40]))) for _ in range(300)]
        assert np.mean([any(k == 3 for _, k, _ in model.spans(f"see {x} here")) or bool(secrets.base_spans(x)) for x in drawn]) > 0.9
    plain = ["-" * 40, "=" * 40, "src/main/java/org/example/service/UserAccountServiceImpl.java", "my_very_long_variable_name_for_testing", "//www.example.com/articles/2024/05/17/how-to-bake-bread-at-home.html", "antidisestablishmentarianism"]
    assert not any(model.spans(x) for x in plain)
    clean = docs.filter(~F.col("text").rlike(r"[0-9a-f]{16}|AKIA|(?i)(passw|secret|token|api_?key)"))
    chars, spans = secrets.scanned(clean, model).agg(F.sum(F.length("text")), F.sum(F.size("secrets"))).first()
    assert chars > 10**6 and spans <= chars / 10**6


def test_added_spans_overlap_no_pattern_in_long_texts(spark):
    model = secrets.train(*secrets.corpus_counts(spark.read.parquet(f"{SF}/documents.parquet")))
    rng = random.Random(4)
    made = lambda: "".join(rng.choices(string.ascii_letters + string.digits, k=24))
    text = " ".join(rng.choice([f"token={made()}", made(), f"{rng.getrandbits(100):025x}", "plain words between", f"x{made()}=password:{made()}"]) for _ in range(4000))
    spans = model.spans(text)
    base = secrets.base_spans(text)
    assert [s for s in spans if s[1] < 3] == base
    want = [(m.start(), 3, m.end()) for m in secrets.tokens(text) if not any(a < m.end() and m.start() < b for a, _, b in base) and len(set(m[0])) >= secrets.VARIED and model.score(m[0]) > model.threshold]
    assert [s for s in spans if s[1] == 3] == want and len(want) > 500


def shingled(text, k=4):
    w = text.lower().split()
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_outsiders_of_a_large_component(spark):
    """A component of near copies and texts at its border: linked exactly where brute force links."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(160)]

    def edited(n):
        w = list(base)
        for i in rng.sample(range(len(w)), n):
            w[i] = f"e{rng.randrange(10**9)}"
        return " ".join(w)

    texts = [edited(rng.choice([1, 2, 3, 4])) for _ in range(260)] + [edited(rng.choice([5, 6, 7, 8, 9])) for _ in range(70)]
    rng.shuffle(texts)
    sets = [shingled(t) for t in texts]
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    want = {i: top(i) for i in range(len(texts))}
    assert 1 < len(set(want.values())) < 70
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()}
    assert got == want


def test_rows_of_one_id_are_one_node_by_a_fixed_rule(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (1, b), (2, a), (3, b), (3, None), (4, ""), (None, a), (None, None)]
    runs = []
    for parts in (1, 5):
        found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        runs.append(sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found), key=str))
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)


def test_clashing_names_empty_tables_and_nulls(spark):
    columns = "doc_id long, text string, stats string, kept int, _w int, _l int, secrets string, toxicity int, quality_score int, base_failed int, _mix int, source string, n_chars int"
    row = (1, "a b c password=abcdefghijkl", "s", 1, 2, 3, "x", 4, 5, 6, 7, None, 27)
    none = (None, None, None, None, None, None, None, None, None, None, None, None, None)
    labels = spark.createDataFrame([(None, 1, None), (7, None, 1)], "doc_id long, quality int, toxic int")
    for rows in ([], [row, none, row]):
        df = spark.createDataFrame(rows, columns)
        listed = rules.judged(df, rules.fit(df, labels)).collect()
        assert len(listed) == len(rows) and all(r["_w"] in (2, None) and r["_l"] in (3, None) for r in listed)
        scanned = secrets.scanned(df, secrets.fit(df)).collect()
        assert len(scanned) == len(rows) and all(r["stats"] in ("s", None) for r in scanned)
        assert toxicity.scored(df, toxicity.fit(df, labels, F.lit(True))).count() == quality.scored(df, quality.fit(df, labels, F.lit(True))).count() == len(rows)
        assert neardup.near_duplicates(df).count() == len(rows)
        mixed = mixing.mixed_documents(df)
        assert mixed.columns == df.columns and mixed.filter("text IS NULL").isEmpty()


def test_stored_tables_need_a_shared_folder_on_a_cluster():
    class Elsewhere:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common._shared_dir(Elsewhere)


def test_whole_pipeline_on_a_small_table(spark, library):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, SF))
        kept.append({r["doc_id"]: r for r in docs.collect()})
    toxic_free, single, masked, _ = kept
    held = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = set(held) - set(toxic_free)
    assert sum(held[i] == 1 for i in gone) > 0.8 * len(gone)
    sets = {i: shingled(r["text"] or "", pipeline.WORDS) for i, r in single.items()}
    ids = sorted(i for i in sets if sets[i])
    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] & sets[j])
            assert 100 * both < 80 * (len(sets[i]) + len(sets[j]) - both)
    assert set(masked) == set(single) and all(not secrets.base_spans(r["text"] or "") for r in masked.values())
    words = defaultdict(int)
    for r in docs.collect():
        words[r["source"]] += len(SPACE.findall(r["text"] or ""))
        assert SPACE.findall(r["text"] or "") == [] or set(SPACE.findall(r["text"])) <= set(SPACE.findall(masked[r["doc_id"]]["text"]))
    targets = {r["source"]: r["target"] for r in mixing.mix(spark.createDataFrame([(r["doc_id"], r["source"], r["text"]) for r in masked.values()], "doc_id long, source string, text string")).collect()}
    assert all(abs(words[s] - t) <= 64 for s, t in targets.items())
    pieces = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    total = sum(len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert sum(r["length"] for r in pieces) == total
