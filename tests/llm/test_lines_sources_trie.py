"""Line dedup, source divergence and the prefix trie on small tables, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from quillon.llm import divergence, linedup, trie

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string"


# --- lines ----------------------------------------------------------------------
def kept_lines(rows, min_chars=20, min_docs=3):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n") if i is not None else ():
            holders[key(line)].add(i)
    often = {k: max(ids) for k, ids in holders.items() if len(k) >= min_chars and len(ids) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if i is None or often.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=str)


LONG = "a line of more than twenty characters"


def line_rows(seed):
    rng = random.Random(seed)
    pool = [f"shared line number {n} of the pool" for n in range(30)] + ["short", "", " ", "É" * 20, "e" * 19, "e" * 20]
    dress = lambda x: rng.choice(["", " ", "\t", "\r", "\x0c\x0b"]) + (x.upper() if rng.random() < 0.3 and x.isascii() else x) + rng.choice(["", " ", "\r"])
    rows = [(rng.randrange(40) if rng.random() > 0.1 else None, "\n".join(dress(rng.choice(pool)) for _ in range(rng.randrange(12)))) for _ in range(60)]
    return rows + rows[:3] + [(100, None), (101, ""), (102, "\n"), (103, f"{LONG}\n{LONG}"), (104, LONG), (-5, f"x\n{LONG}"), (105, "\n".join(f"long text line number {n} {n}" for n in range(5000)))]


@pytest.mark.parametrize("seed, batches, fan", [(1, 1, 2), (2, 3, 2), (3, 8, 3)])
def test_lines_equal_brute_force(spark, seed, batches, fan):
    rows = line_rows(seed)
    got = linedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), batches=batches, fan=fan).select("doc_id", "lines.*").collect()
    assert sorted(map(tuple, got), key=str) == kept_lines(rows)


def test_a_line_of_a_third_of_all_documents(spark):
    rows = [(i, f"{LONG}\nown line {i} of this document alone" if i % 3 == 0 else f"own line {i} of this document alone") for i in range(900)]
    got = linedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), batches=3).select("doc_id", "lines.*").collect()
    assert sorted(map(tuple, got), key=str) == kept_lines(rows)


def test_lines_empty_tables_and_clashing_names(spark):
    assert linedup.deduplicated(spark.createDataFrame([], DOCS)).count() == 0
    odd = spark.createDataFrame([(1, f"{LONG}", "x", 1, 2, 3), (2, LONG, "y", 1, 2, 3), (3, LONG, "z", 1, 2, 3)], "doc_id long, text string, lines string, _h1 int, _drop int, _row int")
    got = sorted(map(tuple, linedup.deduplicated(odd).select("doc_id", "_h1", "_drop", "_row", "lines.kept").collect()))
    assert got == [(1, 1, 2, 3, ""), (2, 1, 2, 3, ""), (3, 1, 2, 3, LONG)]


def test_runs_are_compacted_by_level(spark):
    runs = linedup.Runs(spark, buckets=2, fan=2)
    seen = []
    for n in range(5):
        batch = spark.createDataFrame([(h, -h, 0) for h in range(n * 3, n * 3 + 6)], "_h1 long, _h2 long, _owner long")
        seen.append(sorted(r["_h1"] for r in runs.add(runs.unseen(batch)).collect()))
        runs.compact()
    assert seen == [[0, 1, 2, 3, 4, 5], [6, 7, 8], [9, 10, 11], [12, 13, 14], [15, 16, 17]]
    assert [len(level) for level in runs.levels] == [1, 0, 1] and sorted(r["_h1"] for run in runs for r in run.collect()) == list(range(18))
    plan = runs.unseen(batch)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and plan.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1  # the batch alone moves
    runs.close()


# --- sources --------------------------------------------------------------------
def divergences(rows, min_docs, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    times, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = [t.translate(FOLD) for t in term.findall(text or "")]
        times[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        p = {}
        for s in [*sources, None]:
            n = {t: sum(times[lang, x][t] for x in ([s] if s is not None else sources)) for t in kept}
            p[s] = {t: 1 + 10**9 * (n[t] + 2) // (sum(n.values()) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(p[s][t], p[None][t]), t.encode()) for t in kept if times[lang, s][t] and p[s][t] > p[None][t])[:top]
            out += [(lang, s, part, i.decode(), -v, n) for part, found in (("pair", pairs), ("term", terms)) for n, (v, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed, min_docs", [(1, 1), (2, 4), (3, 10)])
def test_divergences_equal_brute_force(spark, seed, min_docs):
    rng = random.Random(seed)
    words = [*"the of and Zeit été naïve ÉTÉ x y z don't a-b".split(), *(f"{chr(97 + n)}{chr(97 + m)}" for n in range(6) for m in range(6))]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", "é", None]), rng.choice([None, ""]) if rng.random() < 0.1 else rng.choice([" ", "\n", "0"]).join(rng.choices(words, k=rng.randrange(1, 40)))) for _ in range(120)]
    rows += [("fr", "alone", "seul"), ("it", "one", None), ("it", "two", "123"), ("en", "big", "word " * 20000), *[("en", "a", "copies of a text")] * 12]
    got = divergence.audited(spark.createDataFrame(rows, "lang string, source string, text string").repartition(3), min_docs, 5).collect()
    assert sorted(map(tuple, got)) == divergences(rows, min_docs, 5)


def test_divergences_of_empty_tables_and_other_columns(spark):
    assert divergence.audited(spark.createDataFrame([], DOCS)).count() == 0
    odd = spark.createDataFrame([("en", s, "same words", 1, 2, 3) for s in "ab"], "lang string, source string, text string, n int, term int, rank int")
    assert sorted(map(tuple, divergence.audited(odd, 1).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_counts_are_handed_on_in_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD", 3)
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 3, "source": ["a", "b", "a"], "text": [b"one Two three", b"two two", b"one ONE four five"]})
    total = Counter()
    for out in divergence._counted(iter([batch])):
        for r in out.to_pylist():
            total[r["source"], r["term"], "n"] += r["n"]
            total[r["source"], r["term"], "docs"] += r["docs"]
    assert total["a", b"one", "n"] == 3 and total["a", b"one", "docs"] == 2 and total["b", b"two", "n"] == 2 and total["b", b"two", "docs"] == 1


# --- trie -----------------------------------------------------------------------
def trie_rows(arrays):
    """arrays: id -> list of (role, text)."""
    members = defaultdict(list)
    for c, turns in arrays.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    ends = lambda k, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(arrays[c]) == len(k)).encode()).hexdigest()
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], ends(k, m)) for k, m in members.items()), key=str)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def talks(seed, n):
    rng = random.Random(seed)
    said = [("user", "hi"), ("user", "é" * 7), ("assistant", ""), ("", "hi"), ("user", "1:x"), ("user1:", "x")]
    out = {}
    for c in rng.sample(range(-300, 3000), n):
        out[c] = [rng.choice(said[:2] if rng.random() < 0.5 else said) for _ in range(rng.choice([1, 2, 2, 3, 5, 9]))] if rng.random() > 0.3 else [said[0], said[2], said[1]]
    return out


def flat(arrays):
    return [(c, i if i else None, role or None, text or None) for c, turns in arrays.items() for i, (role, text) in enumerate(turns)]


@pytest.fixture()
def parted(spark):
    """Range partitions that stay as many as they are."""
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")

    def to(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")

    yield to
    for key, value in zip(("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"), before, strict=True):
        spark.conf.set(key, value)


@pytest.mark.parametrize("seed, n, parts", [(1, 1, 1), (2, 60, 1), (3, 200, 5), (4, 300, 23), (5, 40, 60)])
def test_trie_equals_brute_force(spark, parted, seed, n, parts):
    parted(parts)
    arrays = talks(seed, n)
    got = trie.nodes(trie.turn_arrays(spark.createDataFrame(flat(arrays), "conv_id long, turn long, role string, text string").repartition(3))).select(NODE).collect()
    assert sorted(map(tuple, got), key=str) == trie_rows(arrays)


def test_copies_and_a_long_conversation_across_tasks(spark, parted):
    parted(7)
    arrays = {c: [("user", f"turn {d}") for d in range(400)] for c in (5, 9, 1)} | {c: [("user", "same"), ("assistant", "same too")] for c in range(100, 900)} | {7: [("user", "same")]}
    got = trie.nodes(trie.turn_arrays(spark.createDataFrame(flat(arrays), "conv_id long, turn long, role string, text string"))).select(NODE).collect()
    assert sorted(map(tuple, got), key=str) == trie_rows(arrays)


def test_grafts_follow_the_rule(spark):
    import zlib

    own = talks(6, 150) | {100: [("user", f"head {d}") for d in range(9)], 200: [("user", "only one")]}
    got = trie.nodes(trie.grafted(trie.turn_arrays(spark.createDataFrame(flat(own), "conv_id long, turn long, role string, text string")))).select(NODE).collect()
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = own.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + turns[h:]
    assert [] in made.values() and sorted(map(tuple, got), key=str) == trie_rows(made)


def test_trie_of_odd_tables(spark):
    kind = "conv_id long, turn long, role string, text string, n int, key int, digest int"
    assert trie.nodes(trie.turn_arrays(spark.createDataFrame([], kind))).count() == 0
    odd = spark.createDataFrame([(None, 0, "user", "lost", 1, 1, 1), (3, 1, "user", "b", 1, 1, 1), (3, None, None, None, 1, 1, 1), (3, 1, "user", "b", 1, 1, 1)], kind)
    assert sorted(map(tuple, trie.nodes(trie.turn_arrays(odd)).select(NODE).collect()), key=str) == trie_rows({3: [("", ""), ("user", "b"), ("user", "b")]})


def test_equal_turns_are_in_a_fixed_order(spark):
    rows = [(c, 1, "user", t) for c, order in ((1, "ab"), (2, "ba")) for t in order]
    found = trie.turn_arrays(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert found[0]["turns"] == found[1]["turns"]
