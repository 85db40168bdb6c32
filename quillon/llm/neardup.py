"""Near-duplicate documents by SetSketch registers, confirmed on full shingle sets.

A document's set of k-word shingles is sketched in REGISTERS registers
floor(1 - log_B(min)), where min is the least of the elements' exponential
values under the register's hash, truncated to a byte. Registers are mergeable
and agree more often the more similar two sets are; BANDS bands of ROWS registers
put documents into buckets. For two documents the numbers of registers that are
larger, smaller and equal give the similarity of greatest likelihood. Pairs
whose estimate is hopeless are dropped, all others are confirmed on full sets.

At similarity 0.8 a register agrees with probability 0.816 and a pair misses all
buckets with probability 2e-6, at 0.85 with 1e-8.

Groups of any size. Documents with equal sets are one node from the start. First
each node is compared with one leader of each of its buckets only, its two best
leaders are confirmed, and linked nodes become components; then once more with
other leaders. After that, only pairs between different components of a bucket
are of interest, and within a bucket only those of which one node is not of its
main component, so that a large component is read once for every BLOCK outsiders.
What comes out of a bucket is a row for each node and other component that it
resembles (its best partner there and the number of plausible ones), not the
pairs. The best are confirmed. Nodes still apart from a component are then held
against all its members through its representative r: the sets' differences from
r, counted in BINS bins, bound the number of shingles that two sets can share.
Only pairs that this exact bound and the sketches leave are listed, and all of
them are confirmed on full sets or found to be within one component. So no link
between different components is lost, and no group is expanded into all its pairs.

Nulls: a null or wordless text has an empty set and is linked with nothing. Rows
with equal ids are one node, whose set is that of the row with the least hash of
its set; a row without id is linked with nothing and kept. Empty table: no rows.
Extra columns are kept by :func:`deduplicated` and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import Cache, bounded, forget, forget_since, stored, written

K = 4
PERCENT = 80
BASE, RATE, TOP = 1.2, 20.0, 254
ROWS, BANDS = 7, 48
REGISTERS = ROWS * BANDS
#: Estimates below this are not confirmed. Their error at 0.8 has a standard
#: deviation of 0.021: this is nearly six of them, so that a link is missed here
#: about as often (1e-8) as by all bands (2e-6 at 0.8, 1e-8 at 0.85).
HOPELESS = 0.68
#: Members of a bucket that are compared by a join, and of a block of larger ones.
SMALL, BLOCK = 16, 1024
BINS = 256
#: Rows and shingles that a task holds before it passes them on.
PART, PART_SHINGLES = 512, 1 << 19
#: Rounds of stars, masks by which leaders are chosen, and leaders that a node is held against in a round.
STARS, MASKS, LEADERS = 2, 8, 4
#: Bits of the bitmap of nodes whose texts are read again: 8 MiB.
SIEVE = 1 << 26
SEED = 20240607


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingler(k: int = K):
    """text -> sorted distinct 64-bit shingle hashes."""
    import xxhash

    of = Cache(xxhash.xxh3_64_intdigest).__getitem__

    def shingles(text: str | None) -> np.ndarray:
        # bytes know ASCII letters and the six spaces only
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, dtype=np.uint64)
        w = np.fromiter(map(of, words), dtype=np.uint64, count=len(words))
        wide = min(k, len(w))
        h = np.full(len(w) - wide + 1, wide, dtype=np.uint64)
        for j in range(wide):
            h = _finish(h * np.uint64(0x9E3779B97F4A7C15) + w[j:len(w) - wide + 1 + j])
        return np.unique(h)

    return shingles


def sketcher(registers: int = REGISTERS):
    """sorted hashes -> registers as uint8."""
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 1 << 31, (registers, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    c = rng.integers(0, 1 << 32, (registers, 1), dtype=np.uint32)

    def sketch(h: np.ndarray) -> np.ndarray:
        low = np.full(registers, np.iinfo(np.uint32).max, dtype=np.uint32)
        h = (h >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(h), 512):
            np.minimum(low, (a * h[None, at:at + 512] + c).min(axis=1), out=low)
        u = (low.astype(np.float64) + 1.0) / 2.0**32
        e = -np.log1p(-np.minimum(u, 1 - 1e-9)) / RATE
        return np.clip(np.floor(1 - np.log(np.maximum(e, 1e-300)) / np.log(BASE)), 0, TOP + 1).astype(np.uint8)

    return sketch


def likeliest(above: np.ndarray, below: np.ndarray, n_u: np.ndarray, n_v: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Similarity of greatest likelihood for counts of larger and smaller
    registers of sketches of sets of known sizes."""
    u = (n_u / (n_u + n_v))[:, None]
    j = np.linspace(0, 1, 81)[None, :] * np.minimum(n_u / n_v, n_v / n_u)[:, None]
    p = lambda x: -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - (1 - u) * j), p((1 - u) - u * j)
    same = registers - above - below
    ll = above[:, None] * np.log(up) + below[:, None] * np.log(down) + same[:, None] * np.log(np.maximum(1 - up - down, 1e-12))
    return j[np.arange(len(j)), ll.argmax(axis=1)]


def signatures(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_shingles, key (of the whole set; null if empty), sketch, bands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        shingles, sketch = shingler(k), sketcher()
        place = np.uint64(256) ** np.arange(ROWS, dtype=np.uint64)
        tag = np.arange(BANDS, dtype=np.uint64) << np.uint64(8 * ROWS)
        def frame(out: list) -> pd.DataFrame:
            return pd.DataFrame(out, columns=["doc_id", "n_shingles", "key", "sketch", "bands"]).astype({"doc_id": "Int64"})

        out: list = []
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                h = shingles(text)
                if len(h):
                    s = sketch(h)
                    bands = (s.reshape(BANDS, ROWS).astype(np.uint64) @ place) | tag
                    out.append((doc_id, len(h), xxhash.xxh3_128_digest(h.tobytes()), s.tobytes(), bands.astype(np.int64)))
                else:
                    out.append((doc_id, 0, None, None, None))
                if len(out) >= PART:
                    yield frame(out)
                    out.clear()
        yield frame(out)

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        run, "doc_id long, n_shingles long, key binary, sketch binary, bands array<long>")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """node, key, shingles: the full sets of ``docs`` (node, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        shingles, out, held = shingler(k), [], 0
        frame = lambda: pd.DataFrame(out, columns=["node", "key", "shingles"])
        for batch in batches:
            for node, text in zip(batch["node"], batch["text"], strict=True):
                h = shingles(text)
                out.append((node, xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None, h.view(np.int64)))
                held += len(h)
                if len(out) >= PART or held >= PART_SHINGLES:
                    yield frame()
                    out, held = [], 0
        yield frame()

    return bounded(docs).select("node", "text").mapInPandas(run, "node long, key binary, shingles array<long>")


def _sieved(rows: DataFrame, need: DataFrame) -> DataFrame:
    """``rows`` (node, ...) without most nodes that are not in ``need`` (node).

    To be followed by an inner join: a semi-join would be moved below the sieve.
    A bitmap of SIEVE bits marks the hashes of what is needed; its size does not
    depend on the data, so it is broadcast, and texts that nobody needs are not
    shuffled. With more nodes than bits it lets more through, never less.
    """
    at = F.pmod(F.xxhash64("node"), F.lit(SIEVE))
    marks = stored(need.filter("node IS NOT NULL").groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits")))
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(bit / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
    met = rows.join(F.broadcast(marks), F.bitmap_bucket_number(at) == F.col("_bucket"))
    return met.filter(F.getbit(byte, (bit % 8).cast("int")) == 1).drop("_bucket", "_bits")


def _estimate_of(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="float64")
    x = np.frombuffer(b"".join(a), dtype=np.uint8).reshape(len(a), -1)
    y = np.frombuffer(b"".join(b), dtype=np.uint8).reshape(len(b), -1)
    return pd.Series(likeliest((x > y).sum(axis=1), (x < y).sum(axis=1), n_a.to_numpy(dtype=float), n_b.to_numpy(dtype=float)))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b), where a component
    is named by its smallest node: large-star and small-star rounds, each
    written to the shared folder, until nothing changes."""
    e = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = lambda d: tuple(d.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    before = state(e)
    while before[0]:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = stored(small.union(least.select("a", F.col("m").alias("b"))).distinct(), instead_of=e)
        after = state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.select("a", "b").join(x, "a").join(y, "b").withColumn("i", F.size(F.array_intersect("x", "y")).cast("long"))
    return both.filter(100 * F.col("i") >= percent * (F.size("x") + F.size("y") - F.col("i"))).select("a", "b")


def _stars(members: DataFrame, comps: DataFrame, turn: int) -> DataFrame:
    """(a, b): nodes and their buckets' leaders, where these are in different
    components. A bucket's leader is its least id under a mask; there are MASKS
    masks, so that a large group has a few leaders, not one in every bucket nor
    one for each. Of a node's leaders the LEADERS that share most of its buckets
    count, which are the likeliest; visits look at all that this leaves apart."""
    m = members.join(comps, "node")
    mask = F.xxhash64(F.lit(turn), F.pmod(F.shiftrightunsigned("band", 8 * ROWS), F.lit(MASKS)))
    first = F.min(F.struct(F.col("node").bitwiseXOR(mask).alias("k"), F.col("comp").alias("c")))
    lead = m.groupBy("band").agg(first.alias("lead"), F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y")
    lead = lead.select(F.col("band").alias("_band"), F.col("lead.k").alias("k"), F.col("lead.c").alias("comp_b"))
    met = m.join(lead, F.col("band") == F.col("_band")).filter("comp <> comp_b")
    shared = met.groupBy(F.col("node").alias("a"), F.col("k").bitwiseXOR(mask).alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    most = Window.partitionBy("a").orderBy(F.desc("shared"), "b")
    return shared.withColumn("r", F.row_number().over(most)).filter(F.col("r") <= LEADERS).select("a", "b")


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components, with these."""
    a = comps.select(F.col("node").alias("a"), F.col("comp").alias("comp_a"))
    b = comps.select(F.col("node").alias("b"), F.col("comp").alias("comp_b"))
    return pairs.join(a, "a").join(b, "b").filter("comp_a <> comp_b")


def _estimated(pairs: DataFrame, sketches: DataFrame, percent: int, *keep: str) -> DataFrame:
    """Pairs (a, b) that are plausible by size and sketch: a, b, estimate, and
    columns to ``keep``."""
    side = lambda c: sketches.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    estimate = F.pandas_udf(_estimate_of, "double")
    return both.withColumn("estimate", estimate("s_a", "s_b", "n_a", "n_b")).filter(F.col("estimate") >= HOPELESS).select("a", "b", "estimate", *keep)


def _visits(members: DataFrame, comps: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """v, target, m, estimate, n: nodes, another component of one of their buckets,
    their best partner there, and how many plausible ones there are. Of two
    components the nodes of the smaller one visit the larger.

    Buckets of up to SMALL members are joined with themselves, so that a member
    meets at most SMALL others. Of larger ones the nodes that are not of their main
    component (outsiders) are cut into blocks of about BLOCK, all members as well,
    and each pair of blocks is one group, compared in memory; a pair is looked at in
    its first common bucket.
    """
    sized = comps.join(comps.groupBy(F.col("comp").alias("_c")).agg(F.count(F.lit(1)).alias("csize")), F.col("comp") == F.col("_c")).select("node", "comp", "csize")
    per = members.join(comps, "node").groupBy("band", "comp").agg(F.count(F.lit(1)).alias("k"))
    main = per.groupBy(F.col("band").alias("_band")).agg(F.sum("k").alias("size"), F.max(F.struct("k", "comp")).alias("x"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    main = main.select("_band", "size", F.col("x.comp").alias("main"), (F.col("size") - F.col("x.k")).alias("others"))
    m = stored(members.join(main, F.col("band") == F.col("_band")).join(sized, "node").select("band", "node", "comp", "csize", "size", "main", "others"))
    few = m.filter(F.col("size") <= SMALL)
    other = few.select(F.col("band").alias("_band"), F.col("node").alias("b"), F.col("comp").alias("comp_b"), F.col("csize").alias("csize_b"))
    met = few.withColumnRenamed("node", "a").join(other, (F.col("band") == F.col("_band")) & (F.col("a") < F.col("b")) & (F.col("comp") != F.col("comp_b")))
    met = met.groupBy("a", "b").agg(*[F.first(c).alias(c) for c in ("comp", "csize", "comp_b", "csize_b")])
    first = F.struct("csize", "comp") < F.struct("csize_b", "comp_b")
    small = _estimated(met, sketches, percent, "comp", "csize", "comp_b", "csize_b").select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("v"), F.when(first, F.col("comp_b")).otherwise(F.col("comp")).alias("target"),
        F.when(first, F.col("b")).otherwise(F.col("a")).alias("m"), "estimate", F.lit(1).cast("long").alias("n"))

    big = m.filter(F.col("size") > SMALL).join(sketches, "node")
    of_all, of_others = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("size", "others"))
    block = lambda blocks: F.pmod(F.xxhash64("node"), blocks.cast("long")).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), blocks - 1))
    columns = ["node", "n", "sketch", "comp", "csize", "main"]
    left = big.filter("comp <> main").select("band", block(of_others).alias("i"), each(of_all).alias("j"), F.lit(True).alias("outsider"), *columns)
    right = big.select("band", each(of_others).alias("i"), block(of_all).alias("j"), F.lit(False).alias("outsider"), *columns)

    def compare(key, g: pd.DataFrame) -> pd.DataFrame:
        band, out = key[0], []
        o, g = g[g["outsider"]].sort_values("node"), g[~g["outsider"]].sort_values("node")
        node, comp, n, csize = (g[c].to_numpy() for c in ("node", "comp", "n", "csize"))
        s = np.frombuffer(b"".join(g["sketch"]), dtype=np.uint8).reshape(len(g), -1)
        for v, cv, nv, sv, kv, main in zip(o["node"], o["comp"], o["n"], o["sketch"], o["csize"], o["main"], strict=True):
            own = np.frombuffer(sv, dtype=np.uint8)
            rest = np.flatnonzero((comp != cv) & ((comp == main) | (node > v)) & (100 * np.minimum(n, nv) >= percent * np.maximum(n, nv)))
            if not len(rest):
                continue
            same = (s[rest] == own).reshape(len(rest), BANDS, ROWS).all(axis=2)
            rest = rest[same.argmax(axis=1) == band >> (8 * ROWS)]
            if not len(rest):
                continue
            est = likeliest((own > s[rest]).sum(axis=1), (own < s[rest]).sum(axis=1), np.full(len(rest), float(nv)), n[rest].astype(float))
            rest, est = rest[est >= HOPELESS], est[est >= HOPELESS]
            ahead = (csize[rest] > kv) | ((csize[rest] == kv) & (comp[rest] > cv))  # v visits their component
            out += [(v, comp[x], node[x], e, 1) if f else (node[x], cv, v, e, 1) for x, e, f in zip(rest, est, ahead, strict=True)]
        found = pd.DataFrame(out, columns=["v", "target", "m", "estimate", "n"]).astype({"v": "int64", "target": "int64", "m": "int64", "estimate": "float64", "n": "int64"})
        found = found.sort_values(["estimate", "m"], ascending=[False, True], kind="stable")
        return found.groupby(["v", "target"], as_index=False).agg({"m": "first", "estimate": "first", "n": "sum"})

    large = left.unionByName(right).groupBy("band", "i", "j").applyInPandas(compare, "v long, target long, m long, estimate double, n long")
    return small.union(large).groupBy("v", "target").agg(F.max(F.struct("estimate", -F.col("m"))).alias("x"), F.sum("n").alias("n")).select(
        "v", "target", (-F.col("x.col2")).alias("m"), F.col("x.estimate").alias("estimate"), "n")


def _possible(visits: DataFrame, parts: DataFrame, sets: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """a, b, estimate: of the pairs of a visitor v and the members of its target
    (``parts``: node, comp), those whose sketches and sets can be similar enough.

    With r a set, D(x) the difference of x and r, and c the number of shingles that
    D(x) and D(y) have in common, x and y differ in D(x) + D(y) - 2 c places. The
    sums over bins of the smaller counts of D(x) and D(y), added and missing apart,
    are at least c; so the test below never drops a similar pair. r is the node by
    which the target is named.
    """
    x = sets.select(F.col("node").alias("_x"), F.col("shingles").alias("x"))
    r = sets.select(F.col("node").alias("_r"), F.col("shingles").alias("r"))
    bins = lambda z, at: F.transform(z, lambda h: (F.pmod(F.shiftright(h, 20), F.lit(BINS)) + at).cast("smallint"))
    targets = visits.select("target").distinct()
    inside = parts.join(targets, F.col("comp") == F.col("target")).select("target", "node", F.lit(False).alias("visits"))
    rows = visits.select("target", F.col("v").alias("node"), F.lit(True).alias("visits")).union(inside)
    rows = rows.join(x, F.col("node") == F.col("_x")).join(r, F.col("target") == F.col("_r"))
    rows = rows.select("target", "node", "visits", F.concat(bins(F.array_except("x", "r"), 0), bins(F.array_except("r", "x"), BINS)).alias("d")).join(sketches, "node")
    sizes = rows.groupBy(F.col("target").alias("_t")).agg(F.ceil(F.count_if("visits") / BLOCK).cast("int").alias("vs"), F.ceil(F.count_if(~F.col("visits")) / BLOCK).cast("int").alias("ms"))
    rows = rows.join(sizes, F.col("target") == F.col("_t"))
    block = lambda blocks: F.pmod(F.xxhash64("node"), F.col(blocks).cast("long")).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    columns = ["visits", "node", "n", "sketch", "d"]
    left = rows.filter("visits").select("target", block("vs").alias("i"), each("ms").alias("j"), *columns)
    right = rows.filter("NOT visits").select("target", each("vs").alias("i"), block("ms").alias("j"), *columns)

    def compare(key, g: pd.DataFrame) -> pd.DataFrame:
        v, g = g[g["visits"]], g[~g["visits"]]
        out: list = []
        counted = lambda ds: np.array([np.bincount(d, minlength=2 * BINS) for d in ds], dtype=np.int32).reshape(len(ds), 2 * BINS)
        node, n, bins = g["node"].to_numpy(), g["n"].to_numpy(), counted(g["d"])
        s, size = np.frombuffer(b"".join(g["sketch"]), dtype=np.uint8).reshape(len(g), -1), bins.sum(axis=1)
        for name, nv, sv, d in zip(v["node"], v["n"], v["sketch"], counted(v["d"]), strict=True):
            most = (100 - percent) * (n + nv) // (100 + percent)  # places in which similar sets differ, at most
            rest = np.flatnonzero((np.abs(size - d.sum()) <= most) & (node != name))
            rest = rest[size[rest] + d.sum() - 2 * np.minimum(bins[rest], d).sum(axis=1) <= most[rest]]
            if len(rest):
                own = np.frombuffer(sv, dtype=np.uint8)
                est = likeliest((own > s[rest]).sum(axis=1), (own < s[rest]).sum(axis=1), np.full(len(rest), float(nv)), n[rest].astype(float))
                out += [(name, node[x], e) for x, e in zip(rest, est, strict=True) if e >= HOPELESS]
        return pd.DataFrame(out, columns=["a", "b", "estimate"]).astype({"a": "int64", "b": "int64", "estimate": "float64"})

    return left.unionByName(right).groupBy("target", "i", "j").applyInPandas(compare, "a long, b long, estimate double")


def _merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` (node, comp) after joining the components that ``links`` connect."""
    a = comps.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
    b = comps.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    edges = links.join(a, "a").join(b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    renamed = components(edges).select(F.col("node").alias("comp"), F.col("component").alias("to"))
    return stored(comps.join(renamed, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")))


def near_duplicates(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles,
    component_id (smallest id reachable over links) and kept. The result is a stored
    table; those on the way to it are given back."""
    mark = written()
    signed = stored(signatures(docs, k))
    named = signed.filter("key IS NOT NULL AND doc_id IS NOT NULL")
    repeats = not named.groupBy("doc_id").count().filter("count > 1").isEmpty()
    if repeats:
        named = stored(named.groupBy("doc_id").agg(F.min(F.struct("key", "n_shingles", "sketch", "bands")).alias("x")).select("doc_id", "x.*"))
    # stored, so that the join shuffles both sides for itself and can split a key of many copies
    groups = stored(named.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "rep"))
    of = stored(named.select("doc_id", "key").join(groups, "key", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep")))
    nodes = named.join(of.filter("doc_id = rep").select(F.col("rep").alias("_rep")), F.col("doc_id") == F.col("_rep")).select(
        F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "sketch", "bands")
    banded = nodes.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select(F.col("band").alias("_band"))
    members = stored(banded.join(buckets, F.col("band") == F.col("_band")).select("band", "node"))
    sketches = stored(nodes.join(members.select("node").distinct(), "node").select("node", "n", "sketch"))
    comps = stored(sketches.select("node", F.col("node").alias("comp")))
    sets = None

    def with_sets(need: DataFrame) -> DataFrame:
        """The sets so far and those of further nodes (node)."""
        need = need.distinct()
        if sets is not None:
            need = need.join(sets, "node", "left_anti")
        texts = _sieved(docs.select(F.col("doc_id").cast("long").alias("node"), "text"), need).join(need, "node")
        new = _sets(texts, k).filter("key IS NOT NULL")
        new = stored(new.groupBy("node").agg(F.min_by("shingles", "key").alias("shingles")) if repeats else new.select("node", "shingles"))
        return new if sets is None else sets.union(new)

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("node")).union(pairs.select("b"))

    # stars: every node against a leader of each of its buckets, the best two confirmed
    best = Window.partitionBy("a").orderBy(F.desc("estimate"), "b")
    for turn in range(STARS):
        pairs = _estimated(_stars(members, comps, turn), sketches, percent)
        pairs = stored(pairs.withColumn("r", F.row_number().over(best)).filter("r <= 2").select("a", "b"))
        sets = with_sets(ends(pairs))
        comps = _merged(comps, _confirmed(pairs, sets, percent))

    # visits: nodes against the other components of their buckets, the best partner confirmed
    visits = stored(_visits(members, comps, sketches, percent))
    forget(members)
    tried = visits.select(F.col("v").alias("a"), F.col("m").alias("b"))
    sets = with_sets(ends(tried))
    parts = comps
    comps = _merged(comps, _confirmed(tried, sets, percent))

    # what is still apart and has more than that partner: every pair that can be similar
    now = comps.select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
    there = comps.select(F.col("node").alias("_t"), F.col("comp").alias("_tc"))
    open_ = visits.filter("n > 1").join(now, F.col("v") == F.col("_n")).join(there, F.col("target") == F.col("_t")).filter("_c <> _tc")
    open_ = stored(open_.select("v", "target"))
    if not open_.isEmpty():
        sets = with_sets(open_.select(F.col("v").alias("node")).union(parts.join(open_.select("target").distinct(), F.col("comp") == F.col("target")).select("node")))
        todo, few = stored(_possible(open_, parts, sets, sketches, percent)), 4
        while not todo.isEmpty():
            order = Window.partitionBy(F.least("comp_a", "comp_b"), F.greatest("comp_a", "comp_b")).orderBy(F.desc("estimate"), "a", "b")
            todo = stored(_apart(todo, comps).withColumn("r", F.row_number().over(order)))
            links = stored(_confirmed(todo.filter(F.col("r") <= few), sets, percent))
            if not links.isEmpty():
                comps = _merged(comps, links)
            todo, few = todo.filter(F.col("r") > few).select("a", "b", "estimate"), few * 16

    found = of.join(comps.select(F.col("node").alias("rep"), "comp"), "rep", "left").select("doc_id", F.coalesce("comp", "rep").alias("component"))
    rows = signed.select("doc_id", "n_shingles").join(found.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left")
    component: Column = F.coalesce("component", "doc_id")
    result = stored(rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")))
    forget_since(docs.sparkSession, mark, result)
    return result


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the near-duplicates: one document of each component stays."""
    gone = near_duplicates(docs, **options).filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
