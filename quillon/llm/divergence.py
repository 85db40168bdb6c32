"""How far sources use words apart: exact divergences from joint count histograms.

Each language keeps its common terms. For a pair of sources of a language the terms
are tallied by their two counts (a joint count histogram), and the divergence of a
term is evaluated once for each distinct combination, times the terms that have it.
Combinations with a zero come from the histograms of single sources by inclusion
and exclusion, so only terms that both sources use are ever paired, in the task
that holds the term, and summed there before they are shuffled.

Words are counted in Python, on the bytes of a batch of texts, into bounded tables;
all else is DataFrame functions. All arithmetic is on integers (38 digits).
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import stored

# What p counts in, and what is added to a count and, for each term, to their sum.
UNIT, PRIOR, PRIOR_SUM = 1_000_000_000, 2, 2
# Fixed value: a term is a run of ASCII letters and bytes from 128 on; A-Z are folded.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Entries of the table of counts that a task fills before it hands them on.
HELD = 1 << 18
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of batches (lang, source, text as bytes)."""
    times: dict = defaultdict(Counter)
    docs: dict = defaultdict(Counter)

    def handed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), n in times.items():
            terms, d = list(n), docs[lang, source]
            for at in range(0, len(terms), 1 << 16):
                some = terms[at:at + (1 << 16)]
                columns = [[lang] * len(some), [source] * len(some), some, [n[t] for t in some], [d[t] for t in some]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, COUNTS, strict=True)], schema=COUNTS)
        times.clear()
        docs.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            terms = text.translate(FOLDED).split(b" ")
            one = set(terms)
            one.discard(b"")
            if not one:
                continue
            n, d = times[lang, source], docs[lang, source]
            before = len(n)
            n.update(filter(None, terms))
            d.update(one)
            held += len(n) - before
            if held >= HELD:
                yield from handed_on()
                held = 0
    yield from handed_on()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (rows that hold the term)."""
    texts = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    found = texts.mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    return found.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _wide(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def _div(a: Column, b: Column) -> Column:
    """The whole quotient; both sides are wide and not negative."""
    return F.call_function("div", a, b)


def share(n: Column, total: Column, terms: Column) -> Column:
    """p: 1 + floor(UNIT * (n + PRIOR) / (total + PRIOR_SUM * terms)), exactly."""
    return F.lit(1) + _div(F.lit(UNIT) * _wide(n + PRIOR), _wide(total + PRIOR_SUM * terms))


def gap(p: Column, q: Column) -> Column:
    """f: floor((p - q)^2 / (p + q)), exactly."""
    return _div(_wide(p - q) * _wide(p - q), _wide(p + q))


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """lang, term, n_lang, by_source (source, n; in order): the terms found in at
    least ``min_docs`` rows of their language."""
    found = term_counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("_d"), F.sum("n").alias("n_lang"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("by_source"))
    return found.filter(F.col("_d") >= min_docs).drop("_d")


def joint_counts(terms: DataFrame) -> DataFrame:
    """lang, s, t, a, b, m: terms that source s uses a times and t, after it in
    order, b times; only terms that both use."""
    first = terms.select("lang", "by_source", F.posexplode("by_source").alias("_i", "_x"))
    both = first.select("lang", F.col("_x.source").alias("s"), F.col("_x.n").alias("a"), F.explode(F.slice("by_source", F.col("_i") + 2, F.size("by_source"))).alias("_y"))
    return both.groupBy("lang", "s", F.col("_y.source").alias("t"), "a", F.col("_y.n").alias("b")).agg(F.count(F.lit(1)).alias("m"))


def _cells(joint: DataFrame, counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """lang, s, t, a, b, m: all combinations of counts of a pair, zeros included.

    Terms that only s uses are those it uses less those both use, and so on: every
    table adds or takes away terms of a cell, and what is left is the cell.
    """
    zero = F.lit(0).cast("long")
    cell = lambda a, b, m: F.struct(a.alias("a"), b.alias("b"), m.alias("m"))
    a, b, m = F.col("a"), F.col("b"), F.col("m")
    parts = [joint.select("lang", "s", "t", F.explode(F.array(cell(a, b, m), cell(a, zero, -m), cell(zero, b, -m), cell(zero, zero, m))).alias("c"))]
    n, k = F.col("n"), F.col("k")
    for side, own in (("s", cell(n, zero, k)), ("t", cell(zero, n, k))):
        of = pairs.select("lang", "s", "t").join(counts.withColumnRenamed("source", side), ["lang", side])
        parts.append(of.select("lang", "s", "t", F.explode(F.array(own, cell(zero, zero, -k))).alias("c")))
    parts.append(pairs.select("lang", "s", "t", cell(zero, zero, F.col("terms")).alias("c")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("lang", "s", "t", "c.a", "c.b").agg(F.sum("c.m").alias("m")).filter("m <> 0")


def audited(docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank for every (lang, source) of ``docs``.

    Part ``pair``: item is another source of the language, value the sum of
    :func:`gap` over all kept terms, the most different first. Part ``term``: the
    ``top`` kept terms that the source uses more than its language does, by their
    gap to the language. Ties go by the item's bytes. A null lang, source or text is
    empty; every row is a document, also those that repeat one; a source without
    terms, or in a language that keeps none, still has its pairs. Other columns are
    not looked at. An empty table gives an empty table.
    """
    terms = stored(kept_terms(docs, min_docs))
    counts = stored(terms.select("lang", F.explode("by_source").alias("x")).groupBy("lang", "x.source", "x.n").agg(F.count(F.lit(1)).alias("k")))
    languages = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n_lang").alias("total_lang"))
    totals = counts.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("k")).alias("total"))
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = groups.join(languages, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = stored(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("terms", "total", "total_lang")]))
    left = groups.select("lang", F.col("source").alias("s"), "terms", F.col("total").alias("total_s"))
    pairs = left.join(groups.select("lang", F.col("source").alias("t"), F.col("total").alias("total_t")), "lang").filter("s < t")
    pairs = stored(pairs)
    f = gap(share(F.col("a"), F.col("total_s"), F.col("terms")), share(F.col("b"), F.col("total_t"), F.col("terms")))
    apart = _cells(joint_counts(terms), counts, pairs).join(pairs, ["lang", "s", "t"]).groupBy("lang", "s", "t").agg(F.sum(F.col("m") * f).alias("value"))
    apart = pairs.select("lang", "s", "t").join(apart, ["lang", "s", "t"], "left").select("lang", "s", "t", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    both_ways = F.explode(F.array(F.struct(F.col("s").alias("source"), F.col("t").alias("item")), F.struct(F.col("t").alias("source"), F.col("s").alias("item"))))
    apart = apart.select("lang", both_ways.alias("p"), "value").select("lang", "p.source", F.lit("pair").alias("part"), "p.item", "value")
    used = terms.select("lang", "term", "n_lang", F.explode("by_source").alias("x")).select("lang", "term", "n_lang", "x.source", "x.n").join(groups, ["lang", "source"])
    used = used.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), share(F.col("n"), F.col("total"), F.col("terms")).alias("_p"), share(F.col("n_lang"), F.col("total_lang"), F.col("terms")).alias("_q"))
    used = used.filter("_p > _q").select("lang", "source", "part", "item", gap(F.col("_p"), F.col("_q")).alias("value"))
    line = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    used = used.withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= top)
    return apart.withColumn("rank", F.row_number().over(line)).unionByName(used)
