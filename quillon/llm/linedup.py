"""Lines that many documents share, dropped everywhere but in one document.

Levelled sorted runs: documents come in batches, from the largest id down. A
batch's line hashes are merge-anti-joined with the runs of all batches before; what
is left is new, belongs to the largest document that holds it, and becomes a run of
its own. When a level has ``fan`` runs, they are merged into one of the next level.
Runs are tables bucketed and sorted by hash, so a batch is shuffled to them and they
stay where they are. All other occurrences are repeats; a line with enough of them
goes wherever it is a repeat.

A hash has 128 bits. Everything is DataFrame functions; a line that a third of all
documents hold is one row a task before it is shuffled, and one of at most HOT
broadcast rows where its occurrences are looked up.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import drop_path, forget, shared_path, stored

# What is stripped from a line's ends, and the letters that are folded.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

HASH = ["_h1", "_h2"]
#: Line hashes that a bucket of a run is made for.
PER_BUCKET = 1_000_000
#: Lines with more than 1 / HOT of all repeats, of which there are fewer than HOT, are broadcast.
HOT = 1000


def line_key(line: Column) -> Column:
    """What makes lines equal: stripped of ASCII white space, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


class Runs:
    """Sorted runs of hashes in levels; no hash is in two runs."""

    def __init__(self, spark: SparkSession, buckets: int = 8, fan: int = 3):
        if fan < 2:
            raise ValueError("a level holds at least two runs")
        self.spark, self.buckets, self.fan = spark, buckets, fan
        self.levels: list[list[str]] = []

    def __iter__(self) -> Iterator[DataFrame]:
        for level in reversed(self.levels):
            for name in level:
                yield self.spark.table(name)

    def _written(self, rows: DataFrame) -> str:
        name = f"quillon_run_{uuid.uuid4().hex}"
        path = shared_path(self.spark)
        rows.repartition(self.buckets, *HASH).write.format("parquet").option("path", path).bucketBy(self.buckets, *HASH).sortBy(*HASH).saveAsTable(name)
        atexit.register(drop_path, self.spark, path)
        return name

    def _dropped(self, name: str) -> None:
        files = self.spark.table(name).inputFiles()
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        if files:
            drop_path(self.spark, files[0].rsplit("/", 1)[0])

    def unseen(self, rows: DataFrame) -> DataFrame:
        """The rows whose hash is in no run, merged with one run after the other."""
        rows = rows.repartition(self.buckets, *HASH)
        for run in self:
            rows = rows.join(run.select(*HASH).hint("merge"), HASH, "left_anti")
        return rows

    def add(self, rows: DataFrame) -> DataFrame:
        """``rows``, whose hashes are in no run, as a run of the lowest level."""
        name = self._written(rows)
        self.levels = self.levels or [[]]
        self.levels[0].append(name)
        return self.spark.table(name)

    def compact(self) -> None:
        """Merges the runs of each full level into one of the next; the tables that
        :meth:`add` returned may be gone then."""
        for level in range(len(self.levels)):
            if len(self.levels[level]) < self.fan:
                return
            first, *rest = old = self.levels[level]
            merged = self.spark.table(first)
            for run in rest:
                merged = merged.unionByName(self.spark.table(run))
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._written(merged))
            self.levels[level] = []
            for run in old:
                self._dropped(run)

    def close(self) -> None:
        """Gives the files of all runs back."""
        for level in self.levels:
            for name in level:
                self._dropped(name)
        self.levels = []


def _occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, _t (a hash of the text), _pos, and the hash of each line that counts."""
    lines = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("_t"), F.posexplode(F.split("text", "\n", -1)).alias("_pos", "_line"))
    keys = lines.filter(F.length("_line") >= min_chars).select("doc_id", "_t", "_pos", line_key(F.col("_line")).alias("_key")).filter(F.length("_key") >= min_chars)
    return keys.select("doc_id", "_t", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit("second"), "_key").alias("_h2"))


def _cuts(found: DataFrame, batches: int) -> list:
    """Ids at which batches end, the largest first."""
    at = found.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 100 * batches)).first()[0] if batches > 1 else None
    return sorted(set(at or []), reverse=True)


def repeats(found: DataFrame, batches: int, fan: int) -> list[DataFrame]:
    """Of the lines found (doc_id, hash, ...), those of a batch each that are not of
    the largest document holding the line; stored."""
    runs = Runs(found.sparkSession, max(8, -(-found.count() // PER_BUCKET)), fan)
    edges = _cuts(found, batches)
    out = []
    for above, upto in zip([*edges, None], [None, *edges], strict=True):
        batch = found
        if above is not None:
            batch = batch.filter(F.col("doc_id") > above)
        if upto is not None:
            batch = batch.filter(F.col("doc_id") <= upto)
        firsts = batch.groupBy(*HASH).agg(F.max("doc_id").alias("_owner"))
        own = runs.add(runs.unseen(firsts)).withColumnRenamed("_owner", "doc_id")
        out.append(stored(batch.join(own, [*HASH, "doc_id"], "left_anti")))
        runs.compact()
    runs.close()
    return out


def dropped_positions(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 8, fan: int = 3) -> DataFrame:
    """doc_id, _t, _drop: the positions of the lines that go, for each text that
    loses any; stored."""
    found = stored(_occurrences(docs, min_chars))
    parts = repeats(found, batches, fan)
    again = parts[0]
    for p in parts[1:]:
        again = again.unionByName(p)
    often = again.groupBy(*HASH).agg(F.count_distinct("doc_id").alias("_n"), F.count(F.lit(1)).alias("_rows"))
    often = stored(often.filter(F.col("_n") >= min_docs - 1))
    least = (often.agg(F.sum("_rows")).first()[0] or 0) // HOT + 1
    hot = F.broadcast(often.filter(F.col("_rows") >= least).select(*HASH))
    cold = often.filter(F.col("_rows") < least).select(*HASH)
    gone = again.join(hot, HASH, "left_semi").unionByName(again.join(hot, HASH, "left_anti").join(cold.hint("merge"), HASH, "left_semi"))
    out = stored(gone.groupBy("doc_id", "_t").agg(F.collect_set("_pos").alias("_drop")))
    for t in (found, often, *parts):
        forget(t)
    return out


def deduplicated(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 8, fan: int = 3, into: str = "lines") -> DataFrame:
    """``docs`` with ``into``: a struct of n_lines, n_dropped and kept, the text
    without its repeated lines.

    A text is split at line feeds; a null text is one empty line. Lines whose key
    (:func:`line_key`) has at least ``min_chars`` code points and is found in at least
    ``min_docs`` documents go, except in the document with the largest id that
    holds it, where all of them stay. Rows that repeat an id are one document, each
    with its own text. A row without id counts for no line and loses none. A column
    of the name ``into`` is replaced; others pass through, whatever they are called.
    Texts are shuffled once, with the positions that they lose; these are a set
    difference of numbers, so long texts cost no more a line than short ones. An
    empty table gives an empty table.
    """
    drops = dropped_positions(docs, min_chars, min_docs, batches, fan)
    kept = [c for c in docs.columns if c != into]
    rows = docs.select(F.struct(*kept).alias("_row"), F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    # rows without id lose nothing: they go round the join, where they would be one key
    named = rows.filter("_id IS NOT NULL").withColumn("_t", F.xxhash64("_text"))
    named = named.join(drops.withColumnRenamed("doc_id", "_id"), ["_id", "_t"], "left").select("_row", "_text", "_drop")
    rows = named.unionByName(rows.filter("_id IS NULL").select("_row", "_text", F.lit(None).cast("array<int>").alias("_drop")))
    rows = rows.withColumn("_lines", F.split(F.coalesce("_text", F.lit("")), "\n", -1))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop")), lambda i: F.get("_lines", i))
    rows = rows.withColumn("_kept", F.when(F.col("_drop").isNull(), F.coalesce("_text", F.lit(""))).otherwise(F.array_join(left, "\n")))
    counts = F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped")
    return rows.select("_row.*", F.struct(*counts, F.col("_kept").alias("kept")).alias(into))
