"""Shared pieces of the text operators: word rule, stored tables, file access."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: a word is a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table under ``sf_dir``, read by Spark only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What a Python worker is handed at a time: texts are long, and a worker keeps the
#: memory of its largest batch.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864", "4194304")}


def bounded(df: DataFrame) -> DataFrame:
    """``df``, for work in Python: sets the session's Arrow batches to at most 1000
    rows and 4 MiB, where they are at Spark's defaults."""
    for key, (default, ours) in BATCHES.items():
        if df.sparkSession.conf.get(key, default).rstrip("b") == default:
            df.sparkSession.conf.set(key, ours)
    return df


def n_words(text: Column) -> Column:
    """Number of words in ``text`` as long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def _shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as spark.checkpoint.dir names it. Where it is
    unset a local folder serves in local mode (tests); on a cluster that is an error,
    as executors would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = f"file://{os.path.join(tempfile.gettempdir(), 'quillon-checkpoints')}"
    spark.sparkContext.setCheckpointDir(own)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{_shared_dir(spark)}/quillon-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if the session is still there."""
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    try:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended already; the folder is scratch space
        return


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Paths in the order in which they were stored.
_WRITTEN: list[str] = []


def stored(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Cuts the lineage so that a lost executor costs no recomputation of what
    came before, and so that later uses read only the columns they need. The
    files go when the driver's process ends, or when a later table is stored
    ``instead_of`` this one, which nothing may read from then on.
    """
    spark = df.sparkSession
    path = shared_path(spark)
    df.write.parquet(path)
    atexit.register(drop_path, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    _WRITTEN.append(path)
    if instead_of is not None:
        forget(instead_of)
    return out


def forget(df: DataFrame) -> None:
    """Deletes the files of a stored table."""
    if path := _PATHS.pop(df, None):
        drop_path(df.sparkSession, path)


def forget_since(spark: SparkSession, mark: int, keep: DataFrame) -> None:
    """Deletes the files of all tables stored after the first ``mark`` but ``keep``."""
    for path in _WRITTEN[mark:]:
        if path != _PATHS.get(keep):
            drop_path(spark, path)
    del _WRITTEN[mark:]
    _WRITTEN.append(_PATHS[keep])


def written() -> int:
    """How many tables have been stored so far."""
    return len(_WRITTEN)


def about(rows: DataFrame, n: int, there: int) -> DataFrame:
    """``n`` of the ``there`` rows (doc_id, ...), the first by a hash of the id.
    A threshold on the hash admits a little more than ``n`` rows over all tasks
    together, so that choosing among them moves little whatever the input."""
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 52))
    share = 1.0 if there <= n else min(1.0, (1.1 * n + 100) / there)
    near = rows.withColumn("_h", h).filter(F.col("_h") < int(share * (1 << 52)))
    return near.orderBy("_h", *rows.columns).limit(n).drop("_h")


def labelled_rows(labels: DataFrame, target: str, allowed: Column, per_class: int) -> tuple[DataFrame, dict]:
    """(doc_id, _y): at most ``per_class`` rows of each class 0 and 1 that
    ``allowed`` admits, chosen by :func:`about`; and the rows of each class."""
    rows = labels.filter(allowed & F.col(target).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(target).cast("int").alias("_y"))
    counts = {r[0]: r[1] for r in rows.groupBy("_y").count().collect()}
    first = [about(rows.filter(F.col("_y") == y), per_class, counts.get(y, 0)) for y in (0, 1)]
    return first[0].union(first[1]), counts


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, allowed: Column, per_class: int) -> tuple[DataFrame, dict]:
    """(doc_id, y, text) to learn from, stored, and the number of labelled rows by class.

    At most ``per_class`` rows of each class of the rows that ``allowed`` admits,
    chosen by a hash of their id, with their whole texts: at most 2 * per_class
    rows whatever the size of the corpus, so the chosen ids are broadcast. Of rows
    that repeat an id, the first by label and text counts. Null labels, ids and
    texts teach nothing.
    """
    chosen, counts = labelled_rows(labels, target, allowed, per_class)
    got = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    got = got.groupBy("doc_id").agg(F.min(F.struct(F.col("_y").alias("y"), "text")).alias("one"))
    return stored(got.select("doc_id", "one.y", "one.text")), counts


class Cache(dict):
    """What ``make`` gives for a key, kept for the first ``most`` keys: common ones come early."""

    def __init__(self, make, most: int = 1 << 17):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.most:
            self[key] = value
        return value
