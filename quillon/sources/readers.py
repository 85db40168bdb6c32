"""Sources with explicit schemas: click logs, ratings, sequence logs, random data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.expressions import hex_id, modulo_hash, uniform, whole_number
from quillon.operators.prefix import running_total
from quillon.operators.prep import contiguous_ids, encoded
from quillon.sources.scratch import Scratch

# The columns of a click log.
INTS = [f"int_{i}" for i in range(13)]
CATS = [f"cat_{i}" for i in range(26)]


def click_log(spark: SparkSession, paths: list[str] | str, labelled: bool = True, hashed: bool = False) -> DataFrame:
    """Tab-separated click logs without header. Numbers that cannot be read are
    0, missing categories "" (or 0 with ``hashed``); without a label it is -1."""
    names = (["label"] if labelled else []) + INTS + CATS
    raw = spark.read.csv(paths, sep="\t", schema=T.StructType([T.StructField(n, T.StringType()) for n in names]))
    return typed_clicks(raw, labelled, hashed, "_metadata.file_path")


def typed_clicks(raw: DataFrame, labelled: bool = True, hashed: bool = False, *keep: str) -> DataFrame:
    """The columns of a click log from text: label, 13 numbers, 26 categories, and
    columns to ``keep``."""
    label = whole_number(F.col("label"), "int", 0) if labelled else F.lit(-1)
    cats = [(hex_id(F.col(c)) if hashed else F.coalesce(c, F.lit(""))).alias(c) for c in CATS]
    return raw.select(label.alias("label"), *[whole_number(F.col(c), "int", 0).alias(c) for c in INTS], *cats, *[F.col(c).alias("path") if c.startswith("_metadata") else F.col(c) for c in keep])


def click_days(spark: SparkSession, days: list[list[str] | str], labelled: bool = True, hashed: bool = False) -> DataFrame:
    """Click logs of consecutive days with ``day`` and ``stage``: all days but the
    last are train, the first half (rounded up) of the last day's rows val, the rest
    test. Rows keep the order of the files; they are numbered within file splits."""
    logs = [click_log(spark, p, labelled, hashed).withColumn("day", F.lit(i)) for i, p in enumerate(days)]
    last = logs[-1].withColumn("_at", F.monotonically_increasing_id())
    placed = running_total(last, ["_at"], F.shiftright("_at", 33), F.lit(1).cast("long"), "_row").drop("_at")
    cut = F.floor((F.lit(logs[-1].count()) + 1) / 2)
    staged = placed.withColumn("stage", F.when(F.col("_row") < cut, "val").otherwise("test")).drop("_row")
    return concatenated([*[x.withColumn("stage", F.lit("train")) for x in logs[:-1]], staged])


def shifted_logs(clicks: DataFrame, by: str, ints: list[str] = INTS) -> DataFrame:
    """The numbers of each file as logarithms, shifted so that the least number of the
    file, over all of ``ints``, becomes ln 2. ``by`` names the file; null is a file too.
    The least ones, a row a file, are sent to the clicks, which are not shuffled; missing
    numbers stay so."""
    least = clicks.groupBy(F.col(by).alias("_by")).agg(*[F.min(c).alias(f"_{c}") for c in ints])
    least = least.select("_by", F.least(*[F.col(f"_{c}") for c in ints], F.lit(None).cast("long")).alias("_least"))
    met = clicks.join(F.broadcast(least), F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    return met.withColumns({c: F.log(F.col(c).cast("double") - F.col("_least") + 2).cast("float") for c in ints}).drop("_least")


def converted_clicks(spark: SparkSession, paths: list[str] | str, into: str, labelled: bool = True, sizes: list[int] | None = None) -> DataFrame:
    """Text click logs into one typed table, written to ``into`` and read back: label,
    13 shifted logarithms, 26 category ids (modulo ``sizes``, if given), partitioned by ``file``.

    The text is parsed once, into whole numbers; their least ones and the logarithms come from
    that table. Files are replaced one by one: files that are not among ``paths`` stay as they are,
    and doing it again changes nothing. Files of one name in different folders are an error.
    """
    if sizes is not None and len(sizes) != len(CATS):
        raise ValueError("there is a size for each category")
    name = F.regexp_extract(F.col("path"), r"[^/]+$", 0)
    scratch = Scratch(spark)
    try:
        clicks = scratch.stored(click_log(spark, paths, labelled, hashed=True).withColumn("file", name))
        twice = clicks.groupBy("file").agg(F.count_distinct("path").alias("n")).filter("n > 1").select("file").head()
        if twice:
            raise ValueError(f"several files are called {twice[0]}")
        done = shifted_logs(clicks, "file").drop("path")
        if sizes is not None:
            done = done.withColumns({c: modulo_hash(F.col(c), n) for c, n in zip(CATS, sizes, strict=True)})
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").parquet(into)
    finally:
        scratch.clear()
    return spark.read.schema(done.schema).parquet(into)


def shape(spark: SparkSession, path: str) -> tuple[int, int]:
    """Rows and columns of a Parquet table; rows are counted from footers."""
    df = spark.read.parquet(path)
    return df.count(), len(df.columns)


def prepared_clicks(clicks: DataFrame, row: str, threshold: int = 1, ints: list[str] = INTS, cats: list[str] = CATS) -> DataFrame:
    """Features for training: numbers below 0 or missing are 0 and all become
    ln(x + 1); of each category the values seen at least ``threshold`` times get the
    ids 2, 3, ... in the order of their first row, others 1."""
    out = clicks.withColumns({c: F.log1p(F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("double")) for c in ints})
    for c in cats:
        out = encoded(out, contiguous_ids(clicks, c, [row], threshold), c)
    return out


def ratings(spark: SparkSession, root: str, movies: bool = False) -> DataFrame:
    """ratings.csv, and with ``movies`` the columns of movies.csv."""
    r = spark.read.csv(f"{root}/ratings.csv", header=True, schema="userId int, movieId int, rating double, timestamp long")
    if not movies:
        return r
    from quillon.operators.lookup import ratings_with_movies

    m = spark.read.csv(f"{root}/movies.csv", header=True, schema="movieId int, title string, genres string")
    return ratings_with_movies(r, m.withColumn("_at", F.monotonically_increasing_id()), "movieId", "_at")


def sequence_log(df: DataFrame, columns: list[str]) -> DataFrame:
    """JSON lists as arrays of bigint."""
    return df.withColumns({c: F.from_json(c, "array<bigint>") for c in columns})


def csv_lines(spark: SparkSession, paths: list[str] | str, schema: str, skip_first: bool = False, sep: str = ",") -> DataFrame:
    return spark.read.csv(paths, schema=schema, header=skip_first, sep=sep)


def files(spark: SparkSession, paths: list[str] | str, binary: bool = False) -> DataFrame:
    """Paths with their content: whole binary files, or lines of text."""
    if binary:
        return spark.read.format("binaryFile").load(paths)
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), "value")


def concatenated(sources: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, sources)


def row_range(df: DataFrame, row: str, start: int, n: int) -> DataFrame:
    """Rows [start, start + n); a range outside the table is an error."""
    last = df.agg(F.max(row)).first()[0]
    if start < 0 or n <= 0 or last is None or start + n > last + 1:
        raise ValueError("the range is outside the table")
    return df.filter((F.col(row) >= start) & (F.col(row) < start + n))


def random_examples(spark: SparkSession, keys: list[str], rows: int, hash_sizes: list[int], ids_per_feature: list[int] | None = None,
                    dense: int = 0, least: int = 0, seed: int = 0) -> DataFrame:
    """Examples with uniform bags, standard normal dense values and a 0/1 label,
    all functions of the row and the seed."""
    u = lambda *k: uniform(F.col("row_id"), *k, seed=seed)
    def bag(i: int, size: int) -> Column:
        n = F.lit(ids_per_feature[i]) if ids_per_feature else (least + F.floor(u(F.lit(i)) * 10)).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda j: F.floor(u(F.lit(i + 1000), j) * size))).otherwise(F.array().cast("array<bigint>"))
    def normal(i: int) -> Column:
        return F.sqrt(-2.0 * F.log(1.0 - u(F.lit(i + 2000)))) * F.cos(2.0 * F.pi() * u(F.lit(i + 3000)))
    return spark.range(rows).withColumnRenamed("id", "row_id").select(
        "row_id", *[bag(i, s).alias(k) for i, (k, s) in enumerate(zip(keys, hash_sizes, strict=True))],
        *[normal(i).alias(f"dense_{i}") for i in range(dense)], (u(F.lit(4000)) < 0.5).cast("int").alias("label"))


def to_parquet(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
