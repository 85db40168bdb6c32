"""Placement of ids and tables: bucketing, shards, exchanges, request batching."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketized(long: DataFrame, block: int, buckets: int) -> DataFrame:
    """Ids (row, key, pos, id, ...) with their bucket, their id inside it and
    their place in the bucket's bag, in the order of the bag."""
    out = long.withColumns({"bucket": F.least(F.floor(F.col("id") / block), F.lit(buckets - 1)).cast("int")})
    out = out.withColumn("local_id", F.col("id") - F.col("bucket") * block)
    return out.withColumn("bucket_pos", F.row_number().over(Window.partitionBy("row", "key", "bucket").orderBy("pos")) - 1)


def exchanged(df: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """Rows dealt to the owner of their keys: the all-to-all of the engine."""
    return df.repartition(partitions, *keys) if partitions else df.repartition(*keys)


def reduced_scatter(parts: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Partial sums of all workers added up at their owner."""
    return parts.groupBy(*by).agg(*[F.sum(v).alias(v) for v in values])


def row_shards(rows: int, world: int) -> list[tuple[int, int]]:
    """(size, offset) of row-wise shards: blocks of the rounded-up size."""
    block = -(-rows // world)
    return [(max(0, min(block, rows - i * block)), min(i * block, rows)) for i in range(world)]


def column_shards(dim: int, width: int) -> list[tuple[int, int]]:
    """(size, offset) of column-wise shards of ``width``; the rest joins the last."""
    n = max(1, dim // width)
    return [(width if i < n - 1 else dim - width * (n - 1), i * width) for i in range(n)]


def shard_table(config: DataFrame, world: int) -> DataFrame:
    """(table, rank, rows, offset) of row-wise shards of tables (table, rows)."""
    ranks = config.sparkSession.range(world).withColumnRenamed("id", "rank")
    block = F.ceil(F.col("rows") / world)
    at = F.least(F.col("rank") * block, F.col("rows"))
    return config.join(F.broadcast(ranks)).select("table", "rank", F.least(block, F.col("rows") - at).alias("shard_rows"), at.alias("offset"))


def column_slices(vec: Column, shards: list[tuple[int, int]]) -> list[Column]:
    return [F.slice(vec, at + 1, size) for size, at in shards]


def plan_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Shards of the new plan that the old one has elsewhere or not at all."""
    return new.exceptAll(old)


def write_bucketed(table: DataFrame, name: str, buckets: int, key: str = "id") -> None:
    """The table bucketed and sorted by id, so that lookups need no shuffle of it."""
    table.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def grouped_tables(config: DataFrame) -> DataFrame:
    """Tables that one lookup can serve: same type, pooling and width."""
    return config.groupBy("dtype", "pooling", "dim").agg(F.count(F.lit(1)).alias("tables"), F.sum("rows").alias("rows"), F.array_join(F.array_sort(F.collect_list("table")), ",").alias("names"))


def dim_buckets(config: DataFrame, line: int, mode: str = "cacheline") -> DataFrame:
    """A bucket for each table by the width of its rows."""
    width = F.col("dim") * F.col("bytes")
    bucket = {"single": F.lit(0), "all": F.col("dim"), "cacheline": F.ceil(width / line)}[mode]
    return config.withColumn("bucket", bucket.cast("int"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def requests_batched(requests: list[DataFrame], columns: dict[str, Column]) -> DataFrame:
    """Requests one after the other; a column that one lacks gets its default."""
    out = []
    for i, r in enumerate(requests):
        out.append(r.select(F.lit(i).alias("request"), *[(F.coalesce(F.col(c), d) if c in r.columns else d).alias(c) for c, d in columns.items()]))
    return union_all(out)


def results_split(results: DataFrame, request: str, n: int) -> list[DataFrame]:
    return [results.filter(F.col(request) == i).drop(request) for i in range(n)]
