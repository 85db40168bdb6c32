"""Keyed tables kept in buckets and versions: pull and push of rows, safe to retry.

A store is a folder. A change rewrites only the buckets that its keys fall into, in
a new folder, and then adds one commit record that names the folder of every bucket.
Readers go by the newest record, so they see all of a change or nothing, and a
change whose number is committed already is not made again: a stream's retried
batch, or one that ran after a restart, leaves the table as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.sources.scratch import deleted

BUCKET = "_bucket"


class Store:
    """A table with ``keys``, hashed into ``buckets`` by ``bucket_by`` (the keys, or some of them)."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, keys: list[str], buckets: int = 64, bucket_by: list[str] | None = None):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.bucket_by = list(bucket_by or keys)
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- commit records ------------------------------------------------------------
    def versions(self) -> list[int]:
        where = self._path(f"{self.path}/commits")
        if not self._fs.exists(where):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in self._fs.listStatus(where) if s.getPath().getName().endswith(".json"))

    def commit(self, version: int | None = None) -> dict:
        """The record of a version, by default the newest; of an empty store if there is none."""
        found = self.versions()
        if version is None:
            version = found[-1] if found else None
        if version is None:
            return {"version": -1, "epoch": None, "buckets": {}}
        if version not in found:
            raise ValueError(f"no version {version}")
        stream = self._fs.open(self._path(f"{self.path}/commits/{version:012d}.json"))
        try:
            return json.loads(stream.readUTF())
        finally:
            stream.close()

    def _record(self, version: int, epoch: int | None, buckets: dict[str, str]) -> None:
        # creating fails if another writer was first: two changes never share a version
        stream = self._fs.create(self._path(f"{self.path}/commits/{version:012d}.json"), False)
        try:
            stream.writeUTF(json.dumps({"version": version, "epoch": epoch, "buckets": buckets}))
        finally:
            stream.close()

    # --- reading ---------------------------------------------------------------------
    def bucket_of(self) -> Column:
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")

    def _rows(self, record: dict, only: list[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/{f}" for b, f in record["buckets"].items() if only is None or int(b) in only]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, by default the newest."""
        return self._rows(self.commit(version))

    def fetch(self, wanted: DataFrame, version: int | None = None) -> DataFrame:
        """Rows of the wanted keys; reads the buckets of these keys only. A wanted key
        that is not stored has nulls."""
        record = self.commit(version)
        wanted = wanted.select(*self.keys).distinct()
        touched = [r[0] for r in wanted.select(self.bucket_of()).distinct().collect()]  # at most one a bucket
        return wanted.join(self._rows(record, touched), self.keys, "left").select(*self.schema.fieldNames())

    # --- changing --------------------------------------------------------------------
    def change(self, changes: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], epoch: int | None = None) -> bool:
        """Replaces the rows of the buckets that ``changes`` fall into by ``how`` (rows
        there now, changes). Returns False if ``epoch`` was committed before."""
        record = self.commit()
        if epoch is not None and record["epoch"] is not None and epoch <= record["epoch"]:
            return False
        touched = [r[0] for r in changes.select(self.bucket_of()).distinct().collect()]
        buckets = dict(record["buckets"])
        if touched:
            now = how(self._rows(record, touched), changes).select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
            folder = f"data/{record['version'] + 1:012d}-{uuid.uuid4().hex}"
            now.withColumn(BUCKET, self.bucket_of()).repartition(len(touched), BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
            for b in touched:
                there = f"{folder}/{BUCKET}={b}"
                buckets.pop(str(b), None)
                if self._fs.exists(self._path(f"{self.path}/{there}")):
                    buckets[str(b)] = there
        self._record(record["version"] + 1, record["epoch"] if epoch is None else epoch, buckets)
        return True

    def put(self, rows: DataFrame, epoch: int | None = None, order: str | None = None) -> bool:
        """Inserts and replaces rows by key. Of rows that repeat a key the one with the
        largest ``order`` counts, or any fixed one; other columns of ``rows`` are left out."""
        names = self.schema.fieldNames()
        rest = [c for c in names if c not in self.keys]
        rank = F.struct(*([order] if order else []), *rest)
        one = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), rank).alias("_row")).select(*self.keys, "_row.*") if rest else rows.select(*self.keys).distinct()

        def merged(now: DataFrame, new: DataFrame) -> DataFrame:
            return now.join(new.select(*self.keys), self.keys, "left_anti").select(*names).unionByName(new.select(*names))

        return self.change(one, merged, epoch)

    def remove(self, gone: DataFrame, epoch: int | None = None) -> bool:
        """Deletes the rows of these keys."""
        return self.change(gone.select(*self.keys).distinct(), lambda now, keys: now.join(keys, self.keys, "left_anti"), epoch)

    def vacuum(self, keep: int = 1) -> None:
        """Deletes commit records but the newest ``keep``, and the files that no record names."""
        found = self.versions()
        named = {f for v in found[-keep:] for f in self.commit(v)["buckets"].values()}
        for v in found[:-keep]:
            self._fs.delete(self._path(f"{self.path}/commits/{v:012d}.json"), False)
        where = self._path(f"{self.path}/data")
        if not self._fs.exists(where):
            return
        for write in self._fs.listStatus(where):
            name = write.getPath().getName()
            parts = [s.getPath().getName() for s in self._fs.listStatus(write.getPath()) if s.isDirectory()]
            used = [p for p in parts if f"data/{name}/{p}" in named]
            for p in [""] if not used else [p for p in parts if p not in used]:
                deleted(self.spark, f"{self.path}/data/{name}/{p}".rstrip("/"))


class ParameterStore:
    """Rows of embedding tables outside the cache: what is evicted is pushed, what is
    new is pulled, by (table, id)."""

    def __init__(self, spark: SparkSession, path: str, columns: str, buckets: int = 64):
        self.columns = [f.name for f in T._parse_datatype_string(columns).fields]
        self.store = Store(spark, path, f"table string, id long, {columns}", ["table", "id"], buckets)

    def evict(self, rows: DataFrame, epoch: int | None = None) -> bool:
        """Pushes rows (table, id, columns)."""
        return self.store.put(rows, epoch)

    def pull(self, ids: DataFrame, default: Column | None = None) -> DataFrame:
        """ids (table, id) with their columns; those never pushed get ``default`` for the first column, or null."""
        got = self.store.fetch(ids)
        if default is None:
            return got
        first = self.columns[0]
        return got.withColumn(first, F.coalesce(first, default.cast(self.store.schema[first].dataType)))


def storing(store: Store, order: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that puts a stream's rows into a store, each batch once."""

    def apply(batch: DataFrame, number: int) -> None:
        store.put(batch, number, order)

    return apply
