"""Metrics over a stream: lifetime sums and a ring of the last batches, kept in a store.

A trigger's rows are summed by group and batch first, in Spark, so a hot task is one row a
partition before it is shuffled. The sums are added to the group's lifetime and to
its ring; batches leave the ring when newer ones fill the window. Both live in one
:class:`quillon.sources.store.Store` whose versions are snapshots: a stream that
starts again goes on from the last one, and a trigger that is retried adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators.metrics import Suite
from quillon.operators.ranking import sliding_batches
from quillon.sources.store import Store

# Fixed value: batches that a ring holds at most.
MOST_BATCHES = 1000


class MetricState:
    """State of a suite for each group of ``by``; input rows have ``by``, ``batch``,
    label, prediction and weight."""

    def __init__(self, spark: SparkSession, path: str, suite: Suite, window: int, by: dict[str, str], batch: str = "batch", most: int = MOST_BATCHES, buckets: int = 16):
        self.suite, self.window, self.by, self.batch, self.most = suite, window, list(by), batch, most
        sums = {f"s_{k}": "double" for m in suite.metrics.values() for k in m.states} | {"s_valid": "long", "s_rows": "long"}
        fields = [*by.items(), ("_live", "boolean"), (batch, "long"), *sums.items()]
        schema = T._parse_datatype_string(", ".join(f"`{c}` {t}" for c, t in fields))
        self.sums = list(sums)
        self.store = Store(spark, path, schema, [*self.by, "_live", batch], buckets, self.by)

    def _summed(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in self.sums])

    def absorb(self, rows: DataFrame, epoch: int | None = None) -> bool:
        """Adds rows; usable as a foreachBatch function. A group without a batch number
        counts for its lifetime only."""
        parts = self.suite.states(rows.withColumn(self.batch, F.col(self.batch).cast("long")), [*self.by, self.batch])
        counts = rows.groupBy(*self.by, F.col(self.batch).cast("long").alias(self.batch)).agg(F.count(F.lit(1)).alias("s_rows"))
        same = [parts[c].eqNullSafe(counts[c]) for c in [*self.by, self.batch]]
        new = parts.join(counts, same).select(*[parts[c] for c in [*self.by, self.batch]], *[c for c in self.sums])

        def merged(now: DataFrame, new: DataFrame) -> DataFrame:
            columns = [*self.by, "_live", self.batch, *self.sums]
            new = new.withColumn("_live", F.lit(True)).filter(F.col(self.batch).isNotNull()).select(*columns).unionByName(
                self._summed(new, self.by).withColumn("_live", F.lit(False)).withColumn(self.batch, F.lit(None).cast("long")).select(*columns))
            both = self._summed(now.select(*columns).unionByName(new), [*self.by, "_live", self.batch])
            ring = sliding_batches(both.filter("_live"), self.batch, "s_rows", self.window, self.by, self.most)
            return ring.select(*columns).unionByName(both.filter("NOT _live").select(*columns))

        return self.store.change(new, merged, epoch)

    def values(self, version: int | None = None) -> DataFrame:
        """by, lifetime_* and window_* of a version, by default the newest. A window
        that holds no batch (the last one alone is larger) has nulls."""
        rows = self.store.read(version)
        whole = self.suite.values(self._summed(rows.filter("NOT _live"), self.by), self.by)
        ring = self.suite.values(self._summed(rows.filter("_live"), self.by), self.by)
        names = [c for c in whole.columns if c not in self.by]
        whole = whole.select(*self.by, *[F.col(c).alias(f"lifetime_{c}") for c in names])
        ring = ring.select(*[F.col(c).alias(f"_r_{c}") for c in self.by], *[F.col(c).alias(f"window_{c}") for c in names])
        return whole.join(ring, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in self.by], "left").drop(*[f"_r_{c}" for c in self.by])

    def follow(self, stream: DataFrame, checkpoint: str):
        """Starts a stream into this state over all that is there now."""
        query = stream.writeStream.foreachBatch(lambda rows, n: self.absorb(rows, n) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return query
