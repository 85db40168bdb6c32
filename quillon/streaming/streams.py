"""Structured Streaming: event-time windows, sessions, and id remapping with state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def event_time(events: DataFrame, column: str = "ts", late: str = "1 hour") -> DataFrame:
    """Event time as a timestamp, with a watermark."""
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def windowed_metrics(events: DataFrame, suite, width: str, slide: str | None = None, column: str = "ts") -> DataFrame:
    """A metric suite over event-time windows; works on streams and tables."""
    w = F.window(column, width, slide) if slide else F.window(column, width)
    states = suite.states(events.withColumn("w", w), ["w"])
    return suite.values(states, ["w"])


def sessions(events: DataFrame, user: str, gap: str, column: str = "ts") -> DataFrame:
    """Rows per user and session, which ends after a pause of ``gap``."""
    return events.groupBy(F.session_window(column, gap).alias("s"), user).agg(F.count(F.lit(1)).alias("n"))


REMAP_STATE = "ids array<long>, slots array<long>, counts array<long>, last array<long>"


def remap_stream(ids: DataFrame, buckets: int, slots_per_bucket: int, decay: float = 1.0) -> DataFrame:
    """A stream of (id, hour) remapped to bounded slots: each hash bucket keeps
    its state and evicts once a trigger by count over age. Output: id, hour, slot, hit; ids
    without a slot get the bucket's last one."""
    import numpy as np
    import pandas as pd

    def step(key, frames, state):
        table: dict[int, list] = {}
        if state.exists:
            a, b, c, d = state.get
            table = {i: [s, n, t] for i, s, n, t in zip(a, b, c, d, strict=True)}
        chunks = [pdf for pdf in frames if len(pdf)]
        if chunks:
            # one eviction for a trigger's rows, however they are cut into chunks
            now = int(max(pdf["hour"].max() for pdf in chunks))
            known = set(table)
            for pdf in chunks:
                for i, n in pdf["id"].value_counts(sort=False).items():
                    entry = table.setdefault(int(i), [-1, 0, now])
                    entry[1] += int(n)
                    entry[2] = now
            best = sorted(table, key=lambda i: (-table[i][1] / (now - table[i][2] + 1) ** decay, table[i][0] < 0, i))
            keep = set(best[:slots_per_bucket - 1])
            table = {i: table[i] for i in sorted(keep)}
            free = iter(sorted(set(range(slots_per_bucket - 1)) - {e[0] for e in table.values()}))
            for i in best:
                if i in keep and table[i][0] < 0:
                    table[i][0] = next(free)
            base = int(key[0]) * slots_per_bucket
            for pdf in chunks:
                slot = np.array([base + (table[i][0] if i in table else slots_per_bucket - 1) for i in pdf["id"]])
                yield pd.DataFrame({"id": pdf["id"], "hour": pdf["hour"], "slot": slot, "hit": [i in known for i in pdf["id"]]})
        items = list(table.items())
        state.update(([i for i, _ in items], *[[e[j] for _, e in items] for j in range(3)]))

    keyed = ids.select(F.col("id").cast("long").alias("id"), F.col("hour").cast("long").alias("hour")).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    return keyed.groupBy("bucket").applyInPandasWithState(step, "id long, hour long, slot long, hit boolean", REMAP_STATE, "append", "NoTimeout")


PROBE_STATE = "owner array<long>, until array<long>, hours array<long>, ids array<long>, homes array<long>"
HOUR_MS = 3_600_000


def probe_stream(events: DataFrame, size: int, buckets: int, probe: int, ttl_hours: int, dispatch: str = "threshold", time: str = "ts") -> DataFrame:
    """A stream of (id, event time with a watermark) through multi-probe hash slots:
    id, hour, slot, kind, as :func:`quillon.operators.remap.probed` gives them.

    A bucket's state is its table and the ids of hours that are not over. A timer
    ends an hour when the watermark passes it; then its ids take their places in
    order, each once. So the result does not depend on how the stream is cut into
    triggers, and what comes later than the watermark is left out. State is
    bounded by the bucket's places and the ids of the hours within the watermark.
    """
    import pandas as pd

    from quillon.operators.remap import ProbeTable, probe_home

    room = size // buckets
    bucket, home = probe_home(F.col("id"), buckets, room)

    def step(key, frames, state):
        owner, until, waiting = None, None, set()
        if state.exists:
            owner, until, hours, ids, homes = state.get
            owner, until, waiting = list(owner), list(until), set(zip(hours, ids, homes, strict=True))
        table = ProbeTable(room, probe, ttl_hours, dispatch, owner, until)
        for pdf in frames:
            waiting.update((int(h), int(i), int(p)) for h, i, p in zip(pdf["hour"], pdf["id"], pdf["home"], strict=True))
        over = state.getCurrentWatermarkMs() // HOUR_MS  # hours before this one are complete
        due = sorted(w for w in waiting if w[0] < over)
        waiting.difference_update(due)
        out = [(i, hour, key[0] * room + at, kind) for hour, i, p in due for at, kind in [table.visit(i, hour, p)]]
        rest = sorted(waiting)
        state.update((table.owner, table.until, [w[0] for w in rest], [w[1] for w in rest], [w[2] for w in rest]))
        if rest:
            state.setTimeoutTimestamp((rest[0][0] + 1) * HOUR_MS)
        yield pd.DataFrame(out, columns=["id", "hour", "slot", "kind"])

    hour = F.floor(F.unix_micros(F.col(time)) / (HOUR_MS * 1000)).cast("long")
    keyed = events.filter("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), time, hour.alias("hour"), bucket.alias("bucket"), home.cast("long").alias("home"))
    return keyed.groupBy("bucket").applyInPandasWithState(step, "id long, hour long, slot long, kind string", PROBE_STATE, "append", "EventTimeTimeout")


def run_available(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None):
    """Runs a stream over all that is there now, into a memory table ``name``."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def upserting(pool_path: str, order: str):
    """A foreachBatch function that applies updates to a pool kept in versions."""
    from quillon.operators.lookup import pool_update

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        pool = spark.read.parquet(f"{pool_path}/v{number}")
        pool_update(pool, batch, order).write.mode("overwrite").parquet(f"{pool_path}/v{number + 1}")

    return apply
