"""Bounded id remapping: eviction policies, admission, slots, pruning, deltas.

State is a table (id, slot, count, last). One interval is one update: the new
ids' counts join the state, the policy scores all, the best stay and newcomers
take the freed slots in order. The last slot is reserved for misses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.expressions import uniform
from quillon.operators.ordered import n_smallest, numbered
from quillon.sources.scratch import Scratch

#: Slots that are listed and numbered together.
SLOT_BLOCK = 4096


#: Policies by name: (now, decay) -> what is kept, the largest first.
POLICIES: dict[str, Callable[[Column, float], Column]] = {
    "lfu": lambda now, decay: F.col("count").cast("double"),
    "lru": lambda now, decay: -F.pow((now - F.col("last") + 1).cast("double"), F.lit(decay)),
    "distance_lfu": lambda now, decay: F.col("count") / F.pow((now - F.col("last") + 1).cast("double"), F.lit(decay)),
}


def score(policy: str | Callable[[Column, float], Column], now: Column, decay: float = 1.0) -> Column:
    """What a policy keeps: the largest scores. A policy is a name of POLICIES or a
    function of the interval and the decay over the columns count and last."""
    if callable(policy):
        return policy(now, decay)
    if policy not in POLICIES:
        raise ValueError(f"no policy {policy!r}")
    return POLICIES[policy](now, decay)


def admitted(counts: DataFrame, rule: str | Callable[[DataFrame], DataFrame] = "all", value: float = 1.0, seed: int = 0) -> DataFrame:
    """Ids (id, count) that may enter: all; those above ``value`` times the mean
    count (average: the mean); by chance 1 - (1 - value)^count; or what a function
    of the counts returns."""
    if callable(rule):
        return rule(counts)
    if rule == "all":
        return counts
    if rule in ("average", "dynamic"):
        mean = counts.agg(F.avg("count").alias("_mean"))
        return counts.join(F.broadcast(mean)).filter(F.col("count") > F.col("_mean") * (1.0 if rule == "average" else value)).drop("_mean")
    if rule == "probabilistic":
        return counts.filter(1.0 - F.pow(F.lit(1.0 - value), F.col("count")) > uniform(F.col("id"), seed=seed))
    raise ValueError(f"no rule {rule!r}")


def free_slots(used: DataFrame, size: int, by: list[str] = (), wanted: DataFrame | None = None) -> DataFrame:
    """by, slot, _k: the slots below ``size`` that are not in ``used``, numbered from
    0 in order. Slots are listed by blocks of SLOT_BLOCK, a row each, and numbered
    over the small table of blocks. ``wanted`` (by, _n): how many are needed; blocks
    beyond them are not listed."""
    spark = used.sparkSession
    blocks = max(0, -(-size // SLOT_BLOCK))
    tables = wanted.select(*by) if by else spark.range(1).select()
    every = tables.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))) if blocks > 1 else F.lit(0)).filter(F.lit(size > 0))
    held = used.groupBy(*by, F.floor(F.col("slot") / SLOT_BLOCK).cast("int").alias("_c")).agg(F.collect_set("slot").alias("_used"))
    first = F.col("_c").cast("long") * SLOT_BLOCK
    listed = F.sequence(first, F.least(first + SLOT_BLOCK, F.lit(size).cast("long")) - 1)
    free = every.join(held, [*by, "_c"], "left").withColumn("_free", F.array_except(listed, F.coalesce("_used", F.array().cast("array<long>"))))
    before = Window.partitionBy(*by).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    starts = free.select(*by, "_c", F.size("_free").cast("long").alias("_m")).withColumn("_s", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    free = free.select(*by, "_c", "_free").join(starts, [*by, "_c"])
    if wanted is not None:
        free = (free.join(wanted, list(by)) if by else free.join(F.broadcast(wanted))).filter(F.col("_s") < F.col("_n"))
    return free.select(*by, "_s", F.posexplode("_free").alias("_i", "slot")).select(*by, "slot", (F.col("_s") + F.col("_i")).alias("_k"))


def updated(state: DataFrame, batch: DataFrame, size: int, policy: str = "lfu", now: int = 0, decay: float = 1.0, by: list[str] = (), scratch: Scratch | None = None) -> DataFrame:
    """The state after one interval's ids (id, count). ``by``: tables or buckets
    with states of their own, of ``size`` slots each.

    Residents and newcomers are joined once and written once in the whole order of
    score, slot and id, which ranks both; what is returned is a plan over that
    table, as long for the thousandth interval as for the first. :class:`Remapper`
    keeps a chain of intervals and gives the tables of earlier ones back.
    """
    keys = [*by, "id"]
    old = state.select(*keys, "slot", F.col("count").alias("c0"), F.col("last").alias("l0"))
    new = batch.select(*keys, F.col("count").alias("c1"))
    both = old.join(new, keys, "full").select(*keys, "slot", (F.coalesce("c0", F.lit(0)) + F.coalesce("c1", F.lit(0))).alias("count"),
                                               F.when(F.col("c1").isNotNull(), F.lit(now)).otherwise(F.col("l0")).alias("last"))
    both = both.withColumn("_s", score(policy, F.lit(now), decay))
    order = [F.desc("_s"), F.asc_nulls_last("slot"), "id"]
    kept = numbered(both, order, "_r", by, {"_k": F.col("slot").isNull().cast("long")}, scratch).filter(F.col("_r") < size - 1)
    stay, enter = kept.filter("slot IS NOT NULL"), kept.filter("slot IS NULL")
    wanted = (enter.groupBy(*by) if by else enter).agg(F.count(F.lit(1)).alias("_n"))
    free = free_slots(stay.select(*by, "slot"), size - 1, by, wanted)
    placed = enter.drop("slot").join(free, [*by, "_k"]).select(*keys, "slot", "count", "last")
    return stay.select(*keys, "slot", "count", "last").unionByName(placed)


class Remapper:
    """Id slots over a chain of intervals.

    The state is a stored table; an interval replaces it and gives the former one
    back. ``update`` admits, evicts and places; ``lookup`` maps ids to slots.
    """

    def __init__(self, spark: SparkSession, size: int, policy: str = "lfu", decay: float = 1.0, by: list[str] = (), rule="all", value: float = 1.0, key_types: dict[str, str] | None = None):
        self.size, self.policy, self.decay, self.by, self.rule, self.value = size, policy, decay, list(by), rule, value
        fields = "".join(f"{c} {(key_types or {}).get(c, 'string')}, " for c in by)
        self.state = spark.createDataFrame([], f"{fields}id long, slot long, count long, last int")
        self._held = Scratch(spark)

    def update(self, ids: DataFrame, now: int) -> DataFrame:
        """The state after an interval's ids, one row a use."""
        spark = ids.sparkSession
        on_the_way, held = Scratch(spark), Scratch(spark)
        counts = admitted(ids.groupBy(*self.by, "id").agg(F.count(F.lit(1)).alias("count")), self.rule, self.value)
        self.state = held.stored(updated(self.state, counts, self.size, self.policy, now, self.decay, self.by, on_the_way))
        on_the_way.clear()
        self._held.clear()
        self._held = held
        return self.state

    def lookup(self, ids: DataFrame) -> DataFrame:
        return remapped(ids, self.state, self.size, self.by)


def remapped(ids: DataFrame, state: DataFrame, size: int, by: list[str] = ()) -> DataFrame:
    """Ids with their slots; unknown ids get the reserved last slot."""
    return ids.join(state.select(*by, "id", "slot"), [*by, "id"], "left").withColumn("slot", F.coalesce("slot", F.lit(size - 1)))


def open_slots(state: DataFrame, size: int) -> DataFrame:
    return state.agg((F.lit(size - 1) - F.count(F.lit(1))).alias("open_slots"))


def modulo_owner(ids: DataFrame, size: int, order: str) -> DataFrame:
    """Slot by modulo, and the id that came first in it."""
    return ids.groupBy(F.pmod("id", F.lit(size)).alias("slot")).agg(F.min_by("id", order).alias("owner"), F.count(F.lit(1)).alias("queries"))


class ProbeTable:
    """A bucket of slots: an id takes the first free place within ``probe`` places
    after its home, around the bucket. Where none is free, ``threshold`` takes the
    first whose entry has expired and else falls back to the home, which two ids then
    share; ``oldest`` takes the entry that expires first (the nearest of equals), so that nobody shares."""

    DISPATCH = ("threshold", "oldest")

    def __init__(self, room: int, probe: int, ttl: int, dispatch: str = "threshold", owner: list | None = None, until: list | None = None):
        if dispatch not in self.DISPATCH:
            raise ValueError(f"no dispatch {dispatch!r}")
        self.room, self.probe, self.ttl, self.dispatch = room, min(probe, room), ttl, dispatch
        self.owner = owner if owner is not None else [None] * room
        self.until = until if until is not None else [-1] * room

    def visit(self, id_: int, hour: int, home: int) -> tuple[int, str]:
        """The place of an id that is used at an hour, and how it got it."""
        owner, until = self.owner, self.until
        places = [(home + j) % self.room for j in range(self.probe)]
        at, kind = next((p for p in places if owner[p] == id_), None), "hit"
        if at is None:
            at, kind = next((p for p in places if owner[p] is None), None), "inserted"
        if at is None and self.dispatch == "oldest":
            at, kind = min(places, key=lambda p: until[p]), "evicted"
        if at is None:
            at, kind = next((p for p in places if until[p] < hour), None), "evicted"
        if at is None:
            return home, "collided"
        owner[at], until[at] = id_, hour + self.ttl
        return at, kind


def probe_home(id_: Column, buckets: int, room: int) -> tuple[Column, Column]:
    """Bucket and home place of an id."""
    h = F.xxhash64(F.lit(3), id_)
    return F.pmod(h, F.lit(buckets)).cast("int"), F.pmod(F.shiftright(h, 20), F.lit(room)).cast("int")


def probed(ids: DataFrame, size: int, buckets: int, probe: int, ttl_hours: int, dispatch: str = "threshold") -> DataFrame:
    """Multi-probe hash slots (id, hour): a :class:`ProbeTable` for each bucket of
    size / buckets places, its ids in order of hour and id. An id's hours are counted
    before, and a task reads its buckets one after the other and holds one of them,
    so neither a frequent id nor a long log fills a task; give large tables many buckets."""
    import pandas as pd

    room = size // buckets
    bucket, home = probe_home(F.col("id"), buckets, room)
    seen = ids.groupBy("id", "hour").count().select("id", "hour", bucket.alias("bucket"), home.alias("home"))

    def run(frames):
        now, table = None, None
        for g in frames:
            out = []
            for i, hour, b, at_home in g.itertuples(index=False):
                if b != now:
                    now, table = b, ProbeTable(room, probe, ttl_hours, dispatch)
                at, kind = table.visit(i, hour, at_home)
                out.append((i, hour, b * room + at, kind))
            yield pd.DataFrame(out, columns=["id", "hour", "slot", "kind"])

    return seen.repartition("bucket").sortWithinPartitions("bucket", "hour", "id").mapInPandas(run, "id long, hour long, slot long, kind string")


def ttl_score(hours: Column, ttl: Column) -> Column:
    """When an entry expires, in hours."""
    return hours + ttl


def prune_map(usage: DataFrame, keep: int) -> DataFrame:
    """(id, slot): the ``keep`` most used ids get slots 0 .. keep-1, others none."""
    most = n_smallest(usage.select("id", (-F.col("count")).alias("_c")), ["_c", "id"], keep)
    return numbered(most, ["_c", "id"], "slot").select("id", "slot")


def prune_due(step: Column, interval: int, start: int = 0) -> Column:
    """Whether a training step prunes."""
    return (step > start) & (F.pmod(step - start, F.lit(interval)) == 0)


def evicted_by(policy: str, now: Column, **p) -> Column:
    """Predicate of virtual-table rows to drop: by count, timestamp, decayed
    score or norm of the vector."""
    if policy == "count":
        return F.col("count") < p["least"]
    if policy == "timestamp":
        return now - F.col("last") > p["ttl"]
    if policy == "score":
        return F.col("count") * F.pow(F.lit(p["rate"]), (now - F.col("last")).cast("double")) < p["least"]
    if policy == "count_timestamp":
        return (F.col("count") < p["least"]) & (now - F.col("last") > p["ttl"])
    if policy == "l2":
        return F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)) < p["least"]
    return F.lit(False)


# --- delta tracking ---------------------------------------------------------------
def unique_rows(deltas: DataFrame, mode: str, batch: str = "batch_idx", by: list[str] = ()) -> DataFrame:
    """One row per id: ids only (none), or its first or last state."""
    g = deltas.groupBy(*by, "id")
    if mode == "none":
        return g.agg(F.count(F.lit(1)).alias("times"))
    pick = {"first": F.min_by, "last": F.max_by}[mode]
    return g.agg(pick("state", batch).alias("state"))


def compacted(deltas: DataFrame, start: int, stop: int, mode: str = "last", batch: str = "batch_idx") -> DataFrame:
    """Batches in [start, stop) as one batch, ``start``; others stay."""
    inside = (F.col(batch) >= start) & (F.col(batch) < stop)
    one = unique_rows(deltas.filter(inside), mode, batch).withColumn(batch, F.lit(start).cast(deltas.schema[batch].dataType))
    return deltas.filter(~inside).select("id", "state", batch).unionByName(one.select("id", "state", batch))


class DeltaTracker:
    """Consumers' cursors over an append-only table of deltas."""

    def __init__(self, deltas: DataFrame, mode: str = "last", batch: str = "batch_idx"):
        self.deltas, self.mode, self.batch, self.cursors = deltas, mode, batch, {}

    def read(self, consumer: str) -> DataFrame:
        """What is new to a consumer, one row per id; its cursor moves on."""
        since = self.cursors.get(consumer, -1)
        new = self.deltas.filter(F.col(self.batch) > since)
        self.cursors[consumer] = max(since, self.deltas.agg(F.max(self.batch)).first()[0] or 0)
        return unique_rows(new, self.mode, self.batch)

    def deletable(self) -> int:
        """The last batch that all consumers have read."""
        return min(self.cursors.values(), default=-1)
