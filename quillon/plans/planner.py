"""Layout advisor: which sharding each table should have on a cluster.

Options and their costs are columns; proposals and placement are small searches
on the driver over as many rows as there are tables.
"""

from __future__ import annotations

import heapq
import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.ordered import n_smallest

SHARDINGS = ("data_parallel", "table_wise", "row_wise", "column_wise")
KERNELS = ("dense", "fused")


@dataclass(frozen=True)
class Topology:
    """The cluster: workers, bytes of memory each, bytes a second of memory and network."""

    world: int
    memory: float
    memory_bandwidth: float = 30e9
    network_bandwidth: float = 1.2e9
    reserved: float = 0.15

    @property
    def usable(self) -> float:
        return self.memory * (1 - self.reserved)


def enumerated(tables: DataFrame, topology: Topology) -> DataFrame:
    """Every table (table, rows, dim, bytes, pooling_factor, batch) under every
    sharding and kernel, with shards, bytes and seconds of each shard."""
    spark = tables.sparkSession
    options = spark.createDataFrame(list(itertools.product(SHARDINGS, KERNELS)), "sharding string, kernel string")
    t = tables.join(F.broadcast(options)).filter(~((F.col("sharding") == "data_parallel") & (F.col("kernel") == "fused")))
    w = topology.world
    shards = F.when(F.col("sharding").isin("row_wise", "data_parallel"), w).when(F.col("sharding") == "column_wise", F.greatest(F.lit(1), F.least(F.lit(w), F.floor(F.col("dim") / 4)))).otherwise(1)
    return with_costs(t.withColumn("shards", shards.cast("int")), topology)


def storage(c: str = "sharding") -> Column:
    whole = F.col("rows") * F.col("dim") * F.col("bytes")
    return F.when(F.col(c) == "data_parallel", whole).otherwise(whole / F.col("shards"))


def with_costs(options: DataFrame, topology: Topology) -> DataFrame:
    lookups = F.col("batch") * F.col("pooling_factor")
    share = F.when(F.col("sharding") == "table_wise", 1.0).otherwise(1.0 / F.col("shards"))
    read = lookups * F.col("dim") * F.col("bytes") * share
    out = F.col("batch") * F.col("dim") * F.col("bytes") * F.when(F.col("sharding") == "data_parallel", 0.0).when(F.col("sharding") == "row_wise", 1.0).otherwise(share)
    seconds = (read + out) / topology.memory_bandwidth * F.when(F.col("kernel") == "fused", 1.0).otherwise(2.0) + out / topology.network_bandwidth
    return options.withColumns({"shard_bytes": storage(), "shard_seconds": seconds})


def cache_stats(counts: DataFrame, capacity: int) -> DataFrame:
    """Expected share of lookups that a cache of the ``capacity`` hottest ids misses."""
    hot = n_smallest(counts.select("id", (-F.col("count")).alias("_c")), ["_c", "id"], capacity).agg(F.coalesce(-F.sum("_c"), F.lit(0)).alias("hits"))
    return counts.agg(F.sum("count").alias("lookups"), F.count(F.lit(1)).alias("ids")).join(F.broadcast(hot)).select(
        "lookups", "ids", (1.0 - F.col("hits") / F.col("lookups")).alias("miss_rate"))


@dataclass
class Placement:
    """Shards on workers, and the load of each worker."""

    where: dict = field(default_factory=dict)
    seconds: list = field(default_factory=list)
    memory: list = field(default_factory=list)

    @property
    def rating(self) -> float:
        return max(self.seconds, default=0.0)


def greedy(options: list[dict], topology: Topology, cap: float | None = None) -> Placement | None:
    """Largest shards first, each on the least loaded worker with room; None if
    one has no room."""
    cap = topology.usable if cap is None else cap
    p = Placement({}, [0.0] * topology.world, [0.0] * topology.world)
    shards = sorted(((o["shard_seconds"], o["shard_bytes"], o["table"], i, o["sharding"]) for o in options for i in range(o["shards"])), reverse=True)
    heap = [(0.0, r) for r in range(topology.world)]
    for s, b, t, i, kind in shards:
        held = []
        if kind in ("row_wise", "data_parallel"):
            ranks = [i]
            heap = [h for h in heap if h[1] != i]
            heapq.heapify(heap)
        else:
            ranks = []
            while heap and not ranks:
                load, r = heapq.heappop(heap)
                if p.memory[r] + b <= cap:
                    ranks = [r]
                else:
                    held.append((load, r))
        if not ranks or p.memory[ranks[0]] + b > cap:
            return None
        r = ranks[0]
        p.seconds[r] += s
        p.memory[r] += b
        p.where[t, i] = r
        for h in [*held, (p.seconds[r], r)]:
            heapq.heappush(heap, h)
    return p


def memory_balanced(options: list[dict], topology: Topology, steps: int = 12) -> Placement | None:
    """The smallest memory cap, by bisection, under which the greedy placement
    rates no worse."""
    best = greedy(options, topology)
    if best is None:
        return None
    low, high = max(best.memory) / 2, max(best.memory)
    for _ in range(steps):
        middle = (low + high) / 2
        p = greedy(options, topology, middle)
        if p and p.rating <= best.rating * 1.0001:
            best, high = p, middle
        else:
            low = middle
    return best


def proposals(options: list[dict], how: str = "greedy", most: int = 10_000):
    """Choices of one option for each table. uniform: one sharding for all;
    greedy: from the fastest, the largest table steps to its next option; grid:
    all combinations, up to ``most``."""
    by_table: dict[str, list[dict]] = {}
    for o in sorted(options, key=lambda o: (o["shard_seconds"], o["shard_bytes"])):
        by_table.setdefault(o["table"], []).append(o)
    if how == "uniform":
        for kind in SHARDINGS:
            chosen = [next((o for o in os if o["sharding"] == kind), None) for os in by_table.values()]
            if all(chosen):
                yield chosen
    elif how == "grid":
        for n, combination in enumerate(itertools.product(*by_table.values())):
            if n >= most:
                return
            yield list(combination)
    else:
        at = dict.fromkeys(by_table, 0)
        while True:
            yield [by_table[t][i] for t, i in at.items()]
            movable = [t for t, i in at.items() if i + 1 < len(by_table[t])]
            if not movable:
                return
            at[max(movable, key=lambda t: by_table[t][at[t]]["shard_bytes"])] += 1


def knapsack(options: list[dict], budget: float, bins: int = 100) -> list[dict] | None:
    """One option a table, least total seconds within ``budget`` bytes over all
    shards, by dynamic programming over memory bins."""
    by_table: dict[str, list[dict]] = {}
    for o in options:
        by_table.setdefault(o["table"], []).append(o)
    best: dict[int, tuple[float, list]] = {0: (0.0, [])}
    for os in by_table.values():
        step: dict[int, tuple[float, list]] = {}
        for used, (cost, chosen) in best.items():
            for o in os:
                b = used + max(1, -(-int(o["shard_bytes"] * o["shards"] * bins) // int(budget)))
                c = cost + o["shard_seconds"] * o["shards"]
                if b <= bins and (b not in step or c < step[b][0]):
                    step[b] = (c, [*chosen, o])
        best = step
    return min(best.values(), key=lambda x: x[0])[1] if best else None


def planned(tables: DataFrame, topology: Topology, how: tuple[str, ...] = ("greedy", "uniform")) -> tuple[list[dict], Placement]:
    """The best-rated proposal that can be placed; a ValueError tells what did not fit."""
    options = [r.asDict() for r in enumerated(tables, topology).collect()]
    best = None
    for kind in how:
        for chosen in proposals(options, kind):
            p = greedy(chosen, topology)
            if p and (best is None or p.rating < best[1].rating):
                best = (chosen, p)
    if best is None:
        need = sum(min(o["shard_bytes"] * o["shards"] for o in options if o["table"] == t) for t in {o["table"] for o in options})
        raise ValueError(f"no plan fits: at least {need:.0f} bytes are needed, {topology.usable * topology.world:.0f} are there")
    return best


def imbalance(loads: DataFrame, value: str) -> DataFrame:
    """Total variation, chi-square and KL divergence of loads from an even deal."""
    whole = loads.agg(F.sum(value).alias("_t"), F.count(F.lit(1)).alias("_n"))
    p = F.col(value) / F.col("_t")
    q = 1.0 / F.col("_n")
    return loads.join(F.broadcast(whole)).agg((0.5 * F.sum(F.abs(p - q))).alias("total_variation"), F.sum((p - q) * (p - q) / q).alias("chi_square"),
                                              F.sum(F.when(p > 0, p * F.log2(p / q)).otherwise(0.0)).alias("kl_divergence"))


def storage_reserved(topology: Topology, dense_bytes: float, input_bytes: float, multiplier: float = 6.0) -> float:
    """Memory left for tables after a share, the dense part and the inputs."""
    return topology.memory * (1 - topology.reserved) - multiplier * dense_bytes - input_bytes
