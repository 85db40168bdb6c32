"""Global ids to cache slots: a table of slots that fills up, fails when full, and
gives the least used entries back.

State is a table (id, slot, record). A record is one number: the logarithm of how
often the id was used above, the time of its last use below, so that records in
order are least used first and, among equals, longest unused first. State and
ids are read several times, so they should be tables, not long plans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.expressions import uniform
from quillon.operators.ordered import n_smallest, numbered
from quillon.operators.remap import free_slots

# Bits of a record's time, the largest power, and the power of a new id.
TIME_BITS, MOST_POWER, FIRST_POWER = 27, 31, 5
STATE = "id long, slot long, record long"


def record(power: Column, time: Column) -> Column:
    return F.shiftleft(power.cast("long"), TIME_BITS).bitwiseOR(time.cast("long").bitwiseAND(F.lit((1 << TIME_BITS) - 1)))


def power_of(rec: Column) -> Column:
    return F.shiftrightunsigned(rec, TIME_BITS).cast("int")


def time_of(rec: Column) -> Column:
    return rec.bitwiseAND(F.lit((1 << TIME_BITS) - 1))


def touched(rec: Column, id_: Column, time: Column, uses: Column | int = 1, seed: int = 0) -> Column:
    """The record after ``uses`` uses at a time: each raises the power p by one with
    chance 2^-p, drawn by a hash of id, time and use. No record: a first power,
    raised by the uses after the first."""
    uses = F.lit(uses) if isinstance(uses, int) else uses
    start = F.when(rec.isNull(), F.lit(FIRST_POWER)).otherwise(power_of(rec)).cast("int")
    first = F.when(rec.isNull(), F.lit(2)).otherwise(F.lit(1))
    step = lambda p, i: F.when((i < first) | (uniform(id_, time, i, seed=seed) * F.pow(F.lit(2.0), p) >= 1.0), p).otherwise(F.least(p + 1, F.lit(MOST_POWER)))
    power = F.aggregate(F.sequence(F.lit(1), F.greatest(uses, F.lit(1)).cast("int")), start, step)
    return record(power, time)


def transformed(state: DataFrame, ids: DataFrame, capacity: int, time: int, order: str, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Slots for a batch of ids (id, ``order``): (the ids' rows with ``slot``, null
    where the table is full; the state after it). New ids take the free slots, lowest
    first, in the order of their first occurrence."""
    seen = ids.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("_uses"), F.min(order).alias("_first"))
    met = seen.join(state.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").drop("_id")
    new = met.filter("slot IS NULL")
    free = free_slots(state.select("slot"), capacity, wanted=new.agg(F.count(F.lit(1)).alias("_n"))).withColumnRenamed("slot", "_free")
    new = numbered(new, ["_first", "id"], "_k").drop("slot").join(free, "_k", "left").withColumnRenamed("_free", "slot").drop("_k")
    used = met.filter("slot IS NOT NULL").unionByName(new)
    used = used.withColumn("record", touched(F.col("record"), F.col("id"), F.lit(time), F.col("_uses"), seed))
    placed = used.filter("slot IS NOT NULL").select("id", "slot", "record")
    rest = state.join(placed.select("id"), "id", "left_anti").select("id", "slot", "record")
    return ids.join(used.select("id", "slot"), "id", "left"), rest.unionByName(placed)


def least_used(state: DataFrame, n: int) -> DataFrame:
    """The ``n`` entries with the smallest records (ties by id), from bounded heaps."""
    return n_smallest(state, ["record", "id"], n)


def transformed_or_evicted(state: DataFrame, ids: DataFrame, capacity: int, time: int, order: str, share: float = 0.5, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """:func:`transformed`; if the table is full, ``share`` of the entries that the
    batch does not use are given back first and the batch is tried once more. Also
    returns the entries given back, whose rows a store has to take."""
    done, after = transformed(state, ids, capacity, time, order, seed)
    none = state.limit(0)
    if done.filter("slot IS NULL").isEmpty():
        return done, after, none
    idle = state.join(ids.select("id").distinct(), "id", "left_anti")
    gone = least_used(idle, int(share * idle.count() + 0.5)).select("id", "slot", "record")
    left = state.join(gone.select("id"), "id", "left_anti").select("id", "slot", "record")
    done, after = transformed(left, ids, capacity, time, order, seed)
    return done, after, gone


def _line(id_: Column, lines: int, width: int) -> tuple[Column, Column]:
    h = F.xxhash64(F.lit(11), id_)
    return F.pmod(h, F.lit(lines)).cast("int"), F.pmod(F.shiftright(h, 24), F.lit(width)).cast("int")


def lined(state: DataFrame, ids: DataFrame, lines: int, width: int, time: int, order: str, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """:func:`transformed` by set-associative placement: an id belongs to one line of
    ``width`` slots and takes its first free slot from its home place on, around the
    line; with none free its slot is null. New ids of a line come in the order of
    their first occurrence. Returns the ids' rows with ``slot`` and the state after them.

    An id competes within its line only, so a batch is one pass over lines: no rank,
    no count and no list of free slots of the whole table. Ids are counted before
    they meet their line, so a line's task holds its slots and one row at a time.
    """
    bucket, home = _line(F.col("id"), lines, width)
    seen = ids.filter("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("_uses"), F.min(order).alias("_first"))
    met = state.select(F.col("id").alias("_id"), "slot", "record").join(seen, F.col("id") == F.col("_id"), "full").select(F.coalesce("id", "_id").alias("id"), "slot", "record", "_uses", "_first")
    met = met.withColumns({"_line": bucket, "_home": home}).repartition("_line").sortWithinPartitions("_line", F.asc_nulls_last("slot"), "_first", "id")
    fields = [f for f in met.select("id", "slot", "record", "_uses").schema.fields]

    def place(frames):
        now, taken = None, set()
        for x in frames:
            slots = x["slot"].tolist()
            for at, (line, p, slot) in enumerate(zip(x["_line"], x["_home"], slots, strict=True)):
                if line != now:
                    now, taken = line, set()
                if slot is None or slot != slot:  # residents of a line come first
                    places = (line * width + (p + j) % width for j in range(width))
                    slots[at] = slot = next((s for s in places if s not in taken), None)
                if slot is not None:
                    taken.add(int(slot))
            yield x.assign(slot=slots)[["id", "slot", "record", "_uses"]].astype({"slot": "Int64", "record": "Int64", "_uses": "Int32"})

    done = met.mapInPandas(place, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields))
    done = done.withColumn("record", F.when(F.col("_uses").isNull(), F.col("record")).otherwise(touched(F.col("record"), F.col("id"), F.lit(time), F.col("_uses"), seed)))
    after = done.filter("slot IS NOT NULL").select("id", "slot", "record")
    return ids.join(after.select("id", "slot"), "id", "left"), after


def least_used_of_lines(state: DataFrame, width: int, n: int) -> DataFrame:
    """The ``n`` entries of each line with the smallest records, ties by id."""
    line = Window.partitionBy(F.floor(F.col("slot") / width)).orderBy("record", "id")
    return state.withColumn("_r", F.row_number().over(line)).filter(F.col("_r") <= n).drop("_r")

