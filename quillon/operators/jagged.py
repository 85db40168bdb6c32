"""Jagged and keyed collections as DataFrames.

Wide form: one row per example, one array column (or struct of values and
weights) per key. Long form: (row, key, pos, id, weight), one row per value;
missing (row, key) pairs are empty bags.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.ordered import numbered
from quillon.operators.prefix import running_total

LONG = ("row", "key", "pos", "id", "weight")


def to_long(wide: DataFrame, row: str, keys: list[str], weights: dict[str, str] | None = None) -> DataFrame:
    """One row per value. ``weights``: the weight column of a key, else 1."""
    weights = weights or {}
    bag = lambda k: F.arrays_zip(F.col(k).cast("array<long>").alias("id"), (F.col(weights[k]) if k in weights else F.transform(k, lambda _: F.lit(1.0))).cast("array<double>").alias("weight"))
    keyed = F.array(*[F.struct(F.lit(k).alias("key"), bag(k).alias("bag")) for k in keys])
    out = wide.select(F.col(row).alias("row"), F.explode(keyed).alias("k")).select("row", "k.key", F.posexplode("k.bag").alias("pos", "v"))
    return out.select("row", "key", "pos", "v.id", "v.weight")


def to_wide(long: DataFrame, keys: list[str]) -> DataFrame:
    """One row per example; absent bags are empty."""
    entry = F.when(F.col("key").isNotNull(), F.struct("pos", "id", "weight"))
    bags = [F.array_sort(F.collect_list(F.when(F.col("key") == k, entry))).alias(k) for k in keys]
    out = long.groupBy("row").agg(*bags)
    return out.select("row", *[F.struct(F.transform(k, lambda x: x["id"]).alias("values"), F.transform(k, lambda x: x["weight"]).alias("weights")).alias(k) for k in keys])


def from_flat(values: DataFrame, lengths: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Bags from flat values (at, id) and the lengths (bag, length) that cut
    them: a bag's offset is the sum of the lengths before it. Places are cut into
    ranges of ``width``; a bag is posted in each range that it touches, and each
    value belongs to the last bag posted before it in its range."""
    starts = running_total(lengths.filter("length > 0"), ["bag"], F.floor(F.col("bag") / width), F.col("length").cast("long"), "start").withColumn("stop", F.col("start") + F.col("length"))
    posted = starts.withColumn("range", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))))
    posted = posted.select("range", F.greatest(F.col("start"), F.col("range") * width).alias("at"), F.lit(False).alias("value"), F.struct("bag", "stop").alias("of"))
    found = values.select(F.floor(F.col("at") / width).alias("range"), "at", F.lit(True).alias("value"), "id")
    line = Window.partitionBy("range").orderBy("at", "value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = found.unionByName(posted, allowMissingColumns=True).withColumn("of", F.last("of", ignorenulls=True).over(line))
    return met.filter("value AND at < of.stop").select("of.bag", "at", "id")


def lengths(long: DataFrame) -> DataFrame:
    return long.groupBy("row", "key").agg(F.count(F.lit(1)).alias("length"))


def length_per_key(wide: DataFrame, keys: list[str]) -> DataFrame:
    """(key, index, length, offset): values per key, and those of the keys before."""
    sums = wide.agg(*[F.coalesce(F.sum(F.size(k)), F.lit(0)).cast("long").alias(k) for k in keys])
    pairs = sums.select(F.posexplode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("length")) for k in keys])).alias("index", "v")).select("index", "v.*")
    return pairs.withColumn("offset", F.coalesce(F.sum("length").over(Window.orderBy("index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def offsets(wide: DataFrame, row: str, key: str, width: int = 1 << 16) -> DataFrame:
    """(row, start, stop) of each row's bag in the flat values. Row numbers are
    cut into ranges of ``width``, which are cumulated apart."""
    n = F.size(key).cast("long")
    rows = wide.select(F.col(row).alias("row"), n.alias("n"))
    out = running_total(rows, ["row"], F.floor(F.col("row") / width), F.col("n"), "start")
    return out.select("row", "start", (F.col("start") + F.col("n")).alias("stop"))


def stride_per_key(long: DataFrame, rank: Column | None = None) -> DataFrame:
    by = ["key"] if rank is None else ["key", "rank"]
    return (long if rank is None else long.withColumn("rank", rank)).groupBy(*by).agg(F.count_distinct("row").alias("stride"))


def stride_offsets(strides: DataFrame, keys: list[str]) -> DataFrame:
    """(key, index, stride, offset) of the keys in order: the rows of each key and those of
    the keys before it; a key without rows has stride 0. As many rows as keys."""
    order = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("key")) - 1
    every = strides.sparkSession.createDataFrame([(k,) for k in keys], "key string")
    full = every.join(strides, "key", "left").select("key", order.cast("int").alias("index"), F.coalesce("stride", F.lit(0)).cast("long").alias("stride"))
    return full.withColumn("offset", F.coalesce(F.sum("stride").over(Window.orderBy("index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def permuted(wide: DataFrame, row: str, keys: list[str], indices: list[int]) -> DataFrame:
    """Keys by index; a key taken again gets its place in its name."""
    taken: dict[str, int] = {}
    cols = []
    for i in indices:
        n = taken.get(keys[i], 0)
        cols.append(F.col(keys[i]).alias(keys[i] if not n else f"{keys[i]}@{n}"))
        taken[keys[i]] = n + 1
    return wide.select(row, *cols)


def split_keys(wide: DataFrame, row: str, keys: list[str], segments: list[int]) -> list[DataFrame]:
    """The keys cut into segments of the given numbers of keys."""
    if sum(segments) > len(keys):
        raise ValueError("segments have more keys than there are")
    out, at = [], 0
    for s in segments:
        out.append(wide.select(row, *keys[at:at + s]))
        at += s
    return out


def concatenated(parts: list[DataFrame], row: str) -> DataFrame:
    """The keys of several collections over the same rows."""
    if not parts:
        raise ValueError("nothing to concatenate")
    names = [c for p in parts for c in p.columns if c != row]
    if len(names) != len(set(names)):
        raise ValueError("a key occurs twice")
    out = reduce(lambda a, b: a.join(b, row, "full"), parts)
    types = {f.name: f.dataType for p in parts for f in p.schema}
    return out.select(row, *[F.coalesce(F.col(c), F.array().cast(types[c])).alias(c) for c in names])


def deduplicated_rows(wide: DataFrame, row: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Distinct rows (dedup_id, keys), and (row, dedup_id) to expand them again."""
    groups = wide.groupBy(*keys).agg(F.min(row).alias("dedup_id"))
    inverse = wide.join(groups, keys).select(row, "dedup_id")
    return groups.select("dedup_id", *keys), inverse


def expanded(results: DataFrame, inverse: DataFrame) -> DataFrame:
    """Results per distinct row, back on all rows."""
    return inverse.join(results, "dedup_id").drop("dedup_id")


def last_occurrence(df: DataFrame, id_: str, order: str) -> DataFrame:
    """Distinct ids with the place of their last occurrence."""
    return df.groupBy(id_).agg(F.max(order).alias("last_pos"))


def violations(long_lengths: DataFrame, values: int, keys: list[str], weights: int | None = None) -> list[str]:
    """What is wrong with a collection given as lengths (key, row, length)."""
    got = long_lengths.agg(
        F.sum("length").alias("total"), F.count_if(F.col("length") < 0).alias("negative"), F.count_if(F.col("length").isNull()).alias("missing"),
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("key").isin(*keys)).alias("unknown")).first()
    out = []
    for bad, what in ((len(keys) != len(set(keys)), "a key occurs twice"), (got["negative"], "a length is negative"), (got["missing"], "a length is missing"),
                      (got["unknown"], "a key is unknown"), (keys and got["n"] % len(keys), "lengths are not divisible by keys"),
                      ((got["total"] or 0) != values, "lengths do not add up to the values"), (weights is not None and weights != values, "there are not as many weights as values")):
        if bad:
            out.append(what)
    return out


def validated(df: DataFrame, values: str, weights: str | None = None, offsets_: str | None = None) -> DataFrame:
    """``df``, failing at the first row whose parts do not fit together."""
    checks = []
    if weights:
        checks.append((F.size(weights) != F.size(values), "weights and values differ in size"))
    if offsets_:
        checks += [(F.element_at(offsets_, 1) != 0, "offsets do not start at 0"), (F.element_at(offsets_, -1) != F.size(values), "the last offset is not the number of values"),
                   (F.exists(F.zip_with(F.slice(offsets_, 2, F.size(offsets_)), F.slice(offsets_, 1, F.size(offsets_) - 1), lambda a, b: a < b), lambda x: x), "offsets decrease")]
    ok = F.lit(True)
    for bad, what in checks:
        ok = ok & F.when(bad, F.raise_error(F.lit(what)).cast("boolean")).otherwise(True)
    return df.filter(ok)


# --- pools of jagged rows as flat values ----------------------------------------
def flat_pool(bags: DataFrame, width: int = 1 << 12) -> tuple[DataFrame, DataFrame]:
    """A pool of jagged rows (id, values) as (index: id, start, length; blocks: block,
    values): all values one after the other in the order of ids, cut into blocks of
    ``width``. Of ids that occur twice one with the most values stays; null bags are
    empty. A bag may lie in several blocks and a block holds several bags, so blocks are of one size
    whatever the bags are. Writes its rows once."""
    one = bags.filter("id IS NOT NULL").groupBy("id").agg(F.max_by(F.coalesce("values", F.array()), F.struct(F.size(F.coalesce("values", F.array())), F.coalesce("values", F.array()))).alias("values"))
    placed = numbered(one, ["id"], "_n", sums={"start": F.size("values")})
    index = placed.select("id", "start", F.size("values").cast("long").alias("length"))
    at = F.col("start") + F.col("_i")
    cells = placed.select("start", F.posexplode("values").alias("_i", "_v")).select(F.floor(at / width).alias("block"), F.pmod(at, F.lit(width)).alias("_at"), "_v")
    blocks = cells.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda x: x["_v"]).alias("values"))
    return index, blocks


def flat_select(index: DataFrame, blocks: DataFrame, ids: DataFrame, width: int = 1 << 12) -> DataFrame:
    """The rows of ``ids`` with ``values``, their bags: an id meets the blocks that
    its range touches by an equi-join and takes its part of each. An id that the
    pool does not hold has an empty bag. Distinct ids are looked up once."""
    asked = ids.select("id").distinct().join(index.filter("length > 0"), "id")
    first, last = F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("length") - 1) / width)
    parts = asked.select("id", "start", "length", F.explode(F.sequence(first, last)).alias("block")).join(blocks, "block")
    low = F.greatest(F.col("start") - F.col("block") * width, F.lit(0))
    high = F.least(F.col("start") + F.col("length") - F.col("block") * width, F.lit(width))
    cut = parts.select("id", "block", F.slice("values", (low + 1).cast("int"), (high - low).cast("int")).alias("part"))
    found = cut.groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "part"))), lambda x: x["part"])).alias("values"))
    return ids.join(found, "id", "left").withColumn("values", F.coalesce("values", F.array()))
