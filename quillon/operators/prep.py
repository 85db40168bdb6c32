"""Preparation of click logs, ratings and sequences: ids, splits, batches, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.expressions import left_padded, uniform
from quillon.operators.prefix import magnitude, ordered_buckets, ranked, running_total


#: Orders of all items for users whose draws did not give enough.
FILLS = 16


def contiguous_ids(df: DataFrame, column: str, order: list[str], threshold: int) -> DataFrame:
    """(column, id): 1 for values seen fewer than ``threshold`` times, else 2, 3,
    ... in the order of first occurrence."""
    first = F.struct(*[F.col(c) for c in order])
    seen = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first"))
    often = seen.filter(F.col("n") >= threshold) if threshold > 1 else seen
    often = ranked(often.select(column, "first", F.col(f"first.{order[0]}").alias("_o")), ["_o", "first"], "id", 2)
    rare = seen.filter(F.col("n") < threshold).withColumn("id", F.lit(1)) if threshold > 1 else None
    out = often.select(column, "id")
    return out.union(rare.select(column, "id")) if rare is not None else out


def encoded(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``df`` with the ids of ``column`` in its place; null is a value like others."""
    given = ids.select(F.col(column).alias("_value"), F.col("id").alias("_id"))
    return df.join(given, F.col(column).eqNullSafe(F.col("_value"))).drop(column, "_value").withColumnRenamed("_id", column)


def random_split(df: DataFrame, share: float, *keys: str, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Complementary sides by a hash of the keys: the same after any repartition."""
    u = uniform(*[F.col(k) for k in keys], seed=seed)
    return df.filter(u < share), df.filter(u >= share)


def leave_one_out(df: DataFrame, user: str, order: list[str]) -> DataFrame:
    """``split``: the user's last row is test, the one before val, the rest train."""
    back = F.row_number().over(Window.partitionBy(user).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("_r", back).withColumn("split", F.when(F.col("_r") == 1, "test").when(F.col("_r") == 2, "val").otherwise("train")).drop("_r")


def frequent(df: DataFrame, user: str, item: str, rating: str, least_rating: float, least_item: int, least_user: int) -> DataFrame:
    """Ratings of at least ``least_rating``, of items with enough of them, and
    then of users with enough of those; not repeated until stable."""
    df = df.filter(F.col(rating) >= least_rating)
    for key, least in ((item, least_item), (user, least_user)):
        keep = df.groupBy(key).count().filter(F.col("count") >= least).select(key)
        df = df.join(keep, key, "left_semi")
    return df


def dense_index(df: DataFrame, column: str, start: int) -> DataFrame:
    """``column`` replaced by its rank among the distinct values. The ranks are
    made from distinct values in ordered buckets, so no window sees all of them;
    null, if there, is the first value."""
    return encoded(df, ranked(df.select(column).distinct(), [column], "id", start), column)


def file_row_ranges(files: DataFrame, world: int, order: str, length: str) -> DataFrame:
    """Rows [start, stop) of every file that each rank reads: ranges of equal
    size over all files, one more row for the first ranks where needed."""
    line = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    f = files.withColumn("at", F.coalesce(F.sum(length).over(line), F.lit(0))).withColumn("total", F.sum(length).over(Window.partitionBy()))
    ranks = files.sparkSession.range(world).withColumnRenamed("id", "rank")
    f = f.join(F.broadcast(ranks))
    base, extra = F.floor(F.col("total") / world), F.col("total") % world
    first = F.col("rank") * base + F.least(F.col("rank"), extra)
    last = first + base + (F.col("rank") < extra).cast("long")
    f = f.withColumns({"start": F.greatest(first - F.col("at"), F.lit(0)), "stop": F.least(last - F.col("at"), F.col(length))})
    return f.filter("stop > start").select("rank", order, "start", "stop")


def batch_plan(df: DataFrame, row: str, total: int, batch: int, world: int) -> DataFrame:
    """``rank`` and ``batch_id`` of every row: full batches are dealt to ranks in
    turn; the tail is spread so that its batches differ by one row at most. A
    tail of fewer rows than ranks takes one round of full batches back."""
    full = total // batch // world * world
    rest = total - full * batch
    if 0 < rest < world and full >= world:
        full -= world
        rest += world * batch
    rows, size, extra = full * batch, rest // world, rest % world
    r = F.col(row)
    tail = r - rows
    cut = extra * (size + 1)
    tail_rank = F.when(tail < cut, F.floor(tail / (size + 1))).otherwise(extra + F.floor((tail - cut) / max(size, 1)))
    number = F.floor(r / batch)
    return df.withColumns({
        "rank": F.when(r < rows, number % world).otherwise(tail_rank).cast("long"),
        "batch_id": F.when(r < rows, F.floor(number / world)).otherwise(full // world).cast("long"),
    })


def source_slices(sources: DataFrame, order: str, workers: int) -> DataFrame:
    """Contiguous slices of sources, the larger ones first."""
    return sources.withColumn("worker", F.ntile(workers).over(Window.orderBy(order)) - 1)


def run_numbers(df: DataFrame, column: str, order: list[str], by: list[str] = ()) -> DataFrame:
    """``run``: the number of the row's run of equal consecutive values, from 0."""
    line = Window.partitionBy(*by).orderBy(*order)
    changed = F.coalesce((F.col(column) != F.lag(column).over(line)).cast("long"), F.lit(0))
    return df.withColumn("_c", changed).withColumn("run", F.sum("_c").over(line)).drop("_c")


def shuffled(df: DataFrame, key: list[str], days: list[int], seed: int = 0) -> DataFrame:
    """All rows in seeded order (``place``), cut into days of the given sizes.
    The order is a hash; its leading bits are buckets that are numbered apart."""
    rows = df.withColumn("_u", uniform(*[F.col(k) for k in key], seed=seed))
    placed = running_total(rows, ["_u", *key], F.floor(F.col("_u") * 4096), F.lit(1).cast("long"), "place").drop("_u")
    day, at = F.lit(len(days) - 1), sum(days)
    for i in range(len(days) - 1, 0, -1):
        at -= days[i]
        day = F.when(F.col("place") < at, i - 1).otherwise(day)
    return placed.withColumn("day", day)


def shifted_log(df: DataFrame, columns: list[str]) -> DataFrame:
    """ln(x - m + 2) of the columns, where m is the least of all their cells."""
    least = df.agg(F.min(F.least(*columns)).alias("_m"))
    return df.join(F.broadcast(least)).withColumns({c: F.log(F.col(c) - F.col("_m") + 2.0) for c in columns}).drop("_m")


def halves(df: DataFrame, row: str, total: int) -> DataFrame:
    """``stage``: the first half (rounded up) is val, the rest test."""
    return df.withColumn("stage", F.when(F.col(row) < -(-total // 2), "val").otherwise("test"))


def sequences(df: DataFrame, user: str, order: list[str], item: str) -> DataFrame:
    """The items of each user in order."""
    entry = F.struct(*[F.col(c) for c in order], F.col(item).alias("_item"))
    return df.groupBy(user).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["_item"]).alias("items"))


def history_and_candidates(items: Column, candidates: int, history: int) -> Column:
    """The last ``candidates`` items apart; of those before, the newest ``history``."""
    cut = F.greatest(F.size(items) - candidates, F.lit(0))
    start = F.greatest(cut - history, F.lit(0))
    return F.struct(F.slice(items, start + 1, cut - start).alias("history"), F.slice(items, cut + 1, F.lit(candidates)).alias("candidates"))


def eval_rows(items: Column, target: Column, mask: int, width: int, pad: int) -> Column:
    """History and a mask token, the last ``width`` of it, padded at the start."""
    return left_padded(F.concat(items, F.array(F.lit(mask))), width, F.lit(pad))


def negatives(seqs: DataFrame, user: str, items: str, universe: DataFrame, n: int, popularity: str | None = None, tries: int = 4, seed: int = 0) -> DataFrame:
    """``n`` unseen items per user, uniform or by popularity, or all unseen ones
    where there are fewer, without pairing users with all items: users draw seeded
    places on the cumulated weights of the items, find them by a range join on
    equal buckets, and keep the first ``n`` distinct ones that they have not seen.
    Users who are still short go on along one of FILLS seeded orders of the items,
    weighted alike, of which the first ``n`` and as many as they have seen are enough."""
    weight = F.col(popularity).cast("long") if popularity else F.lit(1).cast("long")
    u = running_total(universe, ["item"], ordered_buckets(universe, "item"), weight, "_lo").withColumn("_hi", F.col("_lo") + weight)
    total = universe.agg(F.sum(weight)).first()[0] or 0
    width = max(1, total // 4096)
    places = u.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor((F.col("_hi") - 1) / width))))
    draws = seqs.select(user).distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n * tries - 1)))).withColumn("_at", F.floor(uniform(F.col(user), F.col("draw"), seed=seed) * total))
    drawn = draws.withColumn("_b", F.floor(F.col("_at") / width)).join(places, "_b").filter("_at >= _lo AND _at < _hi")

    def unseen(found: DataFrame) -> DataFrame:
        """(user, item, draw) of ``found`` whose item is new to the user. What was found
        meets the user's items as one array, so that these are moved once, not for each draw."""
        own = found.groupBy(F.col(user).alias("_u")).agg(F.collect_list(F.struct("item", "draw")).alias("_found"))
        new = F.filter("_found", lambda x: ~F.coalesce(F.array_contains(items, x["item"]), F.lit(False)))
        return seqs.join(own, F.col(user).eqNullSafe(F.col("_u"))).select(user, F.inline(new)).groupBy(user, "item").agg(F.min("draw").alias("draw"))

    met = unseen(drawn)
    had = met.groupBy(F.col(user).alias("_u")).agg(F.count(F.lit(1)).alias("_n"))
    enough = n + F.coalesce(F.size(F.array_distinct(items)), F.lit(0))
    short = seqs.select(user, enough.alias("_enough")).join(had, F.col(user).eqNullSafe(F.col("_u")), "left").filter(F.coalesce("_n", F.lit(0)) < n).withColumn("_f", F.pmod(F.xxhash64(F.lit(seed), F.col(user)), F.lit(FILLS)))
    fills = universe.filter("item IS NOT NULL").withColumn("_f", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(FILLS - 1).cast("long"))))
    fills = fills.join(F.broadcast(short.select("_f").distinct()), "_f", "left_semi")  # orders that nobody goes along are not made
    wait = F.when(weight > 0, -F.log1p(-uniform(F.col("item"), F.col("_f"), seed=seed)) / weight)
    fills = fills.select("item", "_f", wait.alias("_w"))
    fills = running_total(fills, [F.asc_nulls_last("_w"), "item"], F.coalesce(magnitude(F.col("_w")), F.lit(1 << 40)), F.lit(1).cast("long"), "_k", ["_f"]).select("item", "_f", (F.col("_k") + 1).alias("_k"))
    short = short.select(user, "_f", F.explode(F.sequence(F.lit(1), F.col("_enough"))).alias("_k"))
    filled = unseen(short.join(fills, ["_f", "_k"]).select(user, "item", (F.col("_k") + n * tries).alias("draw")))
    met = met.unionByName(filled).groupBy(user, "item").agg(F.min("draw").alias("draw"))
    return met.withColumn("_r", F.row_number().over(Window.partitionBy(user).orderBy("draw"))).filter(F.col("_r") <= n).select(user, "item")


def masked_windows(seqs: DataFrame, user: str, items: str, width: int, share: float, mask: int, n_items: int, pad: int = 0, seed: int = 0, copies: int = 1) -> DataFrame:
    """Training rows: ``copies`` differently masked ones of each of the windows over a sequence, stepping back from its end by a
    tenth of their width and with one at its start, so that each item is in one;
    in them a seeded share of places is hidden (four fifths by the mask token,
    the rest by a random item) and becomes the label; others have label ``pad``."""
    last = F.size(items) - width
    back = F.sequence(F.greatest(last, F.lit(1)), F.lit(1), F.lit(-max(1, width // 10)))
    starts = F.when(last > 0, F.concat(back, F.array(F.lit(0)))).otherwise(F.array(F.lit(0)))
    rows = seqs.withColumn("start", F.explode(starts)).withColumn("window", left_padded(F.slice(items, F.col("start") + 1, F.lit(width)), width, F.lit(pad)))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    again = [F.when(F.col("copy") > 0, F.col("copy"))]  # skipped in the first copy
    u = lambda i, k: uniform(F.col(user), F.col("start"), i, *again, seed=seed + k)
    hidden = lambda x, i: (x != pad) & (u(i, 1) < share)
    tokens = F.transform("window", lambda x, i: F.when(hidden(x, i), F.when(u(i, 2) < 0.8, F.lit(mask)).otherwise(1 + F.floor(u(i, 3) * n_items))).otherwise(x))
    labels = F.transform("window", lambda x, i: F.when(hidden(x, i), x).otherwise(pad))
    return rows.select(user, "start", "copy", tokens.alias("tokens"), labels.alias("labels"))
