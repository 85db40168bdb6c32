"""Mixing sources to target weights: Sainte-Lague apportionment of equal blocks.

DataFrame functions only. The corpus is a set of shards, each a line of
documents in seeded order. Blocks of ``block_words`` words are seats: sources,
then groups of shards, then shards win them by highest quotients
(votes / 1, 3, 5, ...). A shard takes as many whole passes over its line as its
seats pay for and, for the rest, consecutive blocks from a seeded start.

Shards hold about ``shard_docs`` documents whatever the source's share of the
corpus, and each apportionment runs within one source or one group of shards,
so that no task ever holds a whole source. Tables of sources, groups and shards
are the only ones grouped by source, after partial aggregation.

Nulls: a null text has size 0, a null source is a source of its own (last).
Rows without id are dealt to shards by their text. Empty table: no rows. Repeated rows are separate documents with the same id;
their order in a shard is then by size. Extra columns are ignored here and kept
by :func:`mixed_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import WORD, n_words, stored

BLOCK_WORDS = 64
SHARD_DOCS = 128
MAX_SHARDS = 65536
REPEATS = 3
SEED = "mix-1"


def source_targets(sources: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """Adds ``weight`` and ``target`` to a table (source, source_size).

    Weights 1, 2, 3 repeat over the sources in code-point order, nulls last.
    A target is the source's share of all sizes by weight, but at most
    ``repeats`` times its own size; what is cut is shared again by weight among
    the others. Sources are in order of size per weight: each is cut if the
    level left by those before it still exceeds it, which gives the fixed point
    without iterating.
    """
    everything = Window.partitionBy()
    ranked = sources.withColumn("weight", ((F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % 3 + 1).cast("long"))
    ascending = Window.orderBy(F.col("source_size") / F.col("weight"), F.asc_nulls_last("source"))
    before = ascending.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns({
        "left_size": F.sum("source_size").over(everything) - repeats * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
        "left_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    cut = repeats * F.col("source_size") * F.col("left_weight") < F.col("left_size") * F.col("weight")
    level = F.first(F.when(~F.col("cut"), F.struct("left_size", "left_weight")), ignorenulls=True).over(
        ascending.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (ranked.withColumn("cut", cut).withColumn("level", level)
            .withColumn("target", F.when(F.col("cut") | F.col("level").isNull(), (repeats * F.col("source_size")).cast("double"))
                        .otherwise(F.col("level.left_size").cast("double") * F.col("weight") / F.col("level.left_weight")))
            .drop("cut", "level", "left_size", "left_weight"))


def apportion(parties: DataFrame, scope: list[str], party: list[str], votes: str, seats: str) -> DataFrame:
    """Adds ``won``: seats by Sainte-Lague within each scope.

    ``seats`` is the number of seats of the row's scope, the same in all its
    rows. Starting from votes rounded at the divisor V / S, only D = S - sum of
    the rounded seats remain to be given (or taken back). If the divisor moves
    until they are, a party's seats change by at most
    votes / V * (|D| + parties) + 1, so the quotients listed for the decision
    are linear in the number of parties. Ties go to the first party.
    """
    here = Window.partitionBy(*scope)
    v, s, total = F.col(votes), F.col(seats), F.sum(votes).over(here)
    start = F.when(total > 0, F.floor(v.cast("double") * s / total + 0.5)).otherwise(0).cast("long")
    rows = parties.withColumn("_start", start).withColumns({
        "_open": F.when(total > 0, s - F.sum("_start").over(here)).otherwise(0),
        "_most": F.when(total > 0, F.ceil(v.cast("double") / total * (F.abs(s - F.sum("_start").over(here)) + F.count(F.lit(1)).over(here))) + 1).otherwise(0),
    })
    step = F.explode(F.when((F.col("_open") != 0) & (F.col("_most") > 0) & (v > 0), F.sequence(F.lit(1), F.col("_most").cast("int"))).otherwise(F.array().cast("array<int>")))
    lists = rows.filter(F.col("_open") != 0).withColumn("_j", step)
    gain = F.col("_open") > 0
    odd = F.when(gain, 2 * (F.col("_start") + F.col("_j")) - 1).otherwise(2 * (F.col("_start") - F.col("_j")) + 1)
    lists = lists.withColumn("_odd", odd).filter("_odd > 0").withColumn("_quotient", v.cast("double") / F.col("_odd"))
    order = Window.partitionBy(*scope).orderBy(F.when(gain, -F.col("_quotient")).otherwise(F.col("_quotient")), *[F.asc_nulls_last(c) for c in party])
    moved = (lists.withColumn("_rank", F.row_number().over(order)).filter("_rank <= abs(_open)")
             .groupBy(*scope, *party).agg(F.sum(F.signum("_open")).cast("long").alias("_moved")))
    keys = list(dict.fromkeys([*scope, *party]))
    moved = moved.select(*[F.col(c).alias(f"_m_{c}") for c in keys], "_moved")
    same = [F.col(c).eqNullSafe(F.col(f"_m_{c}")) for c in keys]
    return (rows.join(moved, same, "left").withColumn("won", F.col("_start") + F.coalesce("_moved", F.lit(0)))
            .drop("_start", "_open", "_most", "_moved", *[f"_m_{c}" for c in keys]))


def _hex(h: str, at: int, n: int) -> Column:
    return F.conv(F.substring(h, at, n), 16, 10).cast("long")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken,
    and how the words were taken: ``passes`` whole copies, then words
    ``[cut_from, cut_to)`` and ``[0, wrap_to)`` of one further copy.
    """
    sized = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"),
                               F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary")), F.lit("")), F.lit(f":{seed}")).cast("binary")).alias("h")))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources = source_targets(sources, repeats)
    sources = sources.withColumns({
        "votes": F.round("target").cast("long"),
        "seats": F.floor(F.sum("source_size").over(Window.partitionBy()).cast("double") / block_words + 0.5).cast("long"),
        "shards": F.least(F.lit(MAX_SHARDS), F.ceil(F.col("n") / shard_docs)).cast("long"),
        "all": F.lit(0),
    })
    sources = stored(apportion(sources, ["all"], ["source"], "votes", "seats").withColumn("source_seats", F.least("won", F.floor(repeats * F.col("source_size") / block_words)))
                     .select("source", "source_size", "target", "source_seats", "shards"))
    by_source = sources.select(F.col("source").alias("s_source"), "source_size", "target", "source_seats", "shards")
    rows = (sized.join(by_source, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
            .withColumn("shard", _hex("h", 1, 8) % F.col("shards")).withColumn("at", _hex("h", 9, 15)).drop("h"))
    shards = (rows.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_seats").alias("source_seats"), F.first("shards").alias("shards"))
              .withColumn("group", F.floor(F.col("shard") / F.ceil(F.sqrt("shards")))))
    groups = shards.groupBy("source", "group").agg(F.sum("shard_size").alias("group_size"), F.first("source_seats").alias("source_seats"))
    groups = apportion(groups, ["source"], ["group"], "group_size", "source_seats").select(
        F.col("source").alias("g_source"), F.col("group").alias("g_group"), F.col("won").alias("group_seats"))
    shards = shards.join(groups, F.col("source").eqNullSafe(F.col("g_source")) & (F.col("group") == F.col("g_group")))
    shards = apportion(shards, ["source", "group"], ["shard"], "shard_size", "group_seats").select(
        F.col("source").alias("h_source"), F.col("shard").alias("h_shard"), "shard_size",
        F.least(F.col("won") * block_words, repeats * F.col("shard_size")).alias("pay"))
    rows = rows.join(shards, F.col("source").eqNullSafe(F.col("h_source")) & (F.col("shard") == F.col("h_shard")))
    line = Window.partitionBy("source", "shard").orderBy("at", F.asc_nulls_first("doc_id"), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = F.greatest(F.col("shard_size"), F.lit(1))
    rows = rows.withColumn("a", F.sum("size").over(line) - F.col("size")).withColumns({
        "passes": F.floor(F.col("pay") / full),
        "rest": F.col("pay") % full,
        # the seeded start: a block of the line, the same for all documents of the shard
        "o": block_words * (_hex_of(F.concat(F.col("shard").cast("string"), F.lit("@"), F.coalesce("source", F.lit("")), F.lit(f":{seed}"))) % F.greatest(F.floor(F.col("shard_size") / block_words), F.lit(1))),
    })
    b, end, wrap = F.col("a") + F.col("size"), F.col("o") + F.col("rest"), F.col("o") + F.col("rest") - F.col("shard_size")
    rows = rows.withColumns({
        "cut_from": F.greatest(F.col("a"), F.col("o")) - F.col("a"),
        "cut_to": F.least(b, end) - F.col("a"),
        "wrap_to": F.greatest(F.lit(0), F.least(b, wrap) - F.col("a")),
    }).withColumn("cut_to", F.greatest("cut_from", "cut_to"))
    return rows.select("doc_id", "source", "size", "source_size", "target",
                       (F.col("passes") * F.col("size") + F.col("cut_to") - F.col("cut_from") + F.col("wrap_to")).alias("taken"),
                       "passes", "cut_from", "cut_to", "wrap_to")


def _hex_of(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each whole pass
    over a document, and one for the words of a partial pass, cut between words.
    ``n_chars``, where present, follows the text. Rows without id, and rows that
    repeat one, are told apart by a hash of their text and, if that is equal, a number.
    """
    key = F.col("doc_id").cast("string")
    if not docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty():
        same = F.xxhash64("text")  # only equal texts under one id share a number range
        nth = F.row_number().over(Window.partitionBy("doc_id", same).orderBy(same))
        key = F.concat(F.coalesce(key, F.lit("")), F.lit("#"), F.hex(same), F.lit("#"), nth.cast("string"))
    keyed = docs.withColumn("_quillon_key", key)
    plan = mix(keyed.select(F.col("_quillon_key").alias("doc_id"), "source", "text"), **options).filter("taken > 0")
    plan = plan.select(F.col("doc_id").alias("_quillon_id"), F.struct("size", "passes", "cut_from", "cut_to", "wrap_to").alias("_quillon_mix"))
    rows = keyed.join(plan, F.col("_quillon_key") == F.col("_quillon_id"))
    of = lambda name: F.col(f"_quillon_mix.{name}")
    pieces = F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    cut = lambda start, stop: F.array_join(F.slice(pieces, (start + 1).cast("int"), (stop - start).cast("int")), "")
    zero = F.lit(0).cast("long")
    partial = F.filter(F.array(
        F.when(of("wrap_to") > 0, F.struct(zero.alias("from"), of("wrap_to").alias("to"))),
        F.when(of("cut_to") > of("cut_from"), F.struct(of("cut_from").alias("from"), of("cut_to").alias("to")))), lambda x: x.isNotNull())
    whole = F.array_repeat(F.struct(zero.alias("from"), of("size").alias("to")), of("passes").cast("int"))
    rows = rows.withColumn("_quillon_part", F.explode(F.concat(whole, partial)))
    start, stop = F.col("_quillon_part.from"), F.col("_quillon_part.to")
    rows = rows.withColumn("text", F.when((start == 0) & (stop == of("size")), F.col("text")).otherwise(cut(start, stop)))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
