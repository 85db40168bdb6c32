"""Weighted model-quality metrics as declarative aggregates.

A metric is a set of named sums over a long table (task, label, prediction,
weight) and expressions of these sums. All metrics of a suite share one
aggregation, which Spark computes partially before the shuffle; sums of parts
(batches, partitions, workers) can be added up and finished later.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.expressions import recalibrated
from quillon.operators.prefix import ordered_pairs

# The clamp of entropies, and the number of thresholds of hindsight metrics.
ETA = 1e-12
HINDSIGHT_STEPS = 1000


def L() -> Column:  # noqa: N802
    return F.col("label")


def P() -> Column:  # noqa: N802
    return F.col("prediction")


def W() -> Column:  # noqa: N802
    return F.col("weight")



@dataclass(frozen=True)
class Metric:
    """``states``: sums by name; ``values``: results by name, from the states."""

    states: dict[str, Column]
    values: Callable[[Callable[[str], Column]], dict[str, Column]]
    prepare: dict[str, Column] = field(default_factory=dict)


def clamped(p: Column, eta: float = ETA) -> Column:
    return F.greatest(F.least(p, F.lit(1.0 - eta)), F.lit(eta))


def cross_entropy(label: Column, prediction: Column, weight: Column, eta: float = ETA) -> Column:
    """-w (l log2 p + (1 - l) log2(1 - p))."""
    p = clamped(prediction, eta)
    return -weight * (label * F.log2(p) + (1.0 - label) * F.log2(1.0 - p))


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(F.try_divide(a, b))


def entropy_norm(positive: Column, negative: Column, weight: Column, rate: Column | None = None, eta: float = ETA) -> Column:
    """Entropy of always predicting the mean label (or ``rate``)."""
    n = F.greatest(weight, F.lit(eta))
    r = clamped((positive if rate is None else rate) / n, eta)
    return -positive * F.log2(r) - negative * F.log2(1.0 - r)


def _entropy(prediction: Column | None = None, weight: Column | None = None) -> dict[str, Column]:
    prediction, weight = (P() if prediction is None else prediction), (W() if weight is None else weight)
    return {"ce": cross_entropy(L(), prediction, weight), "n": weight, "pos": weight * L(), "neg": weight * (1.0 - L())}


def _ne(s) -> Column:
    return s("ce") / entropy_norm(s("pos"), s("neg"), s("n"))


def _threshold(t: float) -> dict[str, Column]:
    on = P() >= t
    return {"tp": F.when(on, W() * L()).otherwise(0.0), "fp": F.when(on, W() * (1.0 - L())).otherwise(0.0), "fn": F.when(~on, W() * L()).otherwise(0.0)}


def metric_definitions(threshold: float = 0.5, coefficient: float = 1.0) -> dict[str, Metric]:
    """All metrics that are sums over rows, by name."""
    again = recalibrated(P(), coefficient)
    positive = -W() * L() * F.log2(clamped(P()))
    square = {"se": W() * (L() - P()) * (L() - P()), "n": W(), "wl": W() * L(), "wll": W() * L() * L()}
    return {
        "ne": Metric(_entropy(), lambda s: {"ne": _ne(s)}),
        "logloss": Metric(_entropy(), lambda s: {"logloss": s("ce") / F.greatest(s("pos") + s("neg"), F.lit(ETA))}),
        "ne_positive": Metric(_entropy() | {"ce_pos": positive}, lambda s: {"ne_positive": s("ce_pos") / entropy_norm(s("pos"), s("neg"), s("n"))}),
        "unweighted_ne": Metric({f"u_{k}": v for k, v in _entropy(weight=F.lit(1.0)).items()},
                                lambda s: {"unweighted_ne": s("u_ce") / entropy_norm(s("u_pos"), s("u_neg"), s("u_n"))}),
        "recalibrated_ne": Metric({f"r_{k}": v for k, v in _entropy(prediction=again).items()},
                                  lambda s: {"recalibrated_ne": s("r_ce") / entropy_norm(s("r_pos"), s("r_neg"), s("r_n"))}),
        "calibration_free_ne": Metric(_entropy() | {"wp": W() * P()}, lambda s: {"calibration_free_ne": _ne(s) / entropy_norm(s("pos"), s("n") - s("pos"), s("n"), s("wp"))}),
        "serving_ne": Metric(_entropy() | {"used": F.when(W() != 0, 1).otherwise(0).cast("long")}, lambda s: {"serving_ne": _ne(s), "serving_examples": s("used")}),
        "calibration": Metric({"wp": W() * P(), "wl": W() * L()}, lambda s: {"calibration": F.when(s("wl") <= 0, 0.0).otherwise(F.try_divide(s("wp"), s("wl")))}),
        "serving_calibration": Metric({"wp": W() * P(), "wl": W() * L(), "used": F.when(W() != 0, 1).otherwise(0).cast("long")},
                                      lambda s: {"serving_calibration": F.when(s("wl") <= 0, 0.0).otherwise(F.try_divide(s("wp"), s("wl"))), "total_examples": s("used")}),
        "recalibrated_calibration": Metric({"r_wp": W() * again, "wl": W() * L()}, lambda s: {"recalibrated_calibration": F.when(s("wl") <= 0, 0.0).otherwise(F.try_divide(s("r_wp"), s("wl")))}),
        "ctr": Metric({"wl": W() * L(), "n": W()}, lambda s: {"ctr": ratio(s("wl"), s("n"))}),
        "mse": Metric(square, lambda s: {"mse": ratio(s("se"), s("n")), "rmse": F.sqrt(ratio(s("se"), s("n"))),
                                         "r2": 1.0 - ratio(s("se"), s("wll") - s("wl") * s("wl") / F.greatest(s("n"), F.lit(ETA)))}),
        "mae": Metric({"ae": W() * F.abs(L() - P()), "n": W()}, lambda s: {"mae": ratio(s("ae"), s("n"))}),
        "accuracy": Metric({"right": F.when((P() >= threshold).cast("double") == L(), W()).otherwise(0.0), "n": W()}, lambda s: {"accuracy": ratio(s("right"), s("n"))}),
        "precision": Metric(_threshold(threshold), lambda s: {"precision": ratio(s("tp"), s("tp") + s("fp"))}),
        "recall": Metric(_threshold(threshold), lambda s: {"recall": ratio(s("tp"), s("tp") + s("fn"))}),
        "weighted_avg": Metric({"wp": W() * P(), "n": W()}, lambda s: {"weighted_avg": ratio(s("wp"), s("n"))}),
        "pair_weights": Metric({"n": W(), "ww": W() * W()}, lambda s: {"pair_weights": (s("n") * s("n") - s("ww")) / 2.0}),
    }


@dataclass
class Suite:
    """Metrics that share one aggregation. States of one name are one sum."""

    metrics: dict[str, Metric]

    @classmethod
    def of(cls, *names: str, **options) -> Suite:
        known = metric_definitions(**options)
        return cls({n: known[n] for n in names or known})

    def states(self, df: DataFrame, by: list[str]) -> DataFrame:
        """The sums of each group."""
        sums = {k: v for m in self.metrics.values() for k, v in m.states.items()}
        return df.groupBy(*by).agg(*[F.sum(v).alias(f"s_{k}") for k, v in sums.items()], F.count_if(W() != 0).alias("s_valid"))

    def merged(self, states: DataFrame, by: list[str]) -> DataFrame:
        """Sums of sums, such as those of batches or workers."""
        return states.groupBy(*by).agg(*[F.sum(c).alias(c) for c in states.columns if c.startswith("s_")])

    def values(self, states: DataFrame, by: list[str]) -> DataFrame:
        """The results; a group without any non-zero weight gets 0 throughout."""
        out = {k: v for m in self.metrics.values() for k, v in m.values(lambda n: F.col(f"s_{n}")).items()}
        return states.select(*by, *[F.when(F.col("s_valid") == 0, F.lit(0)).otherwise(v).alias(k) for k, v in out.items()])

    def compute(self, df: DataFrame, by: list[str]) -> DataFrame:
        return self.values(self.states(df, by), by)


def tasks_long(df: DataFrame, tasks: dict[str, tuple[str, str, str]], keep: list[str] = ()) -> DataFrame:
    """One row per row and task from wide columns {task: (label, prediction, weight)}."""
    parts = [F.struct(F.lit(t).alias("task"), *[F.col(c).cast("double").alias(n) for c, n in zip(cols, ("label", "prediction", "weight"), strict=True)]) for t, cols in tasks.items()]
    return df.select(*keep, F.explode(F.array(*parts)).alias("t")).select(*keep, "t.*")


def segmented(df: DataFrame, suite: Suite, segment: str, n: int, by: list[str] = ()) -> DataFrame:
    """The suite for each of the groups 0 .. n-1; groups without rows are 0."""
    got = suite.compute(df, [*by, segment])
    every = df.sparkSession.range(n).withColumnRenamed("id", segment)
    if by:
        every = df.select(*by).distinct().join(F.broadcast(every))
    return every.join(got, [*by, segment], "left").na.fill(0)


def sums_with_groups(df: DataFrame, by: list[str], value: Column, weight: Column | None = None) -> DataFrame:
    w = F.lit(1.0) if weight is None else weight
    return df.groupBy(*by).agg((F.sum(value * w) / F.sum(w)).alias("average"))


def hindsight(df: DataFrame, by: list[str], target_precision: float, steps: int = HINDSIGHT_STEPS) -> DataFrame:
    """Precision and recall at the first of ``steps`` thresholds k / (steps - 1)
    whose precision reaches the target, else at the last.

    True and false positives have prediction >= t, false negatives <= t, so a
    prediction equal to a threshold counts in both. Each row goes to the cell of
    the last threshold it reaches; sums from the cells' ends give all thresholds.
    """
    top = steps - 1
    cell = F.least(F.greatest(F.floor(P() * top + 1e-9), F.lit(-1)), F.lit(top)).cast("int")
    exact = F.abs(P() * top - F.round(P() * top)) < 1e-9
    cells = df.groupBy(*by, cell.alias("k")).agg(F.sum(W() * L()).alias("a"), F.sum(W() * (1.0 - L())).alias("b"), F.sum(F.when(exact, W() * L()).otherwise(0.0)).alias("e"))
    grid = df.select(*by).distinct().join(F.broadcast(df.sparkSession.range(-1, steps).select(F.col("id").cast("int").alias("k"))))
    full = grid.join(cells, [*by, "k"], "left").na.fill(0.0)
    down = Window.partitionBy(*by).orderBy(F.desc("k"))
    up = Window.partitionBy(*by).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumns({"tp": F.sum("a").over(down), "fp": F.sum("b").over(down), "fn": F.coalesce(F.sum("a").over(up), F.lit(0.0)) + F.col("e")}).filter("k >= 0")
    full = full.withColumns({"p": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "r": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    first = F.min(F.when(F.col("p") >= target_precision, F.struct("k", "p", "r")))
    return full.groupBy(*by).agg(F.coalesce(first, F.max(F.struct("k", "p", "r"))).alias("x")).select(
        *by, F.col("x.k").alias("threshold_index"), F.col("x.p").alias("hindsight_precision"), F.col("x.r").alias("hindsight_recall"))


def multiclass_recall(df: DataFrame, classes: int, scores: str = "scores", label: str = "label", weight: str = "weight") -> DataFrame:
    """(k, recall): weighted share of rows whose class is among the k+1 highest
    scores; equal scores rank by class."""
    own = F.element_at(F.col(scores), F.col(label).cast("int") + 1)
    above = F.size(F.filter(F.transform(F.col(scores), lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
                            lambda t: (t["x"] > own) | ((t["x"] == own) & (t["i"] < F.col(label)))))
    ranked = df.select(above.alias("rank"), F.col(weight).alias("w"))
    sums = ranked.groupBy("rank").agg(F.sum("w").alias("w"))
    every = df.sparkSession.range(classes).select(F.col("id").cast("int").alias("k"))
    line, whole = Window.orderBy("k"), Window.partitionBy()
    out = every.join(F.broadcast(sums), F.col("k") == F.col("rank"), "left").na.fill(0.0)
    return out.select("k", (F.sum("w").over(line) / F.sum("w").over(whole)).alias("recall"))


def scalar(df: DataFrame, batch: str, value: Column) -> DataFrame:
    """Mean of the last batch, and the mean of the batches' means."""
    means = df.groupBy(batch).agg(F.avg(value).alias("m"))
    return means.agg(F.max_by("m", batch).alias("last_mean"), F.avg("m").alias("window_mean"))


def concordance(df: DataFrame, batch: str) -> DataFrame:
    """Weighted share of pairs of rows of a batch that predictions order as labels
    do (or both tie): XAUC. Ordered pairs are counted, not listed."""
    ordered = ordered_pairs(df, [batch], P(), L(), W()).agg(F.sum("pairs").alias("o"))
    pairs = lambda *keys: df.groupBy(*keys).agg(((F.sum(W()) * F.sum(W()) - F.sum(W() * W())) / 2.0).alias("p")).agg(F.sum("p"))
    tied, every = pairs(batch, "prediction", "label").toDF("t"), pairs(batch).toDF("n")
    return ordered.join(F.broadcast(tied)).join(F.broadcast(every)).select(((F.coalesce("o", F.lit(0.0)) + F.col("t")) / F.col("n")).alias("xauc"))


def regression_auc(df: DataFrame, by: list[str]) -> DataFrame:
    """1 - inversions / pairs of each group, by (prediction, label); null for one
    row. An inversion is a pair whose labels are in the other order than its
    predictions; pairs are counted, not listed."""
    inverted = ordered_pairs(df, by, P(), -L(), F.lit(1.0)).select(*[F.col(c).alias(f"_i_{c}") for c in by], "pairs")
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    both = sizes.join(inverted, [F.col(c).eqNullSafe(F.col(f"_i_{c}")) for c in by], "left")
    n = F.col("_n")
    return both.select(*by, F.when(n > 1, 1.0 - F.coalesce("pairs", F.lit(0.0)) / (n * (n - 1) / 2)).alias("rauc"))


def latest_outputs(df: DataFrame, batch: str, outputs: list[str], by: list[str] = ()) -> DataFrame:
    """The means of model outputs over the last batch of each group: the last write wins."""
    means = df.groupBy(*by, batch).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in outputs])
    return means.groupBy(*by).agg(*[F.max_by(c, batch).alias(f"output_{c}") for c in outputs])


def id_distribution(df: DataFrame, feature: str, id_: str, buckets: int) -> DataFrame:
    """Distinct ids and queries of each hash bucket of each feature."""
    ids = df.groupBy(feature, id_).count()
    return ids.groupBy(feature, F.pmod(F.col(id_), F.lit(buckets)).alias("bucket")).agg(F.count(F.lit(1)).alias("unique_ids"), F.sum("count").alias("queries"))


def collision_bounds(df: DataFrame, slot: Column, id_: str, order: str) -> DataFrame:
    """For each slot: queries, and those that are not its first, rarest or most frequent id's."""
    ids = df.groupBy(slot.alias("slot"), id_).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("at"))
    return ids.groupBy("slot").agg(F.sum("n").alias("total"), (F.sum("n") - F.min_by("n", "at")).alias("collisions_first"),
                                   (F.sum("n") - F.min("n")).alias("collisions_most"), (F.sum("n") - F.max("n")).alias("collisions_least"))


def throughput(log: DataFrame, warmup: int, window_seconds: float, by: list[str] = ()) -> DataFrame:
    """Examples per second over all batches after ``warmup`` and over the last
    ``window_seconds`` of them, from a log (batch, examples, seconds); with ``by``
    for each task. A log has a row per batch; its times are cumulated by the batch."""
    used = log.filter(F.col("batch") > warmup)
    since = F.sum("seconds").over(Window.partitionBy(*by).orderBy(F.desc("batch")))
    return used.withColumn("since", since).groupBy(*by).agg(
        F.sum("examples").alias("total_examples"), (F.sum("examples") / F.sum("seconds")).alias("lifetime_qps"),
        (F.sum(F.when(F.col("since") <= window_seconds, F.col("examples"))) / F.sum(F.when(F.col("since") <= window_seconds, F.col("seconds")))).alias("window_qps"))


def last_percentiles(df: DataFrame, value: str, order: str, n: int, shares: list[float]) -> DataFrame:
    """Percentiles (interpolated) of the last ``n`` values."""
    last = df.orderBy(F.desc(order)).limit(n)
    return last.agg(*[F.percentile(value, F.lit(s)).alias(f"p{str(s)[2:].ljust(2, '0')}") for s in shares])


def remap_telemetry(log: DataFrame, interval: str) -> DataFrame:
    """Rates of a remapper's log (interval, hit, inserted, collided, evicted)."""
    rate = lambda c: (F.count_if(F.col(c)) / F.count(F.lit(1))).alias(f"{c}_rate")
    return log.groupBy(interval).agg(F.count(F.lit(1)).alias("total"), *[rate(c) for c in ("hit", "inserted", "collided", "evicted")])
