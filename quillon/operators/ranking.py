"""Ranking metrics and windows: AUC, AUPRC, session AUC, NDCG, session recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.metrics import ratio
from quillon.operators.prefix import magnitude, running_totals


def L() -> Column:  # noqa: N802
    return F.col("label")


def P() -> Column:  # noqa: N802
    return F.col("prediction")


def W() -> Column:  # noqa: N802
    return F.col("weight")

# The bin of labels, the floor of ideal gains, and the smoothing of session AUC.
LABEL_BIN, IDEAL_FLOOR, GAUC_EPS = 0.039, 1e-6, 1e-9


def _by_prediction(df: DataFrame, by: list[str]) -> DataFrame:
    """Weighted positives and negatives of each distinct prediction, with those
    at higher predictions. Ties are one step, so the order of rows is irrelevant;
    steps are cumulated within buckets of predictions, so that no task sorts all
    predictions of a group."""
    steps = df.groupBy(*by, "prediction").agg(F.sum(W() * L()).alias("t"), F.sum(W() * (1.0 - L())).alias("f"))
    above = running_totals(steps, [F.desc("prediction")], -magnitude(P()), {"ct": F.col("t"), "cf": F.col("f")}, by)
    return above.withColumns({"ct": F.col("ct") + F.col("t"), "cf": F.col("cf") + F.col("f")})


def auc(df: DataFrame, by: list[str], apply_bin: bool = False) -> DataFrame:
    """Area under the curve of true against false positives; 0.5 without signal."""
    if apply_bin:
        df = df.withColumn("label", F.when(L() > LABEL_BIN, 1.0).otherwise(0.0))
    area = F.sum(F.col("f") * (F.col("ct") - F.col("t") / 2.0))
    whole = F.sum("t") * F.sum("f")
    return _by_prediction(df, by).groupBy(*by).agg(F.when(whole == 0, 0.5).otherwise(F.try_divide(area, whole)).alias("auc"))


def auprc(df: DataFrame, by: list[str]) -> DataFrame:
    """Area under precision over recall, by left rectangles at distinct predictions."""
    precision = F.coalesce(F.try_divide(F.col("ct"), F.col("ct") + F.col("cf")), F.lit(0.0))
    area = F.try_divide(F.sum(F.col("t") * precision), F.sum("t"))
    return _by_prediction(df, by).groupBy(*by).agg(F.coalesce(area, F.lit(0.0)).alias("auprc"))


def mean_of_groups(values: DataFrame, value: str, by: list[str], empty: float) -> DataFrame:
    """Unweighted mean over groups."""
    return values.groupBy(*by).agg(F.coalesce(F.avg(value), F.lit(empty)).alias(f"mean_{value}"))


def session_auc(df: DataFrame, session: str, order: list[str], by: list[str] = ()) -> DataFrame:
    """Mean of the sessions' AUC (GAUC) and their number. Sessions of one class
    are left out, and sessions in which every prediction is 0 or equals the first."""
    seq = Window.partitionBy(*by, session).orderBy(*order)
    up = Window.partitionBy(*by, session).orderBy("prediction", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumns({"p0": F.first("prediction").over(seq.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
                           "below": F.sum(W() * (1.0 - L())).over(up)})
    sessions = rows.groupBy(*by, session).agg(
        F.sum(W() * L() * F.col("below")).alias("num"), F.sum(W() * L()).alias("pos"), F.sum(W() * (1.0 - L())).alias("neg"),
        F.max((P() != F.col("p0")) & (P() != 0)).alias("varied"))
    used = sessions.filter((F.col("pos") > 0) & (F.col("neg") > 0) & F.col("varied")).withColumn("a", F.col("num") / (F.col("pos") * F.col("neg") + 1e-10))
    total = used.groupBy(*by).agg(F.sum("a").alias("s"), F.count(F.lit(1)).alias("effective_sessions"))
    return total.select(*by, ((F.coalesce("s", F.lit(0.0)) + GAUC_EPS) / (F.col("effective_sessions") + 2 * GAUC_EPS)).alias("gauc"), "effective_sessions")


def ndcg(df: DataFrame, session: str, order: list[str], k: int | None = None, exponential: bool = False, decreasing: bool = True,
         drop_single: bool = False, scale_by_weight: bool = False) -> DataFrame:
    """Normalized discounted gain: the mean over sessions, and their number.

    ``decreasing`` reports 1 - ndcg; a session counts with its largest weight
    unless ``scale_by_weight`` multiplies gains with weights instead.
    """
    by_prediction = Window.partitionBy(session).orderBy(F.desc("prediction"), *order)
    by_label = Window.partitionBy(session).orderBy(F.desc("label"), *order)
    gain = (F.pow(F.lit(2.0), L()) - 1.0) if exponential else L()
    if scale_by_weight:
        gain = gain * W()
    rows = df.withColumns({"r1": F.row_number().over(by_prediction), "r2": F.row_number().over(by_label), "n": F.count(F.lit(1)).over(Window.partitionBy(session))})
    if drop_single:
        rows = rows.filter("n > 1")
    within = lambda r: F.lit(True) if k is None or k < 0 else F.col(r) <= k
    part = lambda r: F.sum(F.when(within(r), gain / F.log2(F.col(r) + 1.0)).otherwise(0.0))
    sessions = rows.groupBy(session).agg(part("r1").alias("dcg"), part("r2").alias("ideal"), F.max(W()).alias("w"))
    value = F.col("dcg") / F.when(F.col("ideal") == 0, IDEAL_FLOOR).otherwise(F.col("ideal"))
    value = (1.0 - value) if decreasing else value
    value = value if scale_by_weight else value * F.col("w")
    return sessions.agg((F.sum(value) / F.count(F.lit(1))).alias("ndcg"), F.count(F.lit(1)).alias("sessions"))


def rank_in_session(session: str, score: str = "prediction") -> Column:
    """Number of strictly greater scores in the session."""
    return F.rank().over(Window.partitionBy(session).orderBy(F.desc(score))) - 1


def session_threshold(df: DataFrame, session: str, top: int, rank_labels: bool = False) -> DataFrame:
    """Recall and precision where a session's ``top`` predictions count as positive."""
    rows = df.withColumn("rp", rank_in_session(session))
    truth = (rank_in_session(session, "label") < top).cast("double") if rank_labels else L()
    rows = rows.withColumn("y", truth)
    on = F.col("rp") < top
    sums = rows.agg(F.sum(F.when(on, W() * F.col("y")).otherwise(0.0)).alias("tp"), F.sum(F.when(on, W() * (1.0 - F.col("y"))).otherwise(0.0)).alias("fp"),
                    F.sum(F.when(~on, W() * F.col("y")).otherwise(0.0)).alias("fn"))
    return sums.select(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("session_recall"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("session_precision"))


def hits_at(df: DataFrame, row: str, item: list[str], ks: list[int]) -> DataFrame:
    """Mean hit rate and NDCG at each k over rows of scored candidates with 0/1 labels."""
    ranked = df.withColumn("r", F.row_number().over(Window.partitionBy(row).orderBy(F.desc("score"), *item)))
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("n_pos"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    per = ranked.groupBy(row).agg(F.sum("label").alias("n_pos"), *[f for k in ks for f in (
        F.sum(F.when(F.col("r") <= k, F.col("label")).otherwise(0)).alias(f"h{k}"),
        F.sum(F.when(F.col("r") <= k, F.col("label") / F.log2(F.col("r") + 1.0)).otherwise(0.0)).alias(f"d{k}"))])
    per = per.filter("n_pos > 0")
    return per.agg(*[f for k in ks for f in (F.avg(F.col(f"h{k}") / F.least(F.col("n_pos"), F.lit(k))).alias(f"recall_{k}"), F.avg(F.col(f"d{k}") / ideal(k)).alias(f"ndcg_{k}"))])


# --- windows of the last samples ----------------------------------------------
def sliding_batches(batches: DataFrame, batch: str, size: str, window: int, by: list[str] = (), most: int = 1000) -> DataFrame:
    """The newest batches whose sizes add up to at most ``window``; whole batches
    leave, and at most ``most`` stay. ``batches`` has a row per batch."""
    back = Window.partitionBy(*by).orderBy(F.desc(batch))
    return (batches.withColumns({"_cum": F.sum(size).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_rank": F.row_number().over(back)})
            .filter((F.col("_cum") <= window) & (F.col("_rank") <= most)).drop("_cum", "_rank"))


def last_rows(df: DataFrame, order: list[str], n: int, by: list[str] = ()) -> DataFrame:
    """Exactly the last ``n`` rows of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order]))).filter(F.col("_r") <= n).drop("_r")


def seconds_window(seconds: Column, width: int, by: list[str] = ()):
    """A frame of the last ``width`` seconds up to the row."""
    return Window.partitionBy(*by).orderBy(seconds.cast("long")).rangeBetween(-width, 0)
