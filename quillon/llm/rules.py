"""Quality rules: learned decision lists over text statistics, DataFrame functions only.

Statistics of each text are Spark expressions. Sequential covering learns an
ordered list of rules on the statistics of labelled documents: a rule grows by
the threshold that gains most (FOIL gain) on two thirds of what is left, is
pruned from its end on the other third, and is kept while it is right there often
enough. The list becomes one conditional expression: the first rule that holds
rejects the text, else it is kept.

Only statistics of a bounded sample of labelled rows reach the driver; learning
there is plain Python.

Nulls: a null text has no words; its base test fails. Texts shorter than a window
have no repeated windows. Null labels teach nothing; without labels of one class
the list is empty and keeps all that pass the base. Repeated rows are judged
alike; empty table: no rows; extra columns are kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import WORD, labelled_sample

WINDOW = 8
#: Base test: texts with fewer words, or a larger share (in percent) of repeated words, fail.
LEAST_WORDS, MOST_REPEATED = 20, 30
# Fixed value: the characters counted as symbols.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
PER_CLASS = 2000
FEATURES = ("words", "word_length", "symbols", "capitals", "marks", "dup_lines", "repeated", "stutter")


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words that lie in windows found twice or more, the first included.

    Windows are compared by 64-bit hash. Texts whose windows are all different
    end there; otherwise hashes are sorted with their places, those equal to a
    neighbour are kept, and their windows' union is measured along the text.
    """
    zero = F.lit(0).cast("long")

    def shifted(xs: Column, by: int, end) -> Column:
        return F.concat(F.slice(xs, 2, F.size(xs)), F.array(end)) if by > 0 else F.concat(F.array(end), F.slice(xs, 1, F.size(xs) - 1))

    def union(places: Column) -> Column:
        steps = F.zip_with(places, shifted(places, 1, F.lit(2**30)), lambda a, b: F.least(b - a, F.lit(window)))
        return F.aggregate(steps, zero, lambda s, x: s + x)

    def placed(hashes: Column) -> Column:
        none = F.struct(F.lit(None).cast("long").alias("h"), F.lit(-1).alias("i"))

        def twice(z: Column) -> Column:
            marks = F.arrays_zip(z.alias("z"), shifted(z, 1, none).alias("n"), shifted(z, -1, none).alias("p"))
            same = F.filter(marks, lambda m: (m["z"]["h"] == m["n"]["h"]) | (m["z"]["h"] == m["p"]["h"]))
            return F.sort_array(F.transform(same, lambda m: m["z"]["i"]))

        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _let(_let(ordered, twice), union)

    hashed = lambda ws: F.transform(F.sequence(F.lit(1), F.size(ws) - window + 1), lambda i: F.xxhash64(F.slice(ws, i, window)))
    count = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(placed(h))
    return F.when(F.size(words) < window + 1, zero).otherwise(_let(_let(F.transform(words, lambda w: F.xxhash64(w)), hashed), count))


def stuttered(words: Column) -> Column:
    """Number of words equal to the word before them."""
    same = F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: a == b)
    return F.size(F.filter(same, lambda x: x)).cast("long")


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``stats``: the base counts and what the rules look at."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(_without(x, SPACES)) > 0)
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def measured(ws: Column) -> Column:
        return F.struct(F.size(ws).cast("long").alias("n_words"), repeated_words(ws).alias("n_repeat_words"),
                        stuttered(ws).alias("n_stutter"))

    of_lines = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    w, l = "_quillon_of_words", "_quillon_of_lines"  # noqa: E741
    return docs.withColumn(w, _let(words, measured)).withColumn(l, of_lines).withColumn("stats", F.struct(
        F.col(f"{w}.n_words"), F.col(f"{w}.n_repeat_words"), F.col(f"{w}.n_stutter"), F.col(f"{l}.n_lines"), F.col(f"{l}.n_dup_lines"),
        F.length(_without(t, SPACES)).cast("long").alias("word_chars"),
        (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length(t) - F.length(_without(t, capitals))).cast("long").alias("n_capitals"),
        (F.length(t) - F.length(_without(t, "!?"))).cast("long").alias("n_marks"))).drop(w, l)


def features(stats: str = "stats") -> dict[str, Column]:
    """What thresholds apply to, by name."""
    s = lambda name: F.col(f"{stats}.{name}").cast("double")
    per = lambda a, b: s(a) / F.greatest(s(b), F.lit(1.0))
    return dict(zip(FEATURES, (s("n_words"), per("word_chars", "n_words"), per("n_symbols", "n_words"), per("n_capitals", "word_chars"),
                               per("n_marks", "n_words"), per("n_dup_lines", "n_lines"), per("n_repeat_words", "n_words"), per("n_stutter", "n_words")), strict=True))


def base_failed(stats: str = "stats") -> Column:
    n, r = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (n < LEAST_WORDS) | (100 * r > MOST_REPEATED * n)


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    threshold: float

    def holds(self, row) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Rules in order; a text that one of them covers is rejected."""

    rules: list[tuple[Condition, ...]]

    def __str__(self) -> str:
        return "\n".join([*("reject if " + " and ".join(map(str, r)) for r in self.rules), "else keep"])

    def keeps(self, row) -> bool:
        return not any(all(c.holds(row) for c in rule) for rule in self.rules)

    def kept(self, stats: str = "stats") -> Column:
        """The list as an ordered conditional expression: true to keep."""
        of, out = list(features(stats).values()), F.lit(True)
        for rule in reversed(self.rules):
            test = F.lit(True)
            for c in rule:
                test = test & ((of[c.feature] > c.threshold) if c.above else (of[c.feature] <= c.threshold))
            out = F.when(test, F.lit(False)).otherwise(out)
        return out


def _best(pos: list, neg: list) -> tuple[float, Condition | None]:
    """The condition with the largest FOIL gain over covered positives and negatives."""
    before = math.log2(len(pos) / (len(pos) + len(neg)))
    best: tuple[float, Condition | None] = (1e-9, None)
    for f in range(len(FEATURES)):
        rows = sorted([(r[f], 1) for r in pos] + [(r[f], 0) for r in neg])
        p = n = 0
        for i, (v, y) in enumerate(rows[:-1]):
            p, n = p + y, n + 1 - y
            if rows[i + 1][0] == v:
                continue
            middle = (v + rows[i + 1][0]) / 2
            for above, pp, nn in ((False, p, n), (True, len(pos) - p, len(neg) - n)):
                if pp and (gain := pp * (math.log2(pp / (pp + nn)) - before)) > best[0]:
                    best = (gain, Condition(f, above, middle))
    return best


def learn(rejected: list[tuple], kept: list[tuple], weight: float = 1.0, least_right: float = 0.9, most_rules: int = 12, most_conditions: int = 4) -> DecisionList:
    """Sequential covering of ``rejected`` rows against ``kept`` ones.

    ``weight`` is how many real kept rows one row of the sample stands for,
    relative to a rejected row: precision is judged with it.
    """
    rules: list[tuple[Condition, ...]] = []
    while rejected and kept and len(rules) < most_rules:
        third = lambda rows, prune: [r for i, r in enumerate(rows) if (i % 3 == 2) == prune]
        pos, neg, rule = third(rejected, False), third(kept, False), []
        while pos and neg and len(rule) < most_conditions:
            _, condition = _best(pos, neg)
            if condition is None:
                break
            rule.append(condition)
            pos, neg = ([r for r in rows if condition.holds(r)] for rows in (pos, neg))
        pos, neg = third(rejected, True), third(kept, True)
        cover = lambda rows, conditions: [r for r in rows if all(c.holds(r) for c in conditions)]

        def worth(conditions: list) -> float:
            p, n = len(cover(pos, conditions)), weight * len(cover(neg, conditions))
            return (p - n) / (p + n) if p + n else -1.0

        for size in range(len(rule) - 1, 0, -1):
            if worth(rule[:size]) >= worth(rule):
                rule = rule[:size]
        p, n = len(cover(rejected, rule)), weight * len(cover(kept, rule))
        held = worth(rule) if rule else -1.0
        if not rule or p < 5 or p / (p + n) < least_right or held < 2 * least_right - 1:
            break
        rules.append(tuple(rule))
        rejected = [r for r in rejected if not all(c.holds(r) for c in rule)]
        kept = [r for r in kept if not all(c.holds(r) for c in rule)]
    return DecisionList(rules)


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", per_class: int = PER_CLASS) -> DecisionList:
    """Learns from the statistics of at most ``per_class`` labelled documents of
    each class, chosen by a hash of their id; label 0 is to be rejected.
    Documents that fail the base test teach nothing. The sample is stored before
    its statistics are taken, so that those of other documents are not."""
    sample, counts = labelled_sample(docs, labels, target, F.lit(True), per_class)
    got = with_statistics(sample).filter(~base_failed()).select("doc_id", "y", *[c.alias(n) for n, c in features().items()]).collect()
    got.sort()
    split = {y: [tuple(r)[2:] for r in got if r[1] == y] for y in (0, 1)}
    if not split[0] or not split[1]:
        return DecisionList([])
    weight = (counts[1] / min(counts[1], per_class)) / (counts[0] / min(counts[0], per_class))
    return learn(split[0], split[1], weight)


def judged(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """``docs`` with ``stats``, ``base_failed`` and ``kept``; columns of these
    names are replaced."""
    return with_statistics(docs, text).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.kept())
