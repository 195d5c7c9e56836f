"""Evaluation of matches against ground truth."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import precision_recall
from ..shared import settled

#: Thresholds of the sweep, apart from the steps of 0.01 from 0.05 to 0.98.
FIXED_THRESHOLDS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7)


def compared(expected: DataFrame, extracted: DataFrame, keys: list[str]) -> DataFrame:
    """The union of two sets of keys with ``is_expected`` and ``is_extracted``."""
    a = expected.select(*keys).distinct().withColumn("is_expected", F.lit(1))
    b = extracted.select(*keys).distinct().withColumn("is_extracted", F.lit(1))
    return a.join(b, keys, "full_outer").fillna(0, ["is_expected", "is_extracted"])


def scored(sets: DataFrame, groups: list[str], digits: int = 6) -> DataFrame:
    """Counts, precision, recall and F1 of each group of ``compared`` rows."""
    counts = sets.groupBy(*groups).agg(
        F.coalesce(F.sum("is_expected"), F.lit(0)).cast("bigint").alias("expected"),
        F.coalesce(F.sum("is_extracted"), F.lit(0)).cast("bigint").alias("extracted"),
        F.coalesce(F.sum(F.col("is_expected") * F.col("is_extracted")), F.lit(0)).cast("bigint").alias("matched"),
    )
    p, r, f = precision_recall(F.col("matched"), F.col("expected"), F.col("extracted"), digits)
    return counts.withColumns({"precision": p, "recall": r, "f1": f})


def passed(recall, precision, min_recall: float = 0.8, min_precision: float = 0.6) -> F.Column:
    return (recall >= min_recall) & (precision >= min_precision)


def heatmap(rows: DataFrame, value: str, group: str = "policy", column: str = "taxonomy") -> DataFrame:
    """Rows of scores as a table with a column for each value of ``column`` that there is."""
    return rows.groupBy(group).pivot(column).agg(F.max(value))


def extraction_f1(names: DataFrame, matched: DataFrame, group: str, definitional: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall and F1 of matched names of each group: ``(group, expected, predicted, matched, precision, recall, f1)``.

    ``names`` and ``matched`` are those of ``match_names``; predicted names that are only definitions don't count. Nothing expected is
    recalled wholly; nothing predicted is precise only if nothing was expected.
    """
    usable = names.where((F.col("side") != "predicted") | ~F.lower(F.trim("name")).isin(*definitional)) if definitional else names
    counts = usable.groupBy(group).agg(F.count_if(F.col("side") == "expected").alias("expected"), F.count_if(F.col("side") == "predicted").alias("predicted"))
    both = counts.join(matched.groupBy(group).agg(F.count("*").alias("matched")), group, "left").fillna(0, ["matched"])
    p = F.when(F.col("predicted") > 0, F.col("matched") / F.col("predicted")).otherwise((F.col("expected") == 0).cast("double"))
    r = F.when(F.col("expected") > 0, F.col("matched") / F.col("expected")).otherwise(F.lit(1.0))
    both = both.withColumn("__p", p).withColumn("__r", r)
    f = F.when(F.col("__p") + F.col("__r") > 0, 2 * F.col("__p") * F.col("__r") / (F.col("__p") + F.col("__r"))).otherwise(F.lit(0.0))
    return both.select(group, "expected", "predicted", "matched", F.round("__p", 6).alias("precision"), F.round("__r", 6).alias("recall"), F.round(f, 6).alias("f1"))


def differences(sets: DataFrame, groups: list[str], item: str) -> DataFrame:
    """Sorted matched, missing and spurious items of each group."""
    pick = lambda cond: F.array_sort(F.collect_set(F.when(F.expr(cond), F.col(item))))
    return sets.groupBy(*groups).agg(
        pick("is_expected = 1 and is_extracted = 1").alias("matched"),
        pick("is_expected = 1 and is_extracted = 0").alias("missing"),
        pick("is_expected = 0 and is_extracted = 1").alias("spurious"),
    )


def threshold_sweep(pairs: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """Precision, recall, F1 and accuracy of ``label, score`` at each threshold (a score at it is positive).

    Scores are counted by the last threshold that they reach first, so that the thresholds meet counts, not pairs.
    """
    steps = sorted(set(thresholds if thresholds is not None else [*FIXED_THRESHOLDS, *(round(0.05 + 0.01 * i, 2) for i in range(94))]))
    slot = F.lit(0)
    for i, t in enumerate(steps):
        slot = F.when(F.col("score") >= t, i + 1).otherwise(slot)
    counted = pairs.select(slot.alias("slot"), "label").groupBy("slot").agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
    levels = pairs.sparkSession.createDataFrame([(i + 1, t) for i, t in enumerate(steps)], "level int, threshold double")
    joined = levels.crossJoin(counted)
    at = joined.groupBy("level", "threshold").agg(
        F.coalesce(F.sum(F.when(F.col("slot") >= F.col("level"), F.col("pos"))), F.lit(0)).cast("bigint").alias("matched"),
        F.coalesce(F.sum(F.when(F.col("slot") >= F.col("level"), F.col("n"))), F.lit(0)).cast("bigint").alias("extracted"),
        F.sum("pos").cast("bigint").alias("expected"),
    )
    p, r, f = precision_recall(F.col("matched"), F.col("expected"), F.col("extracted"))
    return at.select("threshold", "expected", "extracted", "matched", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row of the highest F1, the first threshold if several."""
    return sweep.orderBy(F.desc("f1"), F.asc("threshold")).limit(1)


def auc_trapz(pairs: DataFrame) -> DataFrame:
    """``auc`` of ``label, score`` by trapezes between distinct scores, from the highest score on; one class only gives 0.

    Equal scores are counted first. Sums run within ranges of scores and are lifted by the totals of the ranges above, so
    that no task has all scores: a trapeze is the negatives of a score times the positives above it and half of its own.
    """
    at = pairs.groupBy("score").agg(F.sum("label").alias("tp"), F.sum(1 - F.col("label")).alias("fp"))
    at = settled(at.repartitionByRange(F.desc("score")).withColumn("__r", F.spark_partition_id()))
    total = at.agg(F.sum("tp").alias("p"), F.sum("fp").alias("n"))
    # one row a range
    ranges = at.groupBy("__r").agg(F.sum("tp").alias("__t"))
    above = ranges.select("__r", F.coalesce(F.sum("__t").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__above"))
    w = Window.partitionBy("__r").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    reached = at.join(F.broadcast(above), "__r").withColumn("__tp", F.col("__above") + F.sum("tp").over(w))
    summed = reached.agg(F.sum(F.col("fp") * (F.col("__tp") - F.col("tp") / 2)).alias("s"))
    auc = F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("s") / (F.col("p") * F.col("n"))).otherwise(F.lit(0.0))
    return summed.crossJoin(total).select(F.round(F.coalesce(auc, F.lit(0.0)), 6).alias("auc"))


def stats_by(pairs: DataFrame, group: str, threshold: float) -> DataFrame:
    """Count, accuracy at the threshold, mean, median and population deviation of the scores of each group."""
    right = F.avg(((F.col("score") >= threshold).cast("int") == F.col("label")).cast("double"))
    return pairs.groupBy(group).agg(
        F.count("*").alias("n"), F.round(right, 6).alias("accuracy"), F.round(F.avg("score"), 6).alias("mean"),
        F.round(F.median("score"), 6).alias("median"), F.round(F.stddev_pop("score"), 6).alias("std"),
    )


def retrieval_recall(expected: DataFrame, retrieved: DataFrame, group: str, item: str) -> DataFrame:
    """Recall of each group that expects something; a group that expects nothing has 1."""
    sets = compared(expected, retrieved, [group, item])
    counts = sets.groupBy(group).agg(F.sum("is_expected").alias("e"), F.sum(F.col("is_expected") * F.col("is_extracted")).alias("m"))
    return counts.select(group, F.round(F.when(F.col("e") > 0, F.col("m") / F.col("e")).otherwise(F.lit(1.0)), 6).alias("recall"))


def grounding_score(decision_f1, quote_f1) -> F.Column:
    return 0.8 * decision_f1 + 0.2 * quote_f1


def _overlap(a: str, b: str, stop: frozenset) -> float:
    import re

    x, y = (set(re.findall("[a-z0-9]+", s.lower())) - stop for s in (a, b))
    return len(x & y) / max(len(x), len(y)) if x and y else 0.0


def match_names(names: DataFrame, group: str, threshold: float = 0.6) -> DataFrame:
    """``(group, predicted, expected, overlap)``: names matched one to one, exactly first, then greedily by overlap of words.

    ``names`` has the group, ``side`` (``predicted`` or ``expected``) and ``name``. Groups are documents, hence small.
    """
    from ..functions.text import STOPWORDS

    stop = frozenset(STOPWORDS)
    key = dict(names.dtypes)[group]

    def match(frame: pd.DataFrame) -> pd.DataFrame:
        free = sorted(frame.loc[frame.side == "expected", "name"].dropna())
        rows = []
        for name in sorted(frame.loc[frame.side == "predicted", "name"].dropna()):
            if name in free:
                rows.append((frame[group].iloc[0], name, name, 1.0))
                free.remove(name)
                continue
            scores = [(_overlap(name, other, stop), other) for other in free]
            top = max(scores, key=lambda s: s[0], default=(0.0, None))
            if top[1] is not None and top[0] >= threshold:
                rows.append((frame[group].iloc[0], name, top[1], top[0]))
                free.remove(top[1])
        return pd.DataFrame(rows, columns=[group, "predicted", "expected", "overlap"])

    return names.groupBy(group).applyInPandas(match, f"`{group}` {key}, predicted string, expected string, overlap double")
