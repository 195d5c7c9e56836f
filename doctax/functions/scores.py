"""Score functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Constant of reciprocal rank fusion.
RRF_K = 60


def finite(score: Column) -> Column:
    """The score, null where it is null, NaN or infinite."""
    value = score.cast("double")
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), value)


def sigmoid(score: Column) -> Column:
    return 1 / (1 + F.exp(-score))


def clipped(score: Column) -> Column:
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def last_softmax(scores: Column) -> Column:
    """The last column of a row's softmax."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda n, x: n + F.exp(x - top))
    return F.exp(F.element_at(scores, -1) - top) / total


def yes_probability(yes: Column, no: Column, missing: float = -10.0) -> Column:
    a, b = F.exp(F.coalesce(yes, F.lit(missing))), F.exp(F.coalesce(no, F.lit(missing)))
    return a / (a + b)


def rrf_term(rank: Column, k: int = RRF_K) -> Column:
    return F.coalesce(1.0 / (k + rank), F.lit(0.0))


def precision_recall(matched: Column, expected: Column, extracted: Column, digits: int = 6) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; 0 where a denominator is 0."""
    p = F.when(extracted > 0, matched / extracted).otherwise(F.lit(0.0))
    r = F.when(expected > 0, matched / expected).otherwise(F.lit(0.0))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return F.round(p, digits), F.round(r, digits), F.round(f, digits)
