"""Decisions about candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import finite
from .retrieval import best


def _rescued(rescue_rank: int) -> Column:
    return F.coalesce((F.col("bm25_rank") > 0) & (F.col("bm25_rank") <= rescue_rank), F.lit(False))


def by_threshold(high: float, low: float = 0.15, rescue_rank: int = 0) -> Column:
    """accepted, borderline or discarded by the cross-encoder's score; one that isn't finite counts as none."""
    score = F.coalesce(finite(F.col("cross_encoder_score")), F.lit(float("-inf")))
    return F.when(score >= high, "accepted").when(score >= low, "borderline").when(_rescued(rescue_rank), "borderline").otherwise("discarded")


def by_rank(df: DataFrame, keys: list[str], id_col: str, accept: int = 5, judge: int = 5, floor: float = 0.0, rescue_rank: int = 0) -> DataFrame:
    """``df`` with ``class``: the floor is tested first, then the place among all candidates of the group.

    Places beyond ``accept + judge`` don't matter, so only the first of each group are ordered.
    """
    scored = df.withColumn("__score", finite(F.col("cross_encoder_score")))
    first = best(scored, keys, "__score", id_col, accept + judge, "__place").select(id_col, "__place")
    low = F.coalesce(F.col("__score") < floor, F.lit(True)) if floor > 0 else F.lit(False)
    late = F.when(_rescued(rescue_rank), "borderline").otherwise("discarded")
    decided = F.when(low, late).when(F.col("__place") <= accept, "accepted").when(F.col("__place") <= accept + judge, "borderline").otherwise(late)
    return scored.join(first, id_col, "left").withColumn("class", decided).drop("__score", "__place")


def classify(df: DataFrame, keys: list[str], id_col: str, threshold_high: float | None = None, threshold_low: float = 0.15, **rank_options) -> DataFrame:
    """By threshold if there is one, else by rank."""
    if threshold_high is not None:
        return df.withColumn("class", by_threshold(threshold_high, threshold_low, rank_options.get("rescue_rank", 0)))
    return by_rank(df, keys, id_col, **rank_options)


def accepted_by(use_cross_encoder: bool = True, no_judge: bool = False) -> Column:
    """What accepted a candidate, from its decision."""
    judged = F.lit("auto_promoted" if no_judge else "llm_judge")
    return F.when(F.col("decision") == "borderline_judged", judged).otherwise(F.lit("threshold" if use_cross_encoder else "rrf"))


def confidence(use_cross_encoder: bool = True) -> Column:
    """The cross-encoder's score, or that of the fusion where there is none."""
    fused = F.coalesce(finite(F.col("rrf_score")), F.lit(0.0))
    return F.coalesce(finite(F.col("cross_encoder_score")), fused) if use_cross_encoder else fused


def predicate_of(similarity: Column, manual: Column | None = None) -> Column:
    """The mapping predicate that a similarity allows."""
    auto = F.when(similarity >= 0.5, "close").when(similarity >= 0.3, "related").otherwise("broad")
    return auto if manual is None else F.when(manual, "related").otherwise(auto)
