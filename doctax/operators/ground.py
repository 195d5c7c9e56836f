"""Verdicts of a judge or a grounding model against candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confirmed(candidates: DataFrame, verdicts: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Candidates with a verdict whose flag is true; verdicts on others don't matter."""
    return candidates.join(verdicts.where(F.col(flag)).select(*keys).distinct(), keys, "left_semi")


def rejected(candidates: DataFrame, verdicts: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Candidates without such a verdict."""
    return candidates.join(verdicts.where(F.col(flag)).select(*keys).distinct(), keys, "left_anti")


def grounded(verdicts: DataFrame) -> DataFrame:
    """Verdicts that are grounded and have a quote that isn't blank."""
    return verdicts.where(F.col("grounded") & (F.size(F.filter("quotes", lambda q: F.trim(q) != "")) > 0))


def in_batches(candidates: DataFrame, keys: list[str], order: str, size: int) -> DataFrame:
    """``candidates`` with ``batch``; a size of 0 is one batch."""
    if size <= 0:
        return candidates.withColumn("batch", F.lit(0).cast("bigint"))
    w = Window.partitionBy(*keys).orderBy(order)
    return candidates.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("bigint"))


def selective_variants(parents: DataFrame, bridge: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Matches with parents of families replaced by their grounded variants; parents without any fall away.

    ``parents`` has ``risk_id``; ``bridge`` has ``parent_id, risk_id``; ``verdicts`` has ``risk_id, grounded``.
    """
    families = bridge.select(F.col("parent_id").alias("risk_id")).distinct()
    plain = parents.join(families, "risk_id", "left_anti").withColumn("variant_of", F.lit(None).cast("string"))
    chosen = bridge.join(verdicts.where("grounded").select("risk_id").distinct(), "risk_id", "left_semi")
    named = chosen.select(F.col("risk_id").alias("__v"), F.col("parent_id").alias("risk_id"))
    swapped = parents.join(named, "risk_id").withColumn("variant_of", F.col("risk_id")).withColumn("risk_id", F.col("__v")).drop("__v")
    return plain.unionByName(swapped)


def expand_variants(candidates: DataFrame, bridge: DataFrame) -> DataFrame:
    """Candidates with parents of families replaced by all their variants, scores copied."""
    named = bridge.select(F.col("parent_id").alias("risk_id"), F.col("risk_id").alias("__v"))
    return candidates.join(named, "risk_id", "left").withColumn("risk_id", F.coalesce("__v", "risk_id")).drop("__v")


def located(quotes: DataFrame, passages: DataFrame, group: str) -> DataFrame:
    """``quotes (group, risk_id, quote)`` with the ``chunk_id`` of the first passage that contains the quote, else of the first of its group.

    ``passages`` has ``group, chunk_id, text``; a group has few passages, as grounding asks about at most twenty.
    """
    joined = quotes.where("trim(quote) <> ''").join(passages, group)
    inside = F.min(F.when(F.contains("text", F.col("quote")), F.col("chunk_id")))
    return joined.groupBy(group, "risk_id", "quote").agg(F.coalesce(inside, F.min("chunk_id")).alias("chunk_id"))
