"""Merging of matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_best(matches: DataFrame, keys: list[str], id_col: str, payload: list[str]) -> DataFrame:
    """One row per key: the payload of its match of the highest confidence (smallest id if several) and the number of matches."""
    rank = F.struct(F.col("confidence"), -F.col(id_col))
    chosen = F.max_by(F.struct(id_col, "confidence", *payload), rank).alias("r")
    return matches.groupBy(*keys).agg(chosen, F.count("*").alias("n_matches")).select(*keys, "r.*", "n_matches")


def cap_evidence(evidence: DataFrame, keys: list[str], id_col: str, cap: int = 3) -> DataFrame:
    """At most ``cap`` spans per key: equal texts once (that of the highest confidence), best scores first, then ids."""
    once = Window.partitionBy(*keys, "text").orderBy(F.desc("confidence"), F.asc(id_col))
    first = evidence.where("text is not null").withColumn("__n", F.row_number().over(once)).where("__n = 1").drop("__n")
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("score"), F.asc(id_col))
    return first.withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= cap)


def first_pass_wins(verdicts: DataFrame, keys: list[str], pass_col: str) -> DataFrame:
    """The union of several passes: for each key the row of its first pass."""
    w = Window.partitionBy(*keys).orderBy(pass_col)
    return verdicts.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
