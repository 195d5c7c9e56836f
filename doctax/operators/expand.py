"""Expansion to siblings and grouping for grounding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bare_id, variant_parent


def expand_siblings(found: DataFrame, edges: DataFrame, known: DataFrame) -> DataFrame:
    """``(risk_id, source_risk_id)`` of neighbours of found risks that weren't found; the smallest source counts.

    A found variant without neighbours takes those of its parent. ``found`` has ``risk_id``, ``known`` has ``id``.
    """
    ids = found.select(bare_id(F.col("risk_id")).alias("rid")).distinct()
    direct = ids.join(edges, ids.rid == edges.src).select("rid", "dst")
    bare = ids.join(edges.select(F.col("src").alias("rid")).distinct(), "rid", "left_anti").withColumn("src", variant_parent(F.col("rid")))
    through = bare.join(edges, "src").select("rid", "dst")
    fresh = direct.unionByName(through).join(ids.withColumnRenamed("rid", "dst"), "dst", "left_anti")
    fresh = fresh.groupBy(F.col("dst").alias("risk_id")).agg(F.min("rid").alias("source_risk_id"))
    return fresh.join(known.select(F.col("id").alias("risk_id")), "risk_id", "left_semi")


def grounding_groups(expanded: DataFrame, found_chunks: DataFrame, parents: DataFrame, max_risks: int = 15, max_chunks: int = 20) -> DataFrame:
    """``(parent, batch, risk_ids, chunk_ids)``: expanded risks by parent in batches, with the first chunks of their sources.

    The parent is the risk's, else its source's, else ``ungrouped``; groups without chunks fall away.
    ``found_chunks`` has ``risk_id, chunk_id``; ``parents`` has ``id, ispartof``.
    """
    own = parents.select(F.col("id").alias("risk_id"), F.col("ispartof").alias("p1"))
    source = parents.select(F.col("id").alias("source_risk_id"), F.col("ispartof").alias("p2"))
    placed = expanded.join(own, "risk_id", "left").join(source, "source_risk_id", "left").withColumn("parent", F.coalesce("p1", "p2", F.lit("ungrouped")))
    pairs = placed.select("parent", F.col("source_risk_id").alias("risk_id")).distinct().join(found_chunks, "risk_id").select("parent", "chunk_id").distinct()
    order = Window.partitionBy("parent").orderBy("chunk_id")
    first = pairs.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= max_chunks)
    chunks = first.groupBy("parent").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"))
    place = F.row_number().over(Window.partitionBy("parent").orderBy("risk_id"))
    batched = placed.select("parent", "risk_id", F.floor((place - 1) / max_risks).cast("bigint").alias("batch"))
    risks = batched.groupBy("parent", "batch").agg(F.array_sort(F.collect_list("risk_id")).alias("risk_ids"))
    return risks.join(chunks, "parent")
