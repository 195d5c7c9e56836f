"""Enrichment with actions, threats and consequences, and the index of actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def actions_of(risks: DataFrame, index: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """``(risk_id, action_id, via)``: a risk's own actions, else those of its crosswalk ids, each once by the smallest id.

    ``index`` has ``risk_id, action_id``; ``crosswalk`` has ``risk_id, home_id``.
    """
    ids = risks.select("risk_id").distinct()
    own = ids.join(index, "risk_id").select("risk_id", "action_id", F.col("risk_id").alias("via")).distinct()
    rest = ids.join(index.select("risk_id").distinct(), "risk_id", "left_anti")
    across = rest.join(crosswalk, "risk_id").join(index.withColumnRenamed("risk_id", "home_id"), "home_id")
    return own.unionByName(across.groupBy("risk_id", "action_id").agg(F.min("home_id").alias("via")))


def filled(risks: DataFrame, values: DataFrame, crosswalk: DataFrame, column: str) -> DataFrame:
    """``risks`` with null ``column`` filled: by the risk's own value, else that of its first crosswalk id with one.

    ``values`` has ``risk_id, value`` without nulls, one row a risk.
    """
    own = values.select("risk_id", F.col("value").alias("__own"))
    across = crosswalk.join(values.withColumnRenamed("risk_id", "home_id"), "home_id").groupBy("risk_id").agg(F.min_by("value", "home_id").alias("__across"))
    joined = risks.join(own, "risk_id", "left").join(across, "risk_id", "left")
    return joined.withColumn(column, F.coalesce(column, "__own", "__across")).drop("__own", "__across")


def described(actions: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Descriptions by action; of several sources the last (``source_order``) that isn't blank wins, trimmed."""
    usable = descriptions.where("trim(description) <> ''")
    last = usable.groupBy("action_id").agg(F.trim(F.max_by("description", "source_order")).alias("description"))
    return actions.join(last, "action_id", "left")


def action_index(actions: DataFrame, prefix: str, explicit: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``(risk_id, action_id, source, category)`` from actions with lists of related risks.

    ``actions`` has ``action_id, source, pos, related``; risks that don't begin with ``prefix`` fall away and an
    action counts once per risk and source, at its first position. The category is that of ``explicit``
    (``action_id, category``), else that of the source and head of the id (``source, head, category``), the
    head being what comes before the first ``-``.
    """
    rows = actions.select("action_id", "source", "pos", F.explode("related").alias("risk_id")).where(F.startswith("risk_id", F.lit(prefix)))
    rows = rows.groupBy("risk_id", "action_id", "source").agg(F.min("pos").alias("pos")).withColumn("head", F.split_part("action_id", F.lit("-"), F.lit(1)))
    named = rows.join(explicit.withColumnRenamed("category", "__e"), "action_id", "left").join(prefixes.withColumnRenamed("category", "__p"), ["source", "head"], "left")
    return named.select("risk_id", "action_id", "source", "pos", F.coalesce("__e", "__p").alias("category"))


def in_degree(links: DataFrame, top: int = 20) -> DataFrame:
    """The ``top`` targets by incoming links; ties to the smaller id."""
    counted = links.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), F.asc("id")).limit(top)


def nearest_in_group(pairs: DataFrame, allowed: DataFrame, override: DataFrame | None = None) -> DataFrame:
    """``(id, target, similarity)``: of each id the target of highest similarity among those of its allowed groups.

    ``pairs`` has ``id, group, target, target_group, similarity``; ``allowed`` has ``group, target_group``;
    ``override`` may fix a group for an id: ``id, target_group``.
    """
    inside = pairs.join(allowed, ["group", "target_group"], "left_semi")
    if override is not None:
        fixed = pairs.join(override, ["id", "target_group"], "left_semi")
        inside = inside.join(override.select("id"), "id", "left_anti").unionByName(fixed)
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), F.asc("target"))
    return inside.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("id", "target", "similarity")
