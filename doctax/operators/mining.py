"""Training pairs from runs and ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def seeded(seed: int, *cols: str):
    """An order that is random but the same everywhere: the MD5 of seed and columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in cols)).cast("binary"))


def hard_negatives(positives: DataFrame, pool: DataFrame, keys: list[str], item: str, per_positive: int = 3, seed: int = 0) -> DataFrame:
    """Items of the pool that aren't positive in their group, ``per_positive`` for each positive of the group, in seeded order."""
    wanted = positives.select(*keys, item).distinct().groupBy(*keys).agg((F.count("*") * per_positive).alias("__w"))
    rest = pool.select(*keys, item).distinct().join(positives.select(*keys, item).distinct(), [*keys, item], "left_anti")
    w = Window.partitionBy(*keys).orderBy(seeded(seed, *keys, item), F.col(item))
    return rest.withColumn("__n", F.row_number().over(w)).join(wanted, keys).where("__n <= __w").select(*keys, item)


def mined_negatives(scored: DataFrame, keys: list[str], item: str, positive: str, limit: int = 12, most: int = 5) -> DataFrame:
    """Negatives of the highest score: as many as fit beside the positives, ``most`` at most, none if there is no room."""
    room = scored.groupBy(*keys).agg(F.greatest(F.least(F.lit(most), F.lit(limit) - F.coalesce(F.sum(F.col(positive).cast("int")), F.lit(0))), F.lit(0)).alias("__room"))
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("score"), F.asc(item))
    first = scored.where(~F.col(positive)).withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= most)
    return first.join(room, keys).where("place <= __room").drop("__room")


def first_accepting(accepted: DataFrame, keys: list[str], item: str, order: str) -> DataFrame:
    """For each item of a group the first chunk that accepted it."""
    return accepted.groupBy(*keys, item).agg(F.min(order).alias(order))


def easy_negatives(positives: DataFrame, pool: DataFrame, items: DataFrame, keys: list[str], item: str, per_positive: int = 2, seed: int = 0) -> DataFrame:
    """Items that are neither positive nor in the pool of hard ones of a group, ``per_positive`` for each positive, in seeded order.

    ``items`` is a catalogue: its size bounds what meets each group.
    """
    groups = positives.select(*keys).distinct()
    rest = groups.crossJoin(F.broadcast(items.select(item).distinct())).join(pool.select(*keys, item).distinct(), [*keys, item], "left_anti")
    return hard_negatives(positives, rest, keys, item, per_positive, seed)


def judge_examples(calls: DataFrame, texts: DataFrame, truth: DataFrame, group: list[str], item: str, least_chars: int = 50) -> DataFrame:
    """``calls`` with their text, if it has ``least_chars`` characters, and ``label`` 1 if the item is in the truth of the group.

    ``texts`` has the key columns that it shares with ``calls``, and ``text``.
    """
    shared = [c for c in texts.columns if c in calls.columns]
    known = truth.select(*group, item).distinct().withColumn("__t", F.lit(1))
    rows = calls.join(texts.where(F.length("text") >= least_chars), shared).join(known, [*group, item], "left")
    return rows.withColumn("label", F.coalesce("__t", F.lit(0))).drop("__t")


def threshold_examples(accepted: DataFrame, truth: DataFrame, keys: list[str], order: str, group: list[str], item: str, score: str, most: int = 10) -> DataFrame:
    """For each item of ``keys`` its first chunk, at most ``most`` a chunk by score, of the chunks that have a positive; with ``label``."""
    first = accepted.join(first_accepting(accepted, keys, item, order), [*keys, item, order], "left_semi")
    first = first.groupBy(*keys, item, order, *(g for g in group if g not in keys)).agg(F.max(score).alias(score))
    known = truth.select(*group, item).distinct().withColumn("__t", F.lit(1))
    w = Window.partitionBy(*keys, order).orderBy(F.desc_nulls_last(score), F.asc(item))
    kept = first.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= most)
    labelled = kept.join(known, [*group, item], "left").withColumn("label", F.coalesce("__t", F.lit(0))).drop("__t")
    good = labelled.where("label = 1").select(*keys, order).distinct()
    return labelled.join(good, [*keys, order], "left_semi")


def grounding_negatives(positives: DataFrame, pools: list[DataFrame], keys: list[str], item: str, most: int = 5, limit: int = 12, seed: int = 0) -> DataFrame:
    """Negatives of each group with positives, from the first pool that has them on, in seeded order: as many as fit beside the positives, ``most`` at most."""
    rows = None
    for number, pool in enumerate(pools, 1):
        own = pool.select(*keys, item).distinct().withColumn("pool", F.lit(number))
        rows = own if rows is None else rows.unionByName(own)
    held = positives.select(*keys, item).distinct()
    room = held.groupBy(*keys).agg(F.greatest(F.least(F.lit(most), F.lit(limit) - F.count("*")), F.lit(0)).alias("__room"))
    best = rows.join(held, [*keys, item], "left_anti").groupBy(*keys, item).agg(F.min("pool").alias("pool"))
    w = Window.partitionBy(*keys).orderBy("pool", seeded(seed, *keys, item), item)
    return best.join(room, keys).withColumn("__n", F.row_number().over(w)).where("__n <= __room").select(*keys, item, "pool")
