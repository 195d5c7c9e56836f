"""Distributed running sums: two levels, so that no key is ever in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """``df`` with, for each ``out: column`` of ``sums``, the sum over the rows up to and with this one.

    Rows of a key are ordered by ``order`` ascending, which should be a total order within a key.
    The rows are cut into ranges of (keys, order), whatever the size of a key; sums run within a
    range and are lifted by the totals of the key's ranges before it.
    """
    ranges = df.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id())
    ranges = staged(ranges, "ranges")
    totals = ranges.groupBy(*keys, "__range").agg(*(F.sum(c).alias(f"__t_{out}") for out, c in sums.items()))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    lifted = totals.select(
        *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)),
        F.col("__range").alias("__r"),
        *(F.coalesce(F.sum(f"__t_{out}").over(before), F.lit(0)).alias(f"__l_{out}") for out in sums),
    )
    match = F.col("__range") == F.col("__r")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    within = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranges.join(lifted, match)
    return joined.select(*df.columns, *((F.sum(c).over(within) + F.col(f"__l_{out}")).alias(out) for out, c in sums.items()))
