"""Neighbours of chunks: padding, contexts within a budget, runs of sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sentences, word_count


def padded(chunks: DataFrame, keys: list[str], order: str, n: int = 2) -> DataFrame:
    """``chunks`` with ``padded``: the last ``n`` sentences of the chunk before, the text, the first ``n`` of the next."""
    w = Window.partitionBy(*keys).orderBy(order)
    before, after = sentences(F.lag("text").over(w)), sentences(F.lead("text").over(w))
    head = F.slice(before, F.greatest(F.size(before) - n + 1, F.lit(1)), n)
    parts = F.array_compact(F.concat(F.coalesce(head, F.array().cast("array<string>")), F.array("text"), F.coalesce(F.slice(after, 1, n), F.array().cast("array<string>"))))
    return chunks.withColumn("padded", F.array_join(parts, " "))


def section_groups(chunks: DataFrame, keys: list[str], order: str, size: int = 5) -> DataFrame:
    """``chunks`` with ``run`` and ``part``: consecutive chunks of one section, cut into parts of ``size``.

    A chunk without a section belongs to the one before; those at the start form their own run.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    filled = chunks.withColumn("__s", F.last("section", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.lag("__s").over(w)
    fresh = F.when(F.row_number().over(w) == 1, 1).when(first.eqNullSafe(F.col("__s")), 0).otherwise(1)
    runs = filled.withColumn("__f", fresh).withColumn("run", F.sum("__f").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))
    within = F.row_number().over(Window.partitionBy(*keys, "run").orderBy(order))
    return runs.withColumn("part", F.floor((within - 1) / size).cast("bigint")).drop("__s", "__f")


def contexts(chunks: DataFrame, keys: list[str], order: str, budget: int = 1024) -> DataFrame:
    """``(keys, order, context)``: each chunk with neighbours of its document, taken in turn before and after.

    A side closes at the first neighbour that doesn't fit what is left of the budget of words. Where the section
    changes, its heading comes first. Blank chunks have no words, are in no context and get none; each
    neighbour hence takes a word at least, so that no more than ``budget`` on either side are looked at.
    Neighbours come as word counts; only the texts that are taken are joined.
    """
    rows = chunks.withColumn("__n", word_count(F.col("text"))).where("__n > 0")
    w = Window.partitionBy(*keys).orderBy(order)
    rows = rows.withColumn("__at", F.row_number().over(w))
    near = Window.partitionBy(*keys).orderBy("__at")
    reach = budget
    rows = rows.withColumn("__b", F.reverse(F.collect_list("__n").over(near.rowsBetween(-reach, -1)))).withColumn("__a", F.collect_list("__n").over(near.rowsBetween(1, reach)))
    start = F.struct(
        (F.lit(budget) - F.col("__n")).alias("left"), F.lit(0).alias("b"), F.lit(0).alias("a"), F.lit(True).alias("ob"), F.lit(True).alias("oa"),
    )

    def step(s, i):
        after = i % 2 == 1
        k = F.when(after, s["a"]).otherwise(s["b"])
        n = F.when(after, F.get("__a", s["a"])).otherwise(F.get("__b", s["b"]))
        open_ = F.when(after, s["oa"]).otherwise(s["ob"]) & (s["left"] > 0)
        fits = F.coalesce(open_ & (n <= s["left"]), F.lit(False))
        del k
        return F.struct(
            F.when(fits, s["left"] - n).otherwise(s["left"]).alias("left"),
            (s["b"] + F.when(fits & ~after, 1).otherwise(0)).alias("b"),
            (s["a"] + F.when(fits & after, 1).otherwise(0)).alias("a"),
            F.when(after, s["ob"]).otherwise(s["ob"] & (fits | (s["left"] <= 0))).alias("ob"),
            F.when(after, s["oa"] & (fits | (s["left"] <= 0))).otherwise(s["oa"]).alias("oa"),
        )

    turns = F.sequence(F.lit(0), F.greatest(2 * F.greatest(F.size("__b"), F.size("__a")), F.lit(1)))
    taken = rows.withColumn("__t", F.aggregate(turns, start, step))
    spans = taken.select(*keys, order, "__at", F.explode(F.sequence(F.col("__at") - F.col("__t.b"), F.col("__at") + F.col("__t.a"))).alias("__k"))
    source = rows.select(*keys, F.col("__at").alias("__k"), "text", "section", F.lag("section").over(w).alias("__before"))
    joined = spans.join(source, [*keys, "__k"])
    changed = (F.col("__k") > F.min("__k").over(Window.partitionBy(*keys, "__at"))) & F.col("section").isNotNull() & (F.col("section") != "") & ~F.col("section").eqNullSafe(F.col("__before"))
    joined = joined.withColumn("__x", F.when(changed, F.concat(F.lit("## "), "section", F.lit("\n\n"), "text")).otherwise(F.col("text")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("__k", "__x"))), lambda p: p["__x"])
    return joined.groupBy(*keys, order).agg(F.array_join(parts, "\n\n").alias("context"))
