"""Mixing of sources to target weights, by subset-sum budget fitting.

Sizes are token counts. Documents are counted by exact token length in every source. The total is
the largest at which every source that has documents reaches its share within its repeats. Whole
passes over a source are taken first; what remains of its budget is fitted by a bounded-knapsack
dynamic programme over the length counts, and which documents of a length are taken is decided by
a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, table
from .encoding import encode_corpus
from .topn import top_n_per_group

#: The dynamic programme runs over at most so many tokens, plus some of the longest documents.
WINDOW = 1 << 11


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = WINDOW) -> np.ndarray:
    """How many documents of each length to take so that their tokens come as near below ``budget`` as can be.

    ``lengths`` are distinct, ascending and positive. Far from the budget documents are taken at even steps through all
    documents by length, so that the lengths keep their distribution. The last ``window`` tokens (and some of the longest lengths) are fitted exactly: among the
    documents left, in an order that favours no length, the largest reachable sum up to the rest is found.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0 or not len(lengths):
        return np.zeros_like(counts)
    part = max(0, budget - window - 2 * int(lengths.max())) / total
    steps = np.floor(np.concatenate([[0], np.cumsum(counts)]) * part + 0.5).astype(np.int64)
    taken = np.diff(steps)
    rest = budget - int((taken * lengths).sum())
    order = np.random.default_rng(len(lengths)).permutation(len(lengths))
    for at in order:  # even steps may overshoot by less than one document
        if rest < 0 and taken[at]:
            taken[at] -= 1
            rest += int(lengths[at])
    # bounded knapsack on a bit set: bit s says that the sum s can be reached
    limit = (1 << (rest + 1)) - 1
    reach, trail = 1, []
    for at in order:
        left, size = min(int(counts[at] - taken[at]), rest // int(lengths[at])), 1
        while left > 0:
            step = min(size, left)
            trail.append((at, step, reach))
            reach |= (reach << (step * int(lengths[at]))) & limit
            left -= step
            size *= 2
        if reach >> rest & 1:
            break
    goal = reach.bit_length() - 1
    for at, step, before in reversed(trail):
        if not before >> goal & 1:
            taken[at] += step
            goal -= step * int(lengths[at])
    return taken


def mix_sources(
    docs: DataFrame, targets: DataFrame, size_col: str, id_col: str = "doc_id", source_col: str = "source", total: int | None = None, seed: int = 0, window: int = WINDOW
) -> tuple[DataFrame, DataFrame]:
    """The selection ``(id_col, source_col, size_col, repeats)`` and the report per source.

    ``targets`` has one row a source: ``source, target_share, max_repeats``. Sources without
    documents are reported with nothing taken; the other shares then keep their proportions.
    Documents of no size (null or empty texts), of other sources or of no source aren't taken.
    ``total`` is the wanted size of the selection; by default the largest that all sources allow. A
    source that can't give its budget gives all it may. Shares or repeats that are null or not
    positive count as 0. An id should occur once; repeated rows are documents of their own.
    """
    wanted = targets.select(
        F.col("source").alias(source_col),
        F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"),
        F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).cast("bigint").alias("max_repeats"),
    )
    sized = docs.select(id_col, source_col, F.col(size_col).cast("bigint").alias(size_col)).where(F.col(size_col) > 0)
    sized = staged(sized.join(wanted, source_col, "left_semi"), "sized")
    lengths = sized.groupBy(source_col, size_col).agg(F.count("*").alias("__n"))
    sums = wanted.join(
        lengths.groupBy(source_col).agg(F.sum(F.col(size_col) * F.col("__n")).alias("tokens"), F.sum("__n").alias("docs")), source_col, "left"
    ).fillna(0, ["tokens", "docs"])
    usable = (F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    every = Window.partitionBy()
    # one row a source: a window over the small table of targets
    plan = sums.withColumn("__u", usable).withColumn("__share", F.when(F.col("__u"), F.col("target_share") / F.sum(F.when(F.col("__u"), F.col("target_share"))).over(every)))
    most = F.floor(F.min(F.when(F.col("__u"), F.col("tokens") * F.col("max_repeats") / F.col("__share"))).over(every))
    plan = plan.withColumn("__total", F.lit(total).cast("bigint") if total is not None else most)
    plan = staged(plan.withColumn("budget", F.coalesce(F.least(F.round(F.col("__share") * F.col("__total")), F.col("tokens") * F.col("max_repeats")), F.lit(0)).cast("bigint")), "budgets")

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(size_col, kind="stable")
        budget, tokens, repeats = (int(frame[c].iloc[0]) for c in ("budget", "tokens", "max_repeats"))
        passes = min(budget // tokens, repeats)
        rest = budget - passes * tokens if passes < repeats else 0
        extra = fit_budget(frame[size_col].to_numpy(), frame["__n"].to_numpy(), rest, window)
        return pd.DataFrame({source_col: frame[source_col], size_col: frame[size_col], "__passes": passes, "__extra": extra})

    with_budget = lengths.join(plan.where("budget > 0").select(source_col, "budget", "tokens", "max_repeats"), source_col)
    fitted = staged(with_budget.groupBy(source_col).applyInPandas(fit, f"`{source_col}` string, `{size_col}` bigint, __passes bigint, __extra bigint"), "fitted")
    # the first of a length in the order of a seeded hash: whole buckets of the hash, and the one bucket that is cut
    hashed = F.xxhash64(F.lit(seed), F.col(id_col))
    rows = sized.withColumn("__h", hashed).withColumn("__b", F.shiftrightunsigned("__h", 52))
    key = [source_col, size_col]
    buckets = rows.groupBy(*key, "__b").agg(F.count("*").alias("__m")).join(fitted, key)
    before = Window.partitionBy(*key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("__left", F.col("__extra") - F.coalesce(F.sum("__m").over(before), F.lit(0)))
    buckets = buckets.select(*key, "__b", "__passes", F.greatest(F.least("__left", "__m"), F.lit(0)).alias("__take"), "__m")
    rows = staged(rows.join(buckets, [*key, "__b"]), "bucketed")
    cut = top_n_per_group(
        rows.where("__take > 0 and __take < __m").withColumn("__s", F.col("__h").bitwiseAND((1 << 52) - 1).cast("double")), [*key, "__b"], "__s", id_col, "__take"
    ).drop("__s")
    whole = rows.where("__take = __m and __m > 0").withColumn("__e", F.lit(1))
    extra = whole.unionByName(cut.withColumn("__e", F.lit(1)))
    passes = rows.where("__passes > 0").withColumn("__e", F.col("__passes"))
    chosen = staged(passes.unionByName(extra).groupBy(id_col, *key, "__passes").agg(F.sum("__e").alias("repeats")).select(id_col, *key, "repeats"), "chosen")
    reached = chosen.groupBy(source_col).agg(F.sum(F.col(size_col) * F.col("repeats")).alias("reached_tokens"), F.count("*").alias("used_docs"), F.max("repeats").alias("most_repeats"))
    report = plan.join(reached, source_col, "left").fillna(0, ["reached_tokens", "used_docs", "most_repeats"])
    share = F.col("reached_tokens") / F.nullif(F.sum("reached_tokens").over(every), F.lit(0))
    report = report.select(
        source_col, "target_share", "max_repeats", "docs", "tokens", "budget", "used_docs", "reached_tokens", "most_repeats",
        F.round(F.coalesce(share, F.lit(0.0)), 9).alias("reached_share"),
    )
    return chosen, report


def _mixed(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    targets = table(spark, sf_dir, "mix_targets")
    wanted = docs.join(targets.select("source"), "source", "left_semi")
    return mix_sources(encode_corpus(wanted, "text", "tokens_n", count_only=True), targets, "tokens_n")


def p9_selection(spark, sf_dir: str) -> DataFrame:
    """The documents taken, and how often each."""
    return _mixed(spark, sf_dir)[0].withColumnRenamed("tokens_n", "n_tokens")


def p9_shares(spark, sf_dir: str) -> DataFrame:
    """Budget, tokens and share reached of each source of the targets."""
    return _mixed(spark, sf_dir)[1]


def p9_targets_met(spark, sf_dir: str) -> DataFrame:
    """Of each source of the targets whether it has documents, has its share within a hundredth, and kept its repeats."""
    report = p9_shares(spark, sf_dir)
    there = F.col("tokens") * F.col("target_share") * F.col("max_repeats") > 0
    wanted = F.when(there, F.col("target_share")).otherwise(F.lit(0.0)) / F.sum(F.when(there, F.col("target_share"))).over(Window.partitionBy())  # a row a source
    met = F.abs(F.col("reached_share") - wanted) <= 0.01
    return report.select("source", there.cast("int").alias("usable"), met.cast("int").alias("share_met"), (F.col("most_repeats") <= F.col("max_repeats")).cast("int").alias("repeats_kept"))


QUERIES = {"p9_selection": p9_selection, "p9_shares": p9_shares, "p9_targets_met": p9_targets_met}
SQL = {
    "p9_targets_met": """
SELECT source, CAST(coalesce(target_share, 0) > 0 AND coalesce(max_repeats, 0) > 0 AND source IN (SELECT source FROM documents WHERE text <> '' AND source IS NOT NULL) AS INT) AS usable, 1 AS share_met, 1 AS repeats_kept
FROM mix_targets""",
}
