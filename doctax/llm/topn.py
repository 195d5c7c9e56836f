"""Top N items within every group, by simultaneous bisection of per-group cutoffs.

Each row gets an order-preserving code: the score as an unsigned 64-bit number that sorts like the
double, then the identifier in reverse, so that codes of different rows differ. All groups of a
block refine their cutoffs at once: rows above the middle of each group's interval are counted, and
the interval's half that still brackets the N-th row is kept, until each group holds exactly N.

The cut runs twice. Before the shuffle every task cuts its own rows, so a group of any size sends at
most N rows per block; after the shuffle on the group, the same cut runs over what is left, sorted by group and block by block:
groups that have ended leave, a group larger than a block is cut as it comes. No group
is ever gathered whole, and there is one shuffle of reduced rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dense_groups, table

_SIGN = np.uint64(1 << 63)


def score_code(score: np.ndarray) -> np.ndarray:
    """Unsigned numbers that sort as the doubles do; both zeros have one code."""
    bits = (score.astype(np.float64) + 0.0).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def id_code(ids: np.ndarray) -> np.ndarray:
    """Unsigned numbers that sort against the identifiers: the smallest identifier is highest."""
    return ~(ids.astype(np.int64).view(np.uint64) ^ _SIGN)


def bisect_cutoffs(group: np.ndarray, code: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per group the largest cutoff with at least ``need`` codes at or above it, and the count above.

    ``need`` must lie between 1 and the group's size. Rows that are decided leave the arrays.
    """
    groups = len(need)
    low = np.full(groups, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(groups, np.uint64)
    np.minimum.at(low, group, code)
    np.maximum.at(high, group, code)
    sure = np.zeros(groups, np.int64)  # codes above the interval
    while True:
        active = (low < high)[group]
        if not active.all():
            group, code = group[active], code[active]
        if not len(group):
            return low, sure
        middle = low + (high - low) // np.uint64(2) + np.uint64(1)
        above = code >= middle[group]
        count = sure + np.bincount(group[above], minlength=groups)
        up = count >= need
        open_ = low < high
        # keep the half with the N-th row
        low = np.where(open_ & up, middle, low)
        newly = open_ & ~up
        high = np.where(newly, middle - np.uint64(1), high)
        keep = np.where(up[group], above, ~above)
        sure = np.where(newly, count, sure)
        group, code = group[keep], code[keep]


def cut_mask(group: np.ndarray, groups: int, score: np.ndarray, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The rows that hold each group's first ``n`` by score descending, identifier ascending."""
    size = np.bincount(group, minlength=groups)
    mask = np.ones(len(group), bool)
    over = size > n
    mask[(n <= 0)[group]] = False
    rows = np.flatnonzero(over[group] & (n > 0)[group])
    if not len(rows):
        return mask
    names, g = np.unique(group[rows], return_inverse=True)
    need, code = n[names], score_code(score[rows])
    cut, above = bisect_cutoffs(g, code, need)
    mask[rows] = code > cut[g]
    tied = np.flatnonzero(code == cut[g])
    left = need - above
    tied_g = g[tied]
    whole = np.bincount(tied_g, minlength=len(names)) == left
    mask[rows[tied[whole[tied_g]]]] = True
    tied = tied[~whole[tied_g]]
    if len(tied):
        names2, g2 = np.unique(g[tied], return_inverse=True)
        second, need2 = id_code(ids[rows[tied]]), left[names2]
        cut2, above2 = bisect_cutoffs(g2, second, need2)
        mask[rows[tied[second > cut2[g2]]]] = True
        # rows with one score and one identifier can't be told apart: as many as are needed
        same = np.flatnonzero(second == cut2[g2])
        order = same[np.argsort(g2[same], kind="stable")]
        first = np.searchsorted(g2[order], np.arange(len(names2)))
        place = np.arange(len(order)) - first[g2[order]]
        mask[rows[tied[order[place < (need2 - above2)[g2[order]]]]]] = True
    return mask


def _cutter(group_cols: list[str], score_col: str, id_col: str, n: int | str, block_rows: int, grouped: bool):
    """Cuts rows to N per group, block by block; ``grouped`` rows come with those of a group together."""

    def cut(held: pa.Table) -> pa.Table:
        group, groups = dense_groups([held.column(c) for c in group_cols])
        if isinstance(n, str):
            wanted = np.zeros(groups, np.int64)
            np.maximum.at(wanted, group, held.column(n).fill_null(0).to_numpy().astype(np.int64))
        else:
            wanted = np.full(groups, n, np.int64)
        ids = held.column(id_col).cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy()
        return held.filter(pa.array(cut_mask(group, groups, held.column(score_col).to_numpy(), ids, wanted)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, rows = None, [], 0
        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= block_rows:
                held = cut(pa.Table.from_batches([*(held.to_batches() if held is not None else []), *waiting]))
                waiting, rows = [], 0
                if grouped and held.num_rows:  # all groups but the last have ended
                    group, _ = dense_groups([held.column(c) for c in group_cols])
                    ended = int(np.argmax(group == group[-1]))
                    yield from held.slice(0, ended).to_batches()
                    held = held.slice(ended)
                elif not grouped and held.num_rows > 2 * block_rows:
                    yield from held.to_batches()
                    held = None
        parts = [*(held.to_batches() if held is not None else []), *waiting]
        if parts:
            yield from cut(pa.Table.from_batches(parts)).to_batches()

    return run


def top_n_per_group(
    df: DataFrame, group_cols: list[str], score_col: str, id_col: str, n: int | str = 10, block_rows: int = 400_000
) -> DataFrame:
    """The ``n`` rows with the highest score of every group, all columns kept.

    Ties go to the smaller identifier; a null identifier is last. Rows whose score is null, NaN or
    infinite are left out. Null is a group value like any other. Rows alike in group, score and
    identifier count one by one, and which of them stay is left open, since they can't be told
    apart by the rule. ``n`` may name a column with each group's own count (its largest value in the
    group counts). An empty input gives an empty result. The identifier must be of an integer type.
    """
    score = F.col(score_col).cast("double")
    usable = df.where(score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf")))
    usable = usable.withColumn("__score", score)
    local = usable.mapInArrow(_cutter(group_cols, "__score", id_col, n, block_rows, False), usable.schema)
    spread = local.repartition(*group_cols).sortWithinPartitions(*group_cols)
    return spread.mapInArrow(_cutter(group_cols, "__score", id_col, n, block_rows, True), usable.schema).drop("__score")


def standing_candidates(candidates: DataFrame) -> DataFrame:
    """One row per ``candidate_id``: the one with the latest ``scored_at``.

    If several share that time, the last ``ingested_at`` stands, then the highest score.
    """
    stands = F.max(F.struct("scored_at", "ingested_at", "cross_encoder_score", "source", "chunk_index")).alias("r")
    return candidates.groupBy("candidate_id").agg(stands).select(
        "candidate_id", "r.source", "r.chunk_index", "r.cross_encoder_score"
    )


def p1_found(spark, sf_dir: str) -> DataFrame:
    """The candidates among the ten best of their chunk result."""
    rows = standing_candidates(table(spark, sf_dir, "candidates"))
    return top_n_per_group(rows, ["source", "chunk_index"], "cross_encoder_score", "candidate_id", 10).select("candidate_id")


def p1_top10(spark, sf_dir: str) -> DataFrame:
    """The ten best of each chunk result with their place; a group has at most ten rows here."""
    from pyspark.sql import Window

    rows = standing_candidates(table(spark, sf_dir, "candidates"))
    best = top_n_per_group(rows, ["source", "chunk_index"], "cross_encoder_score", "candidate_id", 10)
    place = Window.partitionBy("source", "chunk_index").orderBy(F.desc("cross_encoder_score"), F.asc("candidate_id"))
    return best.select(
        "source", "chunk_index", "candidate_id", "cross_encoder_score", F.row_number().over(place).cast("bigint").alias("place")
    )


_BEST = """
WITH ranked AS (
  SELECT *, row_number() OVER (PARTITION BY candidate_id
    ORDER BY scored_at DESC NULLS LAST, ingested_at DESC NULLS LAST, cross_encoder_score DESC NULLS LAST) AS v
  FROM candidates),
stands AS (
  SELECT source, chunk_index, candidate_id, cross_encoder_score FROM ranked
  WHERE v = 1 AND cross_encoder_score IS NOT NULL AND isfinite(cross_encoder_score)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source, chunk_index
    ORDER BY cross_encoder_score DESC, candidate_id) AS place FROM stands)
"""

QUERIES = {"p1_found": p1_found, "p1_top10": p1_top10}
SQL = {
    "p1_found": _BEST + "SELECT candidate_id FROM placed WHERE place <= 10",
    "p1_top10": _BEST
    + "SELECT source, chunk_index, candidate_id, cross_encoder_score, place FROM placed WHERE place <= 10",
}
