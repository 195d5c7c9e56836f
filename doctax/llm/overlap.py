"""The same or almost the same texts across splits: an edit-distance segment join.

Two texts are compared as strings over shingles: the set of a text's word shingles in one global order, rarest
first. In sorted strings without repeats, the edit distance with insertions and deletions is the number of
shingles that only one has; with sizes s and t, a Jaccard similarity of at least J is the same as a
distance of at most k = s + t - 2 * ceil(J / (1 + J) * (s + t)). A passage moved elsewhere costs few
edits in this form, where it would cost its whole length in plain characters.

* Strings are cut into segments by a hash of their symbols, evaluation and training strings alike, so a segment is the
  same stretch of symbols in both. Cutting into k + 1 segments, of which an edit spoils one at most, isn't possible in general here: k
  is about two thirds of a string, so segments would be one or two symbols, and at least as many of one symbol as the
  prefix of an inverted-list join has. So there are fewer and longer segments, and the edits are shared out: in at least
  one segment there are no more than its share, (1 - J) / (1 + J) of its two lengths.
* Segments of training strings are indexed by their symbols, those of evaluation strings look them up (the other way
  round where the evaluation segment is the shorter). A match counts only at allowed positions: what stands before it
  in both, and the parities of what stands after, may not exceed the share of edits.
* Pairs that match are verified by dynamic programming in a band of k around the diagonal of the whole strings.

The exchange of segments is that of ``neardup``; lists are kept apart by side, so that only evaluation and training meet.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, table
from .neardup import PAIRS_SQL, SimilarSets
from .splits import FILE_SQL, canonical_source, split_value


def banded_distance(one: list[np.ndarray], two: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """The insert-and-delete distance of each pair of strings, or ``most + 1`` where it is above ``most``.

    All pairs are computed at once, row by row. A cell is kept for each diagonal of the band.
    """
    pairs = len(one)
    if not pairs:
        return np.zeros(0, np.int64)
    n, m = np.array([len(x) for x in one]), np.array([len(x) for x in two])
    width = int(most.max())
    rows = int(n.max())
    left = np.full((pairs, rows), -1, np.int64)
    right = np.full((pairs, int(m.max()) + 2 * width + rows + 2), -2, np.int64)
    for i in range(pairs):
        left[i, : n[i]] = one[i]
        right[i, width : width + m[i]] = two[i]
    far = np.int32(1 << 20)
    offset = np.arange(-width, width + 1)
    # cell d of row i: distance of the first i symbols of one and the first i + d - width of two
    cells = np.where(offset >= 0, offset, far).astype(np.int32)[None, :].repeat(pairs, 0)
    answer = np.where(n == 0, m, far).astype(np.int64)
    steps = np.arange(2 * width + 1, dtype=np.int32)
    for i in range(1, rows + 1):
        column = i + offset
        up = np.concatenate([cells[:, 1:], np.full((pairs, 1), far, np.int32)], axis=1) + 1
        same = right[:, i - 1 : i + 2 * width] == left[:, i - 1 : i]
        fresh = np.minimum(up, np.where(same, cells, far))
        fresh[:, column < 0] = far
        fresh[:, column == 0] = i
        # insertions along the row: the least of (cell - place), then the place again
        cells = np.minimum.accumulate(fresh - steps[None, :], axis=1) + steps[None, :]
        ends = np.flatnonzero(n == i)
        if len(ends):
            at = m[ends] - i + width
            inside = (at >= 0) & (at <= 2 * width)
            answer[ends[inside]] = cells[ends[inside], at[inside]]
    return np.minimum(answer, most + 1)


def least_distance(one: list[np.ndarray], two: list[np.ndarray], bits: int = 4096, block: int = 256) -> np.ndarray:
    """A number that the distance of each pair isn't below: the bits in which the parities of their symbols differ."""
    out = np.zeros(len(one), np.int64)
    for at in range(0, len(one), block):
        parts = [np.concatenate([x, y]) for x, y in zip(one[at : at + block], two[at : at + block], strict=True)]
        pair = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        symbol = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        odd = np.bincount(pair * bits + (symbol * 0x9E3779B1 >> 7 & (bits - 1)), minlength=len(parts) * bits) & 1
        out[at : at + len(parts)] = odd.reshape(len(parts), bits).sum(axis=1)
    return out


def _by_distance(threshold: float):
    """Symbols in common, from the banded distance."""

    def common(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(x) + len(y) for x, y in zip(one, two, strict=True)], np.int64)
        out = np.zeros(len(one), np.int64)
        most = sizes - 2 * np.ceil(threshold / (1 + threshold) * sizes - 1e-9).astype(np.int64)
        near = np.flatnonzero(least_distance(one, two) <= most)
        order = near[np.argsort(sizes[near], kind="stable")]
        for at in range(0, len(order), 128):  # alike in length, so that little is padded
            part = order[at : at + 128]
            distance = banded_distance([one[i] for i in part], [two[i] for i in part], most[part])
            out[part] = np.where(distance <= most[part], (sizes[part] - distance) // 2, 0)
        return out

    return common


def cross_split_overlaps(df: DataFrame, id_col: str, text_col: str, split_col: str, train: str = "train", k: int = 5, threshold: float = 0.8, min_words: int = 1) -> DataFrame:
    """``(train_id, eval_id)`` of all similar pairs of a training text and a text of another split.

    ``split_col`` has clean names; rows of no split (null) take no part, nor do null ids and texts, or
    texts of fewer than ``min_words`` or ``k`` words. Rows that repeat an id are one text of one split
    (they should agree). All members of a class of equal texts are listed, however many there are.
    """
    links, members = class_overlaps(df, id_col, text_col, split_col, train, k, threshold, min_words)
    one = members.select(F.col("rep").alias("train_rep"), F.col("id").alias("train_id"))
    two = members.select(F.col("rep").alias("eval_rep"), F.col("id").alias("eval_id"))
    pairs = links.join(one, "train_rep", "left").join(two, "eval_rep", "left")
    return pairs.select(F.coalesce("train_id", "train_rep").alias("train_id"), F.coalesce("eval_id", "eval_rep").alias("eval_id"))


def class_overlaps(df: DataFrame, id_col: str, text_col: str, split_col: str, train: str = "train", k: int = 5, threshold: float = 0.8, min_words: int = 1) -> tuple[DataFrame, DataFrame]:
    """The links ``(train_rep, eval_rep)`` between classes of equal texts, and the members ``(id, rep, n)`` of the classes of more than one text.

    Texts of the training split and of the others are different classes. The members grow with the texts, the links
    don't grow with copies.
    """
    role = F.when(F.col(split_col) == train, 1).when(F.col(split_col).isNotNull(), 2)
    rows = df.select(id_col, text_col, role.alias("__role"))
    join = SimilarSets(rows, id_col, text_col, k, threshold, min_words, role_col="__role")
    links = staged(join.links(_by_distance(threshold)).select("a", "b"), "links")
    side = rows.where("__role = 1").select(F.col(id_col).cast("bigint").alias("a"), F.lit(True).alias("first")).distinct()
    marked = links.join(side, "a", "left")
    train_rep, eval_rep = F.when(F.col("first"), F.col("a")).otherwise(F.col("b")), F.when(F.col("first"), F.col("b")).otherwise(F.col("a"))
    return staged(marked.select(train_rep.alias("train_rep"), eval_rep.alias("eval_rep")), "overlaps"), staged(join.members.select("id", "rep", "n"), "members")


def _chunks(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").select("chunk_id", "text", split_value(F.col("split_name")).alias("split"))


#: As problem 3 has it: three words, half in common, twelve words at least.
CASE = {"k": 3, "threshold": 0.5, "min_words": 12}


def p6_found(spark, sf_dir: str) -> DataFrame:
    """Pairs of similar chunks of which one is in train and the other in validation or test."""
    pair = F.least("train_id", "eval_id").alias("chunk_id_a"), F.greatest("train_id", "eval_id").alias("chunk_id_b")
    return cross_split_overlaps(_chunks(spark, sf_dir), "chunk_id", "text", "split", **CASE).select(*pair)


def p6_report(spark, sf_dir: str) -> DataFrame:
    """Per split and source of the evaluation side: chunks that overlap with train, pairs, and the training chunks in them.

    Counted from classes and their members, so that copies aren't expanded into pairs.
    """
    links, members = class_overlaps(_chunks(spark, sf_dir), "chunk_id", "text", "split", **CASE)
    of = table(spark, sf_dir, "chunks").select(F.col("chunk_id").alias("id"), split_value(F.col("split_name")).alias("split"), canonical_source(F.col("source")).alias("source"))
    of = of.where("split <> 'train'").distinct().join(members.select("id", "rep"), "id", "left").select("split", "source", F.coalesce("rep", "id").alias("eval_rep"))
    held = of.groupBy("split", "source", "eval_rep").agg(F.count("*").alias("held"))
    size = members.select(F.col("rep").alias("train_rep"), F.col("n").alias("train_n")).distinct()
    met = links.join(size, "train_rep", "left").withColumn("train_n", F.coalesce("train_n", F.lit(1)))
    pairs = staged(held.join(met, "eval_rep"), "held")
    key = ["split", "source"]
    texts = pairs.groupBy(*key, "eval_rep").agg(F.first("held").alias("held"), F.sum(F.col("held") * F.col("train_n")).alias("pairs"))
    texts = texts.groupBy(*key).agg(F.sum("held").alias("chunks"), F.sum("pairs").alias("pairs"))
    trained = pairs.select(*key, "train_rep", "train_n").distinct().groupBy(*key).agg(F.sum("train_n").alias("train_chunks"))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in key]
    return texts.alias("x").join(trained.alias("y"), same).select("x.split", "x.source", "chunks", "pairs", "train_chunks")


QUERIES = {"p6_found": p6_found, "p6_report": p6_report}
_SIDES = f"""{PAIRS_SQL},
place AS (
  SELECT DISTINCT chunk_id, lower(trim(split_name, ' \t\n\r')) AS split, {FILE_SQL} AS source FROM chunks
  WHERE lower(trim(split_name, ' \t\n\r')) IN ('train', 'validation', 'test')),
overlap AS (
  SELECT chunk_id_a, chunk_id_b, CASE WHEN x.split = 'train' THEN chunk_id_a ELSE chunk_id_b END AS train_id, CASE WHEN x.split = 'train' THEN chunk_id_b ELSE chunk_id_a END AS eval_id
  FROM pair JOIN place x ON x.chunk_id = chunk_id_a JOIN place y ON y.chunk_id = chunk_id_b WHERE (x.split = 'train') <> (y.split = 'train'))"""
SQL = {
    "p6_found": f"WITH {_SIDES} SELECT DISTINCT chunk_id_a, chunk_id_b FROM overlap",
    "p6_report": f"""
WITH {_SIDES}
SELECT split, source, count(DISTINCT eval_id) AS chunks, count(*) AS pairs, count(DISTINCT train_id) AS train_chunks
FROM (SELECT DISTINCT train_id, eval_id FROM overlap) JOIN place ON place.chunk_id = eval_id GROUP BY split, source""",
}
