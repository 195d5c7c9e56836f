"""Splitting of oversized texts at natural boundaries, by balanced targets.

The least number of pieces is computed from the limit and the overlap, equal-length targets are
placed, and each target is snapped to the strongest boundary nearby that keeps every piece within
the limit. If a limit fails, or a cut would miss a boundary that one piece more could use, one piece more is tried.
Lengths are Unicode code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

# Boundaries as (strength, pattern); a cut goes where the match ends. Stronger ones win.
_BOUNDARIES = (
    (6, re.compile(r"(?:\r\n|\r|\n)(?=[ \t]*(?:#{1,6}[ \t]|={1,6}[^=\n\r]+=|<h[1-6][\s>]|\\(?:chapter|(?:sub)*section)\b))", re.I)),
    (5, re.compile(r"(?:\r\n|\r(?!\n)|\n)[ \t]*(?:\r\n|\r(?!\n)|\n)+| |</(?:p|div|table|ul|ol|pre|section)>\s*", re.I)),
    (4, re.compile(r"\r\n|\r(?!\n)|\n| |\u0085|<br\s*/?>", re.I)),
    (3, re.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？；][”’」』）]*")),
    (2, re.compile(r"[;:,]\s+|[，、：]")),
    (1, re.compile(r"\s+")),
)


_CLOSING = frozenset("\"'”’»)]」』）。！？；.!?…;:,，、：>")


def _snap(text: str, target: int, low: int, high: int) -> int:
    """The place of the strongest boundary in [low, high], the nearest to the target if several."""
    if low >= high:
        return max(low, min(target, high))
    begin = low  # a match that ends in the window may begin before it, with a tag, marks and blanks
    while begin > 0 and (text[begin - 1].isspace() or text[begin - 1] in _CLOSING):
        begin -= 1
    begin = max(0, begin - 16)
    for _, pattern in _BOUNDARIES:
        best = -1
        for found in pattern.finditer(text, begin, min(len(text), high + 2)):
            end = found.end()
            if end > high:
                break
            if end >= low and (best < 0 or abs(end - target) < abs(best - target)):
                best = end
        if best >= 0:
            return best
    place = max(low, min(target, high))
    # never between the halves of a line end or before a combining mark
    while place > low and (text[place - 1 : place + 1] == "\r\n" or "̀" <= text[place : place + 1] <= "ͯ"):
        place -= 1
    return place


def split_points(text: str, max_chars: int, overlap: int) -> list[tuple[int, int]]:
    """The (start, end) of the pieces of ``text``; one piece if it is within the limit.

    Every piece has at most ``max_chars`` code points; each piece but the first begins exactly
    ``overlap`` code points before the end of the one before (the whole piece before, if that is
    shorter); without the overlaps the pieces give the text. ``overlap`` must be below ``max_chars``.
    """
    size = len(text)
    if not 0 <= overlap < max_chars:
        raise ValueError("the overlap must be at least 0 and below the limit")
    if size <= max_chars:
        return [(0, size)]
    step = max_chars - overlap
    least = -(-(size - overlap) // step)
    for count in range(least, 2 * least + 2):
        if (cuts := _cuts(text, size, count, max_chars, step, overlap)) is not None:
            return _pieces([0, *cuts, size], overlap)
    # the farthest boundary within each step: twice the least number of pieces isn't enough for balanced ones
    cuts, start = [], 0
    while size - start > (step if cuts else max_chars):
        high = start + (step if cuts else max_chars)
        cuts.append(_snap(text, high, max(start + 1, overlap if not cuts else 0), high))
        start = cuts[-1]
    return _pieces([0, *cuts, size], overlap)


def _pieces(edges: list[int], overlap: int) -> list[tuple[int, int]]:
    return [(max(0, edges[i] - (overlap if i else 0)), edges[i + 1]) for i in range(len(edges) - 1)]


def _cuts(text: str, size: int, count: int, max_chars: int, step: int, overlap: int) -> list[int] | None:
    """The cuts of ``count`` balanced pieces; None if a limit fails or there is a boundary that only more pieces could use."""
    cuts, start, slack = [], 0, max(1, (size // count) // 3)
    for k in range(1, count):
        target, first = round(size * k / count), start + 1 if k > 1 else max(1, overlap)
        # what comes after must still fit into the pieces that are left
        low, high = max(first, size - (count - k) * step), min(start + (max_chars if k == 1 else step), size - 1)
        if low > high:
            return None
        near_low, near_high = max(low, target - slack), min(high, target + slack)
        cut = _snap(text, target, near_low, near_high) if near_low <= near_high else _snap(text, target, low, high)
        if not _is_boundary(text, cut):
            cut = _snap(text, target, low, high)
        if not _is_boundary(text, cut) and low > first and _is_boundary(text, _snap(text, low, first, low)):
            return None
        cuts.append(cut)
        start = cut
    return cuts if size - start <= (step if cuts else max_chars) else None


def _is_boundary(text: str, place: int) -> bool:
    before = text[place - 1 : place]
    return before.isspace() or before in "。！？；，、：>" or text[place : place + 1].isspace()


def split_oversized(df: DataFrame, id_col: str, text_col: str, max_chars: int, overlap: int, with_text: bool = True) -> DataFrame:
    """The pieces of every text above the limit: ``(id_col, piece_no, start, end[, piece])``.

    Texts within the limit, empty and null ones give no rows. Repeated rows of one id give the pieces of one text:
    the longest, and of several of that length the one with the largest hash. A null id is an id.
    Whole texts are cut; only oversized ones reach Python.
    """
    key = dict(df.select(id_col).dtypes)[id_col]
    part = "struct<start:int,end:int" + (",piece:string>" if with_text else ">")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), *([("piece", pa.string())] if with_text else [])]))
        for batch in batches:
            rows = []
            for text in batch.column("__text").to_pylist():
                pieces = split_points(text, max_chars, overlap)
                rows.append([{"start": a, "end": b} | ({"piece": text[a:b]} if with_text else {}) for a, b in pieces])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (id_col, "__size", "__hash")), pa.array(rows, kind)], [id_col, "__size", "__hash", "__pieces"])

    over = df.select(id_col, F.col(text_col).alias("__text")).where(F.char_length("__text") > max_chars)
    over = over.select(id_col, F.char_length("__text").alias("__size"), F.xxhash64("__text").alias("__hash"), "__text")
    # all pieces of a text stay together until one text of each id is chosen
    cut_ = over.mapInArrow(cut, f"`{id_col}` {key}, __size int, __hash bigint, __pieces array<{part}>")
    chosen = cut_.groupBy(id_col).agg(F.max(F.struct("__size", "__hash", "__pieces")).alias("__c"))
    return chosen.select(id_col, F.posexplode("__c.__pieces").alias("piece_no", "__p")).select(id_col, "piece_no", "__p.*")


def _limits(spark, sf_dir: str) -> dict[str, tuple[int, int]]:
    """Two rows: the kinds and their limits."""
    return {r.item_kind: (r.max_chars, r.overlap_chars) for r in table(spark, sf_dir, "size_limits").collect()}


def _both(spark, sf_dir: str, with_text: bool) -> DataFrame:
    limits = _limits(spark, sf_dir)
    parts = []
    for kind, name, key, text in (("content", "parsed_documents", "parsed_id", "content"), ("chunk", "chunks", "chunk_id", "text")):
        most, overlap = limits[kind]
        pieces = split_oversized(table(spark, sf_dir, name), key, text, most, overlap, with_text)
        parts.append(pieces.withColumnRenamed(key, "item_id").withColumn("item_kind", F.lit(kind)))
    return parts[0].unionByName(parts[1])


def p4_found(spark, sf_dir: str) -> DataFrame:
    """The items that the operator cuts into more than one piece."""
    return _both(spark, sf_dir, False).where("piece_no = 1").select("item_kind", "item_id")


def p4_pieces(spark, sf_dir: str) -> DataFrame:
    """All pieces of all oversized contents and chunk texts."""
    return _both(spark, sf_dir, True).select("item_kind", "item_id", "piece_no", "start", "end", "piece")


def p4_tiling(spark, sf_dir: str) -> DataFrame:
    """Of every oversized item the pieces laid end to end: what they cover without overlaps, the longest, and the overlaps that are as wanted."""
    limits = _limits(spark, sf_dir)
    before = Window.partitionBy("item_kind", "item_id").orderBy("piece_no")
    rows = _both(spark, sf_dir, False).withColumn("__last", F.lag("end").over(before))
    wanted = F.when(F.col("item_kind") == "content", limits["content"][1]).otherwise(limits["chunk"][1])
    most = F.when(F.col("item_kind") == "content", limits["content"][0]).otherwise(limits["chunk"][0])
    good = F.when(F.col("__last").isNull(), F.col("start") == 0).otherwise(F.col("__last") - F.col("start") == wanted)
    return rows.groupBy("item_kind", "item_id").agg(
        F.sum(F.col("end") - F.greatest(F.col("start"), F.coalesce("__last", F.lit(0)))).alias("covered"), F.max("end").alias("chars"),
        F.max((F.col("end") - F.col("start") > most).cast("int")).alias("too_long"), F.min(good.cast("int")).alias("overlaps_right"),
    )


QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces, "p4_tiling": p4_tiling}
SQL = {
    "p4_found": """
SELECT DISTINCT 'content' AS item_kind, parsed_id AS item_id FROM parsed_documents
WHERE length(content) > (SELECT max_chars FROM size_limits WHERE item_kind = 'content')
UNION ALL
SELECT DISTINCT 'chunk', chunk_id FROM chunks
WHERE length(text) > (SELECT max_chars FROM size_limits WHERE item_kind = 'chunk')""",
    "p4_tiling": """
SELECT item_kind, item_id, max(n) AS covered, max(n) AS chars, 0 AS too_long, 1 AS overlaps_right FROM (
  SELECT 'content' AS item_kind, parsed_id AS item_id, length(content) AS n FROM parsed_documents
  UNION ALL SELECT 'chunk', chunk_id, length(text) FROM chunks) JOIN size_limits USING (item_kind)
WHERE n > max_chars GROUP BY item_kind, item_id""",
}
