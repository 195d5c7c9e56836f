"""Chunkers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def plain_pieces(text: str, max_tokens: int = 512) -> list[str]:
    """Windows of four characters a token, each ended after the last line feed in it if there is one past its first character."""
    width, at, out = max_tokens * 4, 0, []
    if len(text) <= width:
        return [text]
    while at < len(text):
        stop = at + width
        if stop < len(text) and (feed := text.rfind("\n", at, stop)) > at:
            stop = feed + 1
        out.append(text[at:stop])
        at = stop
    return out


def plain_chunks(docs: DataFrame, id_col: str, text_col: str, max_tokens: int = 512) -> DataFrame:
    """``(id_col, chunk_index, text)``; null texts give no row, empty ones one empty chunk."""
    key = dict(docs.dtypes)[id_col]

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, n, p) for i, t in zip(frame[id_col], frame[text_col], strict=True) for n, p in enumerate(plain_pieces(t, max_tokens))]
            yield pd.DataFrame(rows, columns=[id_col, "chunk_index", "text"])

    return docs.select(id_col, text_col).where(f"`{text_col}` is not null").mapInPandas(cut, f"`{id_col}` {key}, chunk_index bigint, text string")


def table_text(headers: list[str], rows: list[list[str]], width: int | None = None, caption: str = "") -> str:
    """A table as fenced ``header: value`` lines; missing headers are ``col_<i>``, missing cells empty."""
    names = [*headers, *(f"col_{i}" for i in range(len(headers), width if width is not None else len(headers)))]
    blocks = ["\n".join(["```", *(f"{n}: {row[i] if i < len(row) else ''}" for i, n in enumerate(names)), "```", ""]) for row in rows]
    return "\n".join([f"<!-- table: {caption} -->" if caption else "<!-- table -->", "", *blocks, "<!-- /table -->"])
