"""The queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chunking, encoding, fusion, markup, mixing, neardup, overlap, residue, splits, topn

MODULES = (topn, splits, neardup, chunking, fusion, overlap, markup, encoding, mixing, residue)


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
