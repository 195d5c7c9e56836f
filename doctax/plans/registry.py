"""The queries of the engine's own operators, with the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules of this package that hold QUERIES and SQL.
MODULES: tuple[str, ...] = (".q_text", ".q_search", ".q_eval", ".q_mining", ".q_stream")


def queries() -> dict[str, Query]:
    return {name: f for m in MODULES for name, f in importlib.import_module(m, __package__).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in importlib.import_module(m, __package__).SQL.items()}
