"""Queries of the streaming extension, run over whole tables."""

from __future__ import annotations

from ..streaming import ingest
from . import tables as t


def usage_windows(spark, d):
    return ingest.usage_by_window(t.table(spark, d, "events"))


QUERIES = {"usage_windows": usage_windows}
SQL = {
    "usage_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
}
