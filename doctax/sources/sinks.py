"""Writers of results, reports and registries."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def result_rows(merged: DataFrame, version: str = "0.3") -> DataFrame:
    """One nested row a run: ``(version, risks)``; the risks by confidence, then id. A run has at most a row for each entry of its catalogue."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("__o"), "risk_id", F.struct(*merged.columns).alias("risk")))), lambda r: r["risk"])
    return merged.agg(F.lit(version).alias("version"), rows.alias("risks"))


def write_results(merged: DataFrame, folder: str, formats: tuple[str, ...] = ("parquet", "json")) -> None:
    """Matches as Parquet, and the nested result as JSON (or YAML, one small file)."""
    if "parquet" in formats:
        merged.write.mode("overwrite").parquet(f"{folder}/matches.parquet")
    if "json" in formats:
        result_rows(merged).write.mode("overwrite").json(f"{folder}/result.json")
    if "yaml" in formats:
        import yaml

        row = result_rows(merged).toJSON().first()
        Path(folder).mkdir(parents=True, exist_ok=True)
        Path(folder, "result.yaml").write_text(yaml.safe_dump(json.loads(row), allow_unicode=True, sort_keys=False))


def report(rows: DataFrame, title: str, path: str, limit: int = 1000) -> str:
    """An HTML page of a small table; dark if the viewer's system is. A report shows its first ``limit`` rows and says so if there are more."""
    shown = rows.limit(limit + 1).collect()
    note = f"<p>The first {limit} rows.</p>" if len(shown) > limit else ""
    head = "".join(f"<th>{html.escape(c)}</th>" for c in rows.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in shown[:limit])
    style = "body{font-family:sans-serif}td,th{padding:.2em .6em;border-bottom:1px solid #8888}@media (prefers-color-scheme:dark){body{background:#181818;color:#ddd}}"
    page = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1>{note}<table><tr>{head}</tr>{body}</table></body></html>"
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(page)
    return page


def changed_prompts(prompts: DataFrame, registry: DataFrame) -> DataFrame:
    """``(name, digest)`` of prompts ``(name, system, user)`` whose digest the registry ``(name, digest)`` doesn't have."""
    digest = F.sha2(F.concat(F.coalesce("system", F.lit("")), F.coalesce("user", F.lit(""))), 256)
    return prompts.select("name", digest.alias("digest")).join(registry, ["name", "digest"], "left_anti")


def write_calls(calls: DataFrame, folder: str) -> None:
    """The log of model calls, by stage."""
    calls.write.mode("append").partitionBy("stage").parquet(f"{folder}/calls")


def failures(calls: DataFrame) -> DataFrame:
    """Calls that failed: what and why."""
    return calls.where("error is not null").select("stage", "key", "error")
