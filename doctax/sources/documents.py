"""Readers of documents and of the small files around them."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes that need a converter; of these HTML and Markdown can be read without one.
RICH = (".pdf", ".docx", ".html", ".htm", ".pptx", ".xlsx", ".md")
READABLE = (".html", ".htm", ".md")
MIN_WORDS = 10


class _Text(HTMLParser):
    skipped = frozenset(("script", "style", "nav", "head", "header", "footer", "aside", "template"))
    breaks = frozenset("p div br li tr h1 h2 h3 h4 h5 h6 table ul ol section article pre blockquote".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.deep = 0

    def handle_starttag(self, tag, attrs):
        if tag in self.skipped:
            self.deep += 1
        elif tag in self.breaks:
            self.parts.append("\n")
            if re.fullmatch("h[1-6]", tag):
                self.parts.append("#" * int(tag[1]) + " ")

    def handle_endtag(self, tag):
        if tag in self.skipped and self.deep:
            self.deep -= 1
        elif tag in self.breaks:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.deep:
            self.parts.append(re.sub(r"\s+", " ", data))


def page_text(page: str) -> str:
    """The text of a page without navigation, scripts and styles, with ``#`` before headings."""
    parser = _Text()
    parser.feed(page)
    parser.close()
    lines = (re.sub(r" +", " ", line).strip() for line in "".join(parser.parts).split("\n"))
    return "\n".join(line for line in lines if line)


def html_text(docs: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """``(id_col, text)``; null pages give no row."""
    key = dict(docs.dtypes)[id_col]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({id_col: frame[id_col], "text": [page_text(x) for x in frame[html_col]]})

    return docs.select(id_col, html_col).where(f"`{html_col}` is not null").mapInPandas(read, f"`{id_col}` {key}, text string")


def read_documents(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """``(source, content)`` of text, Markdown and HTML files; blank ones fall away.

    A Markdown or HTML file of fewer than ten words is an error, as is a suffix that needs a converter which isn't installed.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, data in zip(frame["path"], frame["content"], strict=True):
                suffix = Path(path).suffix.lower()
                if suffix in RICH and suffix not in READABLE:
                    raise ValueError(f"{path}: no converter for {suffix} is installed")
                text = bytes(data).decode("utf-8", "replace")
                if suffix in (".html", ".htm"):
                    text = page_text(text)
                if suffix in READABLE and text.strip() and len(text.split()) < MIN_WORDS:
                    raise ValueError(f"{path}: fewer than {MIN_WORDS} words")
                rows.append((path, text))
            yield pd.DataFrame(rows, columns=["source", "content"])

    return files.mapInPandas(parse, "source string, content string").where(F.trim("content") != "")


def read_category_map(spark: SparkSession, path: str, categories: tuple[str, ...]) -> DataFrame:
    """``(risk_id, category, taxonomy)`` of a mapping TSV: comments and short rows fall away, strong predicates and wanted targets stay."""
    names = "subject_id string, subject_source string, predicate_id string, object_id string, object_source string, mapping_justification string"
    rows = spark.read.schema(names).csv(path, sep="\t", comment="#", header=True)
    strong = F.col("predicate_id").isin("skos:exactMatch", "skos:closeMatch", "skos:broadMatch")
    kept = rows.where(strong & F.col("object_source").isin(*categories))
    return kept.select(F.col("subject_id").alias("risk_id"), F.col("object_id").alias("category"), F.col("object_source").alias("taxonomy")).distinct()


def load_yaml(path: str):
    """A small YAML file; an absent one is an empty mapping."""
    import yaml

    file = Path(path)
    return (yaml.safe_load(file.read_text()) or {}) if file.exists() else {}


def ground_truth(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(policy, risk_id)`` of ground-truth files in either layout: ``risks`` with ids, or ``risk_ids``."""
    rows = []
    for path in paths:
        data = load_yaml(path)
        ids = [r["id"] for r in data.get("risks", [])] or data.get("risk_ids", [])
        rows += [(Path(path).stem, str(i).split(" ")[0].strip()) for i in ids]
    return spark.createDataFrame(rows, "policy string, risk_id string").distinct()


def action_links(spark: SparkSession, path: str) -> DataFrame:
    """``(risk_id, action_id, name, source)`` of an index of actions by risk."""
    data = load_yaml(path)
    rows = [(risk, a.get("id"), a.get("name"), a.get("source")) for risk, actions in (data.get("risks") or data).items() if isinstance(actions, list) for a in actions]
    return spark.createDataFrame(rows, "risk_id string, action_id string, name string, source string")


def threats(spark: SparkSession, path: str, fields: tuple[str, ...] = ("threat", "threat_source", "vulnerability")) -> DataFrame:
    """``(risk_id, fields...)`` of a mapping from risks to texts."""
    rows = [(risk, *(values.get(f) for f in fields)) for risk, values in load_yaml(path).items()]
    return spark.createDataFrame(rows, ", ".join(["risk_id string", *(f"{f} string" for f in fields)]))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result files, JSON or YAML, as one nested row each."""
    if path.endswith((".yaml", ".yml")):
        return spark.read.json(spark.sparkContext.parallelize([json.dumps(load_yaml(path))]))
    return spark.read.json(path, multiLine=True)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Labelled pairs, one JSON object a line."""
    return spark.read.schema("sentence1 string, sentence2 string, label int, metadata map<string,string>").json(path)


def resolve_runs(entries: list[str]) -> dict[str, list[str]]:
    """Runs of a battery: a file is a run, a folder one run of all its documents in order; hidden files are skipped."""
    runs = {}
    for entry in entries:
        path = Path(entry)
        if path.is_dir():
            runs[path.name] = [str(p) for p in sorted(path.iterdir()) if p.suffix.lower() in (*RICH, ".txt") and not p.name.startswith(".")]
        else:
            runs[path.stem] = [str(path)]
    return runs


def parse_remote(url: str) -> tuple[str, str]:
    """Base address ending in ``/v1`` and model name of a model's address."""
    from urllib.parse import urlparse

    parts = urlparse(url)
    path = re.sub(r"/(embeddings|score|rerank)$", "", parts.path.rstrip("/"))
    base = path if path.endswith("/v1") else path.rstrip("/") + "/v1"
    host = parts.hostname or ""
    return f"{parts.scheme}://{parts.netloc}{base}", host.split("-model-serving")[0] if "-model-serving" in host else host.split(".")[0]


def escape(text: str) -> str:
    return html.escape(text)
