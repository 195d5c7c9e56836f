"""Models behind one interface, run batch by batch in the executors.

A provider reads rows ``(key, payload)`` and gives ``(key, answer)``; payload and answer are JSON. Errors of a
row don't fail the task: they come out as rows with ``error``. Results are written before they are read twice,
so that no call is made again when Spark computes something anew.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CALL_SCHEMA = "key string, stage string, answer string, error string, incidents string, prompt_tokens bigint, completion_tokens bigint, duration_ms double"


class Provider(Protocol):
    """A model: gives the answer to a payload, as a value that JSON can hold."""

    def __call__(self, stage: str, payload: dict) -> object: ...


class Truncated(Exception):
    """The answer was cut off at the output limit."""


_registered: dict[str, Callable[[], Provider]] = {}


def register(name: str, maker: Callable[[], Provider]) -> None:
    """Make a provider known by name; it is made once per worker."""
    _registered[name] = maker


class Lexical:
    """A deterministic stand-in without a model: an entry is relevant if enough of its words stand in the text."""

    def __init__(self, share: float = 0.6):
        self.share = share

    def _words(self, text: str) -> set[str]:
        return set((text or "").lower().split())

    def __call__(self, stage: str, payload: dict) -> object:
        text = payload.get("text") or ""
        if stage == "queries":
            return [s.strip() for s in re.findall(r"[^.!?]+[.!?]*", text)[:3] if s.strip()]
        if stage == "causal":
            risk = (payload.get("risks") or [{}])[0]
            return [{"threat": risk.get("risk_name", ""), "threat_source": "", "vulnerability": "", "consequence": risk.get("risk_description", ""), "impact": ""}]
        have, out = self._words(text), []
        for risk in payload.get("risks", []):
            need = self._words(risk.get("risk_name", ""))
            share = len(need & have) / len(need) if need else 0.0
            near = [s.strip() for s in re.findall(r"[^.!?]+[.!?]*", text) if need & self._words(s)]
            out.append(
                {"risk_id": risk["risk_id"], "relevant": share >= self.share, "grounded": share >= self.share, "quotes": near[:1], "confidence": "high" if share == 1 else "medium"}
            )
        return out


register("lexical", Lexical)


def call_once(provider: Provider, stage: str, payload: dict, retries: int = 3, shorten: float = 0.6, least: int = 500) -> tuple[object, list[str]]:
    """An answer with its incidents: a cut-off answer is asked for with a shorter text, other errors up to ``retries`` times."""
    incidents: list[str] = []
    tries = 0
    while True:
        try:
            return provider(stage, payload), incidents
        except Truncated:
            text = payload.get("text") or ""
            if len(text) <= least or sum(i == "output_truncated" for i in incidents) >= 3:
                raise
            incidents.append("output_truncated")
            payload = payload | {"text": text[: max(int(len(text) * shorten), least)]}
        except Exception as error:
            tries += 1
            if tries > retries:
                raise
            incidents.append("validation_retry")
            payload = payload | {"hint": f"Validation error: {error}"}


def call_model(rows: DataFrame, stage: str, provider: str = "lexical", retries: int = 3) -> DataFrame:
    """The calls of a stage over ``(key, payload)``: answers, errors, incidents, estimated tokens and times.

    Not deterministic with a real model: write the result before using it twice.
    """
    maker = _registered[provider]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = maker()
        for frame in frames:
            out = []
            for key, payload in zip(frame["key"], frame["payload"], strict=True):
                began, incidents = time.time(), []
                answer = error = None
                try:
                    value, incidents = call_once(model, stage, json.loads(payload), retries)
                    answer = json.dumps(value, ensure_ascii=False)
                except Exception as problem:
                    error = f"{type(problem).__name__}: {problem}"
                out.append((key, stage, answer, error, ",".join(incidents), len(payload) // 3, len(answer or "") // 3, (time.time() - began) * 1000))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CALL_SCHEMA.split(", ")])

    return rows.select("key", "payload").mapInPandas(run, CALL_SCHEMA)


def verdicts(calls: DataFrame) -> DataFrame:
    """``(key, risk_id, relevant, grounded, quotes, confidence)`` of the answers of judge and grounding calls."""
    schema = "array<struct<risk_id:string,relevant:boolean,grounded:boolean,quotes:array<string>,confidence:string>>"
    return calls.where("answer is not null").select("key", F.explode(F.from_json("answer", schema)).alias("v")).select("key", "v.*")


def usage(calls: DataFrame) -> DataFrame:
    """Calls, errors, incidents and tokens of each stage."""
    return calls.groupBy("stage").agg(
        F.count("*").alias("calls"), F.count("error").alias("errors"), F.sum(F.size(F.filter(F.split("incidents", ","), lambda i: i != ""))).alias("incidents"),
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
    )


def causal_chain(fields: DataFrame, names: tuple[str, ...] = ("threat", "threat_source", "vulnerability", "consequence", "impact")) -> DataFrame:
    """Blank fields of a causal chain as null; a chain of only blanks falls away."""
    cleaned = fields.withColumns({n: F.nullif(F.trim(n), F.lit("")) for n in names})
    return cleaned.where(F.coalesce(*names).isNotNull())
