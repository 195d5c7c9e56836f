"""The input tables as the engine reads them, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import finite
from ..functions.text import bare_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per chunk: second deliveries are the same chunk; the last delivery's row stays."""
    rows = table(spark, sf_dir, "chunks")
    last = F.max(F.struct("ingested_at", "source", "chunk_index", "section", "page", "text")).alias("r")
    return rows.groupBy("chunk_id").agg(last).select("chunk_id", "r.source", "r.chunk_index", "r.section", "r.page", "r.text")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per candidate: that of the latest scoring, then delivery; ids without what follows a blank."""
    rows = table(spark, sf_dir, "candidates")
    payload = ["scored_at", "ingested_at", "source", "chunk_index", "risk_id", "risk_name", "risk_description", "bm25_rank", "embedding_distance", "cross_encoder_score", "rrf_score", "decision"]
    stands = rows.groupBy("candidate_id").agg(F.max(F.struct(*payload)).alias("r"))
    return stands.select("candidate_id", "r.*").withColumn("risk_id", bare_id(F.col("risk_id")))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One verdict per candidate: the last."""
    rows = table(spark, sf_dir, "judge_verdicts")
    last = rows.groupBy("candidate_id").agg(F.max(F.struct("judged_at", "relevant", "justification", "risk_id")).alias("r"))
    return last.select("candidate_id", "r.relevant", "r.justification", bare_id(F.col("r.risk_id")).alias("risk_id"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with a verdict and a finite score: ``label`` 1 if relevant, ``score`` of the cross-encoder."""
    marked = verdicts(spark, sf_dir).where("relevant is not null").select("candidate_id", F.col("relevant").cast("int").alias("label"), "justification")
    return candidates(spark, sf_dir).join(marked, "candidate_id").withColumn("score", finite(F.col("cross_encoder_score"))).where("score is not null")


CHUNKS = """
chunk AS (
  SELECT chunk_id, source, chunk_index, section, page, text FROM (
    SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC, source DESC) AS v FROM chunks) WHERE v = 1)"""
CANDIDATES = """
cand AS (
  SELECT candidate_id, source, chunk_index, trim(split_part(risk_id, ' ', 1)) AS risk_id, risk_name, risk_description, bm25_rank,
    embedding_distance, cross_encoder_score, rrf_score, decision,
    CASE WHEN isfinite(cross_encoder_score) THEN cross_encoder_score END AS ce,
    CASE WHEN isfinite(embedding_distance) THEN embedding_distance END AS dist,
    CASE WHEN isfinite(rrf_score) THEN rrf_score END AS fused
  FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY scored_at DESC, ingested_at DESC) AS v FROM candidates) WHERE v = 1)"""
VERDICTS = """
verdict AS (
  SELECT candidate_id, relevant, justification, trim(split_part(risk_id, ' ', 1)) AS risk_id FROM (
    SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY judged_at DESC, relevant DESC NULLS LAST) AS v FROM judge_verdicts) WHERE v = 1)"""
JUDGED = (
    CANDIDATES
    + ","
    + VERDICTS
    + """,
judged AS (
  SELECT cand.*, CAST(verdict.relevant AS INT) AS label, verdict.justification, ce AS score
  FROM cand JOIN verdict USING (candidate_id) WHERE verdict.relevant IS NOT NULL AND ce IS NOT NULL)"""
)
#: Characters that Python's ``str.split`` splits at.
BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def tokens_sql(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '{BLANK}+'), lambda w: w <> '')"


def sentences_sql(text: str) -> str:
    return f"list_filter(regexp_extract_all({text}, '[^.!?。！？]+[.!?。！？]*'), lambda s: trim(s, ' ') <> '')"
