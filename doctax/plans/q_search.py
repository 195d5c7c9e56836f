"""Queries on retrieval and decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import catalog as cat
from ..operators import enrich
from ..operators import retrieval as R
from ..operators import select as sel
from . import tables as t

GROUP = ["source", "chunk_index"]


def _corpus(spark, d):
    return R.corpus_of(cat.collapse_variants(t.table(spark, d, "catalogue")))


def bm25_postings(spark, d):
    return R.postings(_corpus(spark, d)).select("id", "term", "tf")


def idf_table(spark, d):
    return R.idf(_corpus(spark, d)).select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark, d):
    asked = t.chunks(spark, d).where("text is not null").select(F.col("chunk_id").alias("query_id"), "text")
    return R.bm25(_corpus(spark, d), asked, 10).select("query_id", "id", "score", "place")


def _vectors(spark, d):
    return t.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def dense_topk(spark, d):
    rows = _vectors(spark, d)
    found = R.dense(rows.select("id", "v"), rows.where("id % 100 = 0").select("id", "v"), 10)
    return found.select("query_id", "id", F.round(1 - F.col("similarity"), 6).alias("distance"), "place")


def vector_norms(spark, d):
    norm = F.sqrt(F.aggregate(F.transform("v", lambda x: x.cast("double")), F.lit(0.0), lambda n, x: n + x * x))
    return _vectors(spark, d).select("id", F.round(norm, 5).alias("norm"))


def maxsim_late_interaction(spark, d):
    texts = _vectors(spark, d).groupBy(F.col("label").cast("bigint").alias("id")).agg(F.collect_list("v").alias("tokens"))
    return R.maxsim(texts, texts).select("query_id", "id", F.round("score", 5).alias("score"))


def group_nn(spark, d):
    rows = _vectors(spark, d).select("id", F.col("label").alias("group"), R.unit(F.col("v")).alias("u"))
    asked = rows.where("id % 100 = 0")
    allowed = rows.select("group").distinct().select("group", ((F.col("group") + 1) % 10).cast("int").alias("target_group"))
    inside = asked.join(allowed, "group").join(rows.select(F.col("id").alias("target"), F.col("group").alias("target_group"), F.col("u").alias("w")), "target_group")
    pairs = inside.select("id", "group", "target", "target_group", F.round(R.dot(F.col("u"), F.col("w")), 6).alias("similarity"))
    return enrich.nearest_in_group(pairs, allowed).select("id", "target", F.round("similarity", 5).alias("similarity"), sel.predicate_of(F.col("similarity")).alias("predicate"))


def rrf_fuse(spark, d):
    return R.rrf_fuse(t.candidates(spark, d), GROUP, "candidate_id").select("candidate_id", "lexical_rank", "dense_rank", "rrf")


def rrf_floor(spark, d):
    return R.rrf_fuse(t.candidates(spark, d), GROUP, "candidate_id").where("rrf >= 0.015").select("candidate_id", "rrf")


def hybrid_search(spark, d):
    return R.hybrid(t.candidates(spark, d), GROUP, "candidate_id").select("source", "chunk_index", "candidate_id", "rrf", "place")


def rescue_merge(spark, d):
    return R.rescue(t.candidates(spark, d), GROUP, "candidate_id").select("candidate_id", "rrf", "rescued")


def score_normalise(spark, d):
    score = S.finite(F.col("cross_encoder_score"))
    rows = t.candidates(spark, d).where(score.isNotNull())
    pair = F.array(F.lit(0.0), score)
    return rows.select("candidate_id", F.round(S.sigmoid(score), 6).alias("sigmoid"), F.round(S.clipped(score), 6).alias("clipped"), F.round(S.last_softmax(pair), 6).alias("softmax"), F.round(S.yes_probability(score, F.lit(None).cast("double")), 6).alias("yes"))


def classify_threshold(spark, d):
    return t.candidates(spark, d).select("candidate_id", sel.by_threshold(0.7, 0.15, 10).alias("class"))


def classify_rank(spark, d):
    return sel.by_rank(t.candidates(spark, d), GROUP, "candidate_id", 5, 5, 0.15, 10).select("candidate_id", "class")


def accepted_by(spark, d):
    rows = t.candidates(spark, d).where("decision in ('accepted', 'borderline_judged')")
    return rows.select("candidate_id", sel.accepted_by().alias("accepted_by"), sel.confidence().alias("confidence"))


def retrieval_stats(spark, d):
    rows = t.candidates(spark, d)
    return rows.groupBy(F.split_part("source", F.lit("/"), F.lit(1)).alias("folder")).agg(
        F.countDistinct("source", "chunk_index").alias("chunks"), F.count("*").alias("candidates"), F.count_if(F.col("decision") == "accepted").alias("auto_accepted"),
        F.count_if(F.col("decision") == "borderline_judged").alias("judged"), F.count_if(F.col("bm25_rank") > 0).alias("lexical"),
    )


def in_degree(spark, d):
    return enrich.in_degree(cat.mapping_links(t.table(spark, d, "catalogue")), 20)


def uncovered_chunks(spark, d):
    """Chunks without any candidate: those of the fallback."""
    seen = t.candidates(spark, d).select("source", "chunk_index").distinct()
    return t.chunks(spark, d).join(seen, ["source", "chunk_index"], "left_anti").select("chunk_id")


def query_union(spark, d):
    """Candidates of a chunk from several queries: for each risk the row of its first query."""
    w = Window.partitionBy("source", "chunk_index", "risk_id").orderBy(F.asc_nulls_last("query_no"), F.asc("candidate_id"))
    rows = t.candidates(spark, d).join(t.table(spark, d, "candidates").groupBy("candidate_id").agg(F.min("query_no").alias("query_no")), "candidate_id")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").select("source", "chunk_index", "risk_id", "candidate_id")


QUERIES = {f.__name__: f for f in (
    bm25_postings, idf_table, bm25_topk, dense_topk, vector_norms, maxsim_late_interaction, group_nn, rrf_fuse, rrf_floor, hybrid_search, rescue_merge,
    score_normalise, classify_threshold, classify_rank, accepted_by, retrieval_stats, in_degree, uncovered_chunks, query_union,
)}

from .q_text import SQL as _TEXT  # noqa: E402
from .q_text import _LINKS  # noqa: E402

_CORPUS = f"""
entry AS ({_TEXT['variant_collapse']}),
corpus AS (SELECT id, {t.tokens_sql("name || ': ' || description")} AS w FROM entry),
post AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM corpus) GROUP BY id, term),
size AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM corpus),
raw AS (SELECT term, count(*) AS df, ln(max(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, size GROUP BY term),
weight AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""
_UNIT = """
vec AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL)"""
_FUSED = f"""{t.CANDIDATES},
near AS (SELECT candidate_id, row_number() OVER (PARTITION BY source, chunk_index ORDER BY dist, candidate_id) AS dense_rank FROM cand WHERE dist IS NOT NULL),
listed AS (
  SELECT cand.*, CASE WHEN bm25_rank > 0 AND bm25_rank <= 100 THEN CAST(bm25_rank AS BIGINT) END AS lexical_rank, near.dense_rank
  FROM cand LEFT JOIN near ON near.candidate_id = cand.candidate_id AND near.dense_rank <= 100),
fuse AS (
  SELECT *, round(coalesce(1.0::DOUBLE / (60 + lexical_rank), 0.0) + coalesce(1.0::DOUBLE / (60 + dense_rank), 0.0), 6) AS rrf
  FROM listed WHERE lexical_rank IS NOT NULL OR dense_rank IS NOT NULL),
first_rows AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, chunk_index ORDER BY rrf DESC, candidate_id) AS fused_place FROM fuse) WHERE fused_place <= 20),
kept AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, chunk_index ORDER BY ce DESC NULLS LAST, candidate_id) AS place FROM first_rows) WHERE place <= 10 AND ce IS NOT NULL)"""
_RESCUED = "bm25_rank > 0 AND bm25_rank <= 10"
SQL = {
    "bm25_postings": f"WITH {_CORPUS} SELECT id, term, tf FROM post",
    "idf_table": f"WITH {_CORPUS} SELECT term, df, round(idf, 6) AS idf FROM weight",
    "bm25_topk": f"""
WITH {t.CHUNKS}, {_CORPUS},
ask AS (SELECT query_id, term, count(*) AS n FROM (SELECT chunk_id AS query_id, unnest({t.tokens_sql('text')}) AS term FROM chunk WHERE text IS NOT NULL) GROUP BY ALL),
hit AS (
  SELECT query_id, id, round(sum(ask.n * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
  FROM ask JOIN post USING (term) JOIN weight USING (term), size GROUP BY query_id, id)
SELECT query_id, id, score, place FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM hit WHERE score > 0) WHERE place <= 10""",
    "dense_topk": f"""
WITH {_UNIT},
pair AS (SELECT a.id AS query_id, b.id, round(list_cosine_similarity(a.v, b.v), 6) AS s FROM vec a, vec b WHERE a.id % 100 = 0)
SELECT query_id, id, round(1 - s, 6) AS distance, place FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS place FROM pair) WHERE place <= 10""",
    "vector_norms": f"WITH {_UNIT} SELECT id, round(sqrt(list_dot_product(v, v)), 5) AS norm FROM vec",
    "maxsim_late_interaction": f"""
WITH {_UNIT},
best AS (SELECT a.label AS q, b.label AS t, a.id, max(list_cosine_similarity(a.v, b.v)) AS m FROM vec a, vec b GROUP BY a.label, b.label, a.id)
SELECT CAST(q AS BIGINT) AS query_id, CAST(t AS BIGINT) AS id, round(sum(m) / count(*), 5) AS score FROM best GROUP BY q, t""",
    "group_nn": f"""
WITH {_UNIT},
pair AS (SELECT a.id, b.id AS target, round(list_cosine_similarity(a.v, b.v), 6) AS s FROM vec a JOIN vec b ON b.label = (a.label + 1) % 10 WHERE a.id % 100 = 0)
SELECT id, target, round(s, 5) AS similarity, CASE WHEN s >= 0.5 THEN 'close' WHEN s >= 0.3 THEN 'related' ELSE 'broad' END AS predicate
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, target) AS n FROM pair) WHERE n = 1""",
    "rrf_fuse": f"WITH {_FUSED} SELECT candidate_id, lexical_rank, dense_rank, rrf FROM fuse",
    "rrf_floor": f"WITH {_FUSED} SELECT candidate_id, rrf FROM fuse WHERE rrf >= 0.015",
    "hybrid_search": f"WITH {_FUSED} SELECT source, chunk_index, candidate_id, rrf, place FROM kept",
    "rescue_merge": f"""
WITH {_FUSED} SELECT candidate_id, rrf, false AS rescued FROM kept
UNION ALL SELECT candidate_id, rrf, true FROM first_rows WHERE lexical_rank <= 5 AND candidate_id NOT IN (SELECT candidate_id FROM kept)""",
    "score_normalise": f"""
WITH {t.CANDIDATES}
SELECT candidate_id, round(1 / (1 + exp(-ce)), 6) AS sigmoid, round(least(greatest(ce, 0.0), 1.0), 6) AS clipped,
  round(exp(ce - greatest(ce, 0.0)) / (exp(ce - greatest(ce, 0.0)) + exp(0.0 - greatest(ce, 0.0))), 6) AS softmax,
  round(exp(ce) / (exp(ce) + exp(-10.0)), 6) AS yes FROM cand WHERE ce IS NOT NULL""",
    "classify_threshold": f"""
WITH {t.CANDIDATES}
SELECT candidate_id, CASE WHEN ce >= 0.7 THEN 'accepted' WHEN ce >= 0.15 THEN 'borderline' WHEN {_RESCUED} THEN 'borderline' ELSE 'discarded' END AS class FROM cand""",
    "classify_rank": f"""
WITH {t.CANDIDATES},
placed AS (SELECT *, row_number() OVER (PARTITION BY source, chunk_index ORDER BY ce DESC NULLS LAST, candidate_id) AS place FROM cand)
SELECT candidate_id, CASE WHEN ce < 0.15 OR ce IS NULL THEN (CASE WHEN {_RESCUED} THEN 'borderline' ELSE 'discarded' END)
  WHEN place <= 5 THEN 'accepted' WHEN place <= 10 THEN 'borderline' WHEN {_RESCUED} THEN 'borderline' ELSE 'discarded' END AS class FROM placed""",
    "accepted_by": f"""
WITH {t.CANDIDATES}
SELECT candidate_id, CASE WHEN decision = 'borderline_judged' THEN 'llm_judge' ELSE 'threshold' END AS accepted_by,
  coalesce(ce, fused, 0.0) AS confidence FROM cand WHERE decision IN ('accepted', 'borderline_judged')""",
    "retrieval_stats": f"""
WITH {t.CANDIDATES}
SELECT split_part(source, '/', 1) AS folder, count(DISTINCT (source, chunk_index)) AS chunks, count(*) AS candidates, count(*) FILTER (decision = 'accepted') AS auto_accepted,
  count(*) FILTER (decision = 'borderline_judged') AS judged, count(*) FILTER (bm25_rank > 0) AS lexical FROM cand GROUP BY 1""",
    "in_degree": f"WITH {_LINKS} SELECT target AS id, count(*) AS n FROM link GROUP BY target ORDER BY n DESC, id LIMIT 20",
    "uncovered_chunks": f"""
WITH {t.CHUNKS}, {t.CANDIDATES}
SELECT chunk_id FROM chunk WHERE NOT EXISTS (SELECT 1 FROM cand WHERE cand.source = chunk.source AND cand.chunk_index = chunk.chunk_index)""",
    "query_union": f"""
WITH {t.CANDIDATES}, q AS (SELECT candidate_id, min(query_no) AS query_no FROM candidates GROUP BY candidate_id)
SELECT source, chunk_index, risk_id, candidate_id FROM (
  SELECT *, row_number() OVER (PARTITION BY source, chunk_index, risk_id ORDER BY query_no NULLS LAST, candidate_id) AS n FROM cand JOIN q USING (candidate_id)) WHERE n = 1""",
}
