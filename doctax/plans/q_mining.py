"""Queries on late interaction, search over whole documents, and training examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import evaluate, mining
from ..operators import retrieval as R
from . import tables as t
from .q_eval import THRESHOLD, _policy
from .q_search import _UNIT, GROUP, _corpus, _vectors
from .q_search import SQL as _SEARCH


def late_topk(spark, d):
    texts = _vectors(spark, d).groupBy(F.col("label").cast("bigint").alias("id")).agg(F.collect_list("v").alias("tokens"))
    return R.late_interaction(texts, texts, 3).select("query_id", "id", "score", "place")


def hybrid_late(spark, d):
    """The cross-encoder's score stands for that of late interaction, of which each chunk keeps twice the top."""
    rows = t.candidates(spark, d).withColumn("score", S.finite(F.col("cross_encoder_score")))
    late = R.best(rows.where("score > 0"), GROUP, "score", "candidate_id", 20)
    return R.hybrid_late(rows.where("bm25_rank <= 100"), late, GROUP, "candidate_id", 10, 5).select("candidate_id", "rrf", "cross_encoder_score", "rescued")


def _truth(spark, d):
    return t.judged(spark, d).where("label = 1").withColumn("policy", _policy()).select("policy", "risk_id").distinct()


def corpus_search(spark, d):
    """Every chunk searched, its entries put together by document: the recall of those that were found relevant there."""
    chunks = t.chunks(spark, d).where("text is not null")
    found = R.bm25(_corpus(spark, d), chunks.select(F.col("chunk_id").alias("query_id"), "text"), 10)
    found = found.join(chunks.select(F.col("chunk_id").alias("query_id"), "source"), "query_id").select("source", F.col("id").alias("risk_id")).distinct()
    expected = t.judged(spark, d).where("label = 1").select("source", "risk_id").distinct()
    return evaluate.retrieval_recall(expected, found.join(expected.select("source").distinct(), "source", "left_semi"), "source", "risk_id")


def easy_negatives(spark, d):
    pool = t.candidates(spark, d).where("decision = 'discarded'").withColumn("policy", _policy())
    return mining.easy_negatives(_truth(spark, d), pool, t.table(spark, d, "catalogue").select(F.col("id").alias("risk_id")), ["policy"], "risk_id", 2)


def judge_examples(spark, d):
    """Of the calls to the judge the examples: the candidate, the length of its text, and whether its risk is in the truth of the policy."""
    calls = t.candidates(spark, d).where("decision in ('borderline', 'borderline_judged')").select("candidate_id", "source", "chunk_index", "risk_id").withColumn("policy", _policy())
    texts = t.chunks(spark, d).select("source", "chunk_index", "text")
    return mining.judge_examples(calls, texts, _truth(spark, d), ["policy"], "risk_id").select("candidate_id", F.length("text").alias("chars"), "label")


def threshold_examples(spark, d):
    rows = t.candidates(spark, d).where("decision in ('accepted', 'borderline_judged')").withColumn("policy", _policy()).withColumn("score", S.finite(F.col("cross_encoder_score")))
    found = mining.threshold_examples(rows, _truth(spark, d), ["source"], "chunk_index", ["policy"], "risk_id", "score")
    return found.select("source", "chunk_index", "risk_id", "place", "label")


def grounding_negatives(spark, d):
    """For chunks with relevant risks: negatives of other chunks of the document, then discarded ones of the chunk, then any entry."""
    judged = t.judged(spark, d).select(*GROUP, "risk_id", "label")
    positives = judged.where("label = 1").select(*GROUP, "risk_id").distinct()
    groups = positives.select(*GROUP).distinct()
    other = judged.where("label = 0").select("source", F.col("chunk_index").alias("__c"), "risk_id")
    near = groups.join(other, "source").where("chunk_index <> __c").select(*GROUP, "risk_id")
    own = t.candidates(spark, d).where("decision = 'discarded'").select(*GROUP, "risk_id").join(groups, GROUP, "left_semi")
    entries = F.broadcast(t.table(spark, d, "catalogue").select(F.col("id").alias("risk_id")))  # a catalogue doesn't grow
    return mining.grounding_negatives(positives, [near, own, groups.crossJoin(entries)], GROUP, "risk_id")


def extraction_f1(spark, d):
    judged = t.judged(spark, d).withColumn("policy", _policy()).where("risk_name is not null")
    names = judged.where("label = 1").select("policy", F.lit("expected").alias("side"), F.col("risk_name").alias("name")).distinct()
    names = names.unionByName(judged.where(F.col("score") >= THRESHOLD).select("policy", F.lit("predicted").alias("side"), F.col("risk_name").alias("name")).distinct())
    return evaluate.extraction_f1(names, evaluate.match_names(names, "policy"), "policy")


QUERIES = {f.__name__: f for f in (late_topk, hybrid_late, corpus_search, easy_negatives, judge_examples, threshold_examples, grounding_negatives, extraction_f1)}

_TRUTH = "truth AS (SELECT DISTINCT split_part(source, '/', 1) AS policy, risk_id FROM judged WHERE label = 1)"
_MD5 = "md5('0|' || source || '|' || chunk_index || '|' || risk_id)"
SQL = {
    "late_topk": f"""
WITH {_UNIT},
top AS (SELECT a.label AS q, b.label AS t, a.id, max(list_cosine_similarity(a.v, b.v)) AS m FROM vec a, vec b GROUP BY a.label, b.label, a.id),
s AS (SELECT q, t, round(sum(m) / count(*), 5) AS score FROM top GROUP BY q, t)
SELECT CAST(q AS BIGINT) AS query_id, CAST(t AS BIGINT) AS id, score, place FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, t) AS place FROM s WHERE score > 0) WHERE place <= 3""",
    "hybrid_late": f"""
WITH {t.CANDIDATES},
late AS (SELECT * FROM (SELECT source, chunk_index, candidate_id, ce, row_number() OVER (PARTITION BY source, chunk_index ORDER BY ce DESC, candidate_id) AS r FROM cand WHERE ce > 0) WHERE r <= 20),
lex AS (SELECT source, chunk_index, candidate_id, bm25_rank FROM cand WHERE bm25_rank > 0 AND bm25_rank <= 100),
fuse AS (
  SELECT coalesce(lex.candidate_id, late.candidate_id) AS candidate_id, coalesce(lex.source, late.source) AS source, coalesce(lex.chunk_index, late.chunk_index) AS chunk_index, bm25_rank, ce,
    round(coalesce(1.0::DOUBLE / (60 + bm25_rank), 0.0) + coalesce(1.0::DOUBLE / (60 + r), 0.0), 6) AS rrf FROM lex FULL JOIN late ON lex.candidate_id = late.candidate_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY source, chunk_index ORDER BY rrf DESC, candidate_id) AS place FROM fuse)
SELECT candidate_id, rrf, coalesce(ce, 0.0) AS cross_encoder_score, place > 10 AS rescued FROM placed WHERE place <= 10 OR bm25_rank <= 5""",
    "corpus_search": f"""
WITH found AS ({_SEARCH["bm25_topk"]}), {t.JUDGED}, {t.CHUNKS},
e AS (SELECT DISTINCT source, risk_id FROM judged WHERE label = 1),
g AS (SELECT DISTINCT source, id AS risk_id FROM found JOIN chunk ON chunk_id = query_id)
SELECT e.source, round(count(g.risk_id)::DOUBLE / count(*), 6) AS recall FROM e LEFT JOIN g ON g.source = e.source AND g.risk_id = e.risk_id GROUP BY e.source""",
    "easy_negatives": f"""
WITH {t.JUDGED}, {_TRUTH}, pool AS (SELECT DISTINCT split_part(source, '/', 1) AS policy, risk_id FROM cand WHERE decision = 'discarded'),
rest AS (SELECT policy, id AS risk_id FROM (SELECT DISTINCT policy FROM truth), (SELECT DISTINCT id FROM catalogue)),
r AS (
  SELECT *, row_number() OVER (PARTITION BY policy ORDER BY md5('0|' || policy || '|' || risk_id), risk_id) AS n
  FROM rest ANTI JOIN pool USING (policy, risk_id) ANTI JOIN truth USING (policy, risk_id))
SELECT r.policy, r.risk_id FROM r JOIN (SELECT policy, 2 * count(*) AS w FROM truth GROUP BY policy) USING (policy) WHERE n <= w""",
    "judge_examples": f"""
WITH {t.JUDGED}, {t.CHUNKS}, {_TRUTH}
SELECT candidate_id, length(text) AS chars, CAST((split_part(cand.source, '/', 1), risk_id) IN (SELECT (policy, risk_id) FROM truth) AS INT) AS label
FROM cand JOIN (SELECT source, chunk_index, text FROM chunk) USING (source, chunk_index) WHERE decision IN ('borderline', 'borderline_judged') AND length(text) >= 50""",
    "threshold_examples": f"""
WITH {t.JUDGED}, {_TRUTH},
a AS (SELECT source, chunk_index, risk_id, max(ce) AS ce FROM cand WHERE decision IN ('accepted', 'borderline_judged') GROUP BY ALL),
f AS (SELECT * FROM (SELECT *, min(chunk_index) OVER (PARTITION BY source, risk_id) AS c FROM a) WHERE chunk_index = c),
p AS (SELECT *, row_number() OVER (PARTITION BY source, chunk_index ORDER BY ce DESC NULLS LAST, risk_id) AS place FROM f),
l AS (SELECT source, chunk_index, risk_id, place, CAST((split_part(source, '/', 1), risk_id) IN (SELECT (policy, risk_id) FROM truth) AS INT) AS label FROM p WHERE place <= 10)
SELECT * FROM l WHERE (source, chunk_index) IN (SELECT (source, chunk_index) FROM l WHERE label = 1)""",
    "grounding_negatives": f"""
WITH {t.JUDGED}, pos AS (SELECT DISTINCT source, chunk_index, risk_id FROM judged WHERE label = 1), grp AS (SELECT source, chunk_index, count(*) AS n FROM pos GROUP BY ALL),
pool AS (
  SELECT grp.source, grp.chunk_index, j.risk_id, 1 AS pool FROM grp JOIN judged j ON j.source = grp.source AND j.chunk_index <> grp.chunk_index AND j.label = 0
  UNION ALL SELECT cand.source, cand.chunk_index, risk_id, 2 FROM cand JOIN grp USING (source, chunk_index) WHERE decision = 'discarded'
  UNION ALL SELECT grp.source, grp.chunk_index, id, 3 FROM grp, catalogue),
best AS (SELECT source, chunk_index, risk_id, min(pool) AS pool FROM pool ANTI JOIN pos USING (source, chunk_index, risk_id) GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY source, chunk_index ORDER BY pool, {_MD5}, risk_id) AS k FROM best)
SELECT source, chunk_index, risk_id, pool FROM placed JOIN grp USING (source, chunk_index) WHERE k <= greatest(least(5, 12 - n), 0)""",
}
