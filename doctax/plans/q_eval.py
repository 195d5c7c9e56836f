"""Queries on grounding, merging, expansion, enrichment, evaluation and mining."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions import scores as S
from ..functions import text as X
from ..operators import catalog as cat
from ..operators import enrich, evaluate, expand, ground, merge, mining
from ..operators import select as sel
from . import pipeline
from . import tables as t
from .q_text import CROSS, EDGES, HOME

THRESHOLD = 0.5


def _matches(spark, d):
    rows = t.candidates(spark, d).where("decision in ('accepted', 'borderline_judged')")
    return rows.withColumn("confidence", sel.confidence())


def _catalogue(spark, d):
    return t.table(spark, d, "catalogue")


def judge_semi(spark, d):
    rows = t.candidates(spark, d).where("decision in ('borderline', 'borderline_judged')")
    return ground.confirmed(rows, t.verdicts(spark, d), ["candidate_id"], "relevant").select("candidate_id", "risk_id")


def ground_filtered_anti(spark, d):
    judged = t.verdicts(spark, d)
    rows = t.candidates(spark, d).where("decision = 'accepted'").join(judged.select("candidate_id"), "candidate_id", "left_semi")
    return ground.rejected(rows, judged, ["candidate_id"], "relevant").select("candidate_id", "risk_id")


def ground_batches(spark, d):
    rows = t.candidates(spark, d).where("decision = 'borderline'")
    return ground.in_batches(rows, ["source", "chunk_index"], "candidate_id", 15).select("candidate_id", "batch")


def multi_pass_union(spark, d):
    """Passes are the deliveries of a candidate: the first one's decision stands."""
    rows = t.table(spark, d, "candidates").select("candidate_id", "ingested_at", "decision").groupBy("candidate_id", "ingested_at").agg(F.max("decision").alias("decision"))
    return merge.first_pass_wins(rows, ["candidate_id"], "ingested_at").select("candidate_id", "decision")


def variant_expand(spark, d):
    rows = t.candidates(spark, d).where("decision = 'accepted'").select("candidate_id", "risk_id")
    return ground.expand_variants(rows, cat.variants(_catalogue(spark, d)))


def variant_grounding(spark, d):
    bridge = cat.variants(_catalogue(spark, d))
    judged = t.verdicts(spark, d).groupBy("risk_id").agg(F.bool_or("relevant").alias("grounded"))
    parents = _matches(spark, d).select("risk_id").distinct()
    return ground.selective_variants(parents, bridge, judged)


def merge_best(spark, d):
    rows = _matches(spark, d).withColumn("origin", F.concat_ws("#", "source", F.col("chunk_index").cast("string")))
    return merge.merge_best(rows, ["risk_id"], "candidate_id", ["origin"])


def evidence_cap(spark, d):
    rows = _matches(spark, d).join(t.verdicts(spark, d).select("candidate_id", F.col("justification").alias("text")), "candidate_id")
    return merge.cap_evidence(rows.withColumn("score", S.finite(F.col("cross_encoder_score"))), ["risk_id"], "candidate_id", 3).select("risk_id", "candidate_id", "place")


def evidence_match(spark, d):
    rows = t.verdicts(spark, d).join(t.candidates(spark, d).select("candidate_id", "source", "chunk_index"), "candidate_id")
    joined = rows.join(t.chunks(spark, d).select("source", "chunk_index", "text"), ["source", "chunk_index"]).where("text is not null and justification is not null")
    exact = F.contains(X.normalised(F.col("text")), X.normalised(F.col("justification")))
    overlap = X.evidence_overlap(F.col("justification"), F.col("text"))
    return joined.select("candidate_id", exact.alias("is_exact"), F.round(overlap, 6).alias("overlap"), (exact | (overlap >= 0.6)).alias("matches"))


def quote_token_f1(spark, d):
    rows = t.verdicts(spark, d).join(t.candidates(spark, d).select("candidate_id", "risk_description"), "candidate_id").where("justification is not null and risk_description is not null")
    return rows.select("candidate_id", F.round(X.token_f1(F.col("justification"), F.col("risk_description")), 6).alias("f1"))


def content_overlap(spark, d):
    rows = t.verdicts(spark, d).join(t.candidates(spark, d).select("candidate_id", "risk_name"), "candidate_id").where("justification is not null and risk_name is not null")
    return rows.select("candidate_id", F.round(X.content_overlap(F.col("justification"), F.col("risk_name")), 6).alias("overlap"))


def _expanded(spark, d):
    catalogue = _catalogue(spark, d)
    found = t.verdicts(spark, d).where("relevant").select("risk_id")
    return expand.expand_siblings(found, cat.expansion_edges(catalogue), catalogue)


def expand_siblings(spark, d):
    return _expanded(spark, d)


def grounding_groups(spark, d):
    near = t.candidates(spark, d).join(t.chunks(spark, d).select("source", "chunk_index", "chunk_id"), ["source", "chunk_index"]).select("risk_id", "chunk_id").distinct()
    groups = expand.grounding_groups(_expanded(spark, d), near, _catalogue(spark, d).select("id", "ispartof"))
    return groups.select("parent", "batch", F.array_join("risk_ids", ",").alias("risk_ids"), F.array_join(F.transform("chunk_ids", lambda c: c.cast("string")), ",").alias("chunk_ids"))


def _actions(spark, d):
    return cat.mapping_links(_catalogue(spark, d)).where("predicate in ('broad', 'related')").select(F.col("id").alias("risk_id"), F.col("target").alias("action_id")).distinct()


def mitigation_fallback(spark, d):
    catalogue = _catalogue(spark, d)
    return enrich.actions_of(catalogue.select(F.col("id").alias("risk_id")), _actions(spark, d), cat.crosswalk(catalogue, HOME))


def threat_fallback(spark, d):
    catalogue = _catalogue(spark, d)
    values = catalogue.where("concern is not null").select(F.col("id").alias("risk_id"), F.col("concern").alias("value"))
    risks = catalogue.select(F.col("id").alias("risk_id"), F.lit(None).cast("string").alias("threat"))
    return enrich.filled(risks, values, cat.crosswalk(catalogue, HOME), "threat")


def mitigation_index(spark, d):
    rows = _catalogue(spark, d).select(F.col("id").alias("action_id"), F.col("isdefinedbytaxonomy").alias("source"), F.lit(1).cast("bigint").alias("pos"), F.coalesce("related_mappings", F.array().cast("array<string>")).alias("related"))
    explicit = _catalogue(spark, d).where("risk_type = 'agentic'").select(F.col("id").alias("action_id"), F.lit("technical").alias("category"))
    heads = spark.createDataFrame([("lantern", "lantern", "operational"), ("tessera", "tessera", "governance")], "source string, head string, category string")
    return enrich.action_index(rows, "tessera-", explicit, heads).select("risk_id", "action_id", "source", "category")


def action_descriptions(spark, d):
    rows = _catalogue(spark, d).select(F.col("id").alias("action_id"), F.explode(F.array(F.struct(F.lit(1).alias("source_order"), F.col("description").alias("description")), F.struct(F.lit(2).alias("source_order"), F.col("concern").alias("description")))).alias("s"))
    known = rows.select("action_id", "s.source_order", "s.description").where("description is not null")
    return enrich.described(_actions(spark, d).select("action_id").distinct(), known)


def _policy(col="source"):
    return F.split_part(F.col(col), F.lit("/"), F.lit(1))


def _sets(spark, d):
    judged = t.judged(spark, d).withColumn("policy", _policy())
    return evaluate.compared(judged.where("label = 1"), judged.where(F.col("score") >= THRESHOLD), ["policy", "risk_id"])


def prf_overall(spark, d):
    return evaluate.scored(_sets(spark, d).withColumn("scope", F.lit("all")), ["scope"])


def prf_by_policy(spark, d):
    rows = evaluate.scored(_sets(spark, d), ["policy"])
    return rows.withColumn("passed", evaluate.passed(F.col("recall"), F.col("precision")))


def prf_by_taxonomy(spark, d):
    known = _catalogue(spark, d).select(F.col("id").alias("risk_id"), F.col("isdefinedbytaxonomy").alias("taxonomy"))
    rows = _sets(spark, d).join(known, "risk_id", "left").fillna("unknown", ["taxonomy"])
    return evaluate.scored(rows, ["taxonomy"])


def prf_category(spark, d):
    links = cat.mapping_links(_catalogue(spark, d)).where("predicate in ('exact', 'close', 'broad')").select(F.col("id").alias("risk_id"), F.col("target").alias("category")).distinct()
    judged = t.judged(spark, d).withColumn("policy", _policy()).join(links, "risk_id")
    sets = evaluate.compared(judged.where("label = 1"), judged.where(F.col("score") >= THRESHOLD), ["policy", "category"])
    return evaluate.scored(sets, ["policy"])


def macro_micro(spark, d):
    by = evaluate.scored(_sets(spark, d), ["policy"], 12)
    total = by.agg(
        F.round(F.avg("precision"), 6).alias("macro_precision"), F.round(F.avg("recall"), 6).alias("macro_recall"), F.round(F.avg("f1"), 6).alias("macro_f1"),
        F.sum("matched").alias("m"), F.sum("expected").alias("e"), F.sum("extracted").alias("x"),
        F.count_if(evaluate.passed(F.col("recall"), F.col("precision"))).alias("passed"),
    )
    p, r, f = S.precision_recall(F.col("m"), F.col("e"), F.col("x"))
    return total.select("macro_precision", "macro_recall", "macro_f1", "passed", p.alias("micro_precision"), r.alias("micro_recall"), f.alias("micro_f1"))


def heatmap_pivot(spark, d):
    """The cells of the heat-maps, of every policy and taxonomy."""
    known = _catalogue(spark, d).select(F.col("id").alias("risk_id"), F.col("isdefinedbytaxonomy").alias("taxonomy"))
    rows = evaluate.scored(_sets(spark, d).join(known, "risk_id", "left").fillna("unknown", ["taxonomy"]), ["policy", "taxonomy"])
    return rows.select("policy", "taxonomy", "f1", "recall", "precision")


def differences(spark, d):
    rows = evaluate.differences(_sets(spark, d), ["policy"], "risk_id")
    return rows.select("policy", *(F.array_join(c, ",").alias(c) for c in ("matched", "missing", "spurious")))


def threshold_sweep(spark, d):
    return evaluate.threshold_sweep(t.judged(spark, d))


def best_threshold(spark, d):
    return evaluate.best_threshold(evaluate.threshold_sweep(t.judged(spark, d))).select("threshold", "f1")


def roc_auc(spark, d):
    return evaluate.auc_trapz(t.judged(spark, d))


def pair_type_stats(spark, d):
    return evaluate.stats_by(t.judged(spark, d).fillna("none", ["decision"]), "decision", THRESHOLD)


def verdict_f1(spark, d):
    judged = t.judged(spark, d)
    sets = evaluate.compared(judged.where("label = 1"), judged.where("decision in ('accepted', 'borderline_judged')"), ["candidate_id"])
    return evaluate.scored(sets.withColumn("scope", F.lit("verdicts")), ["scope"])


def grounding_score(spark, d):
    both = t.judged(spark, d).where("label = 1 and decision in ('accepted', 'borderline_judged') and justification is not null and risk_description is not null")
    quotes = both.agg(F.coalesce(F.avg(X.token_f1(F.col("justification"), F.col("risk_description"))), F.lit(0.0)).alias("quote_f1"))
    return verdict_f1(spark, d).crossJoin(quotes).select(F.round(evaluate.grounding_score(F.col("f1"), F.col("quote_f1")), 5).alias("score"))


def retrieval_recall(spark, d):
    judged = t.judged(spark, d).withColumn("policy", _policy())
    near = t.candidates(spark, d).where("bm25_rank > 0").withColumn("policy", _policy())
    return evaluate.retrieval_recall(judged.where("label = 1"), near.join(judged.select("policy").distinct(), "policy", "left_semi"), "policy", "risk_id")


def name_matching(spark, d):
    judged = t.judged(spark, d).withColumn("policy", _policy()).where("risk_name is not null")
    names = judged.where("label = 1").select("policy", F.lit("expected").alias("side"), F.col("risk_name").alias("name")).distinct()
    taken = judged.where(F.col("score") >= THRESHOLD).select("policy", F.lit("predicted").alias("side"), F.col("risk_name").alias("name")).distinct()
    return evaluate.match_names(names.unionByName(taken), "policy")


def hard_negatives(spark, d):
    judged = t.judged(spark, d).withColumn("policy", _policy())
    pool = t.candidates(spark, d).where("decision = 'discarded'").withColumn("policy", _policy())
    return mining.hard_negatives(judged.where("label = 1"), pool, ["policy"], "risk_id", 3)


def mined_negatives(spark, d):
    rows = t.judged(spark, d).withColumn("positive", F.col("label") == 1)
    return mining.mined_negatives(rows, ["source"], "candidate_id", "positive").select("source", "candidate_id", "place")


def first_accepting(spark, d):
    rows = t.candidates(spark, d).where("decision = 'accepted'")
    return mining.first_accepting(rows, ["source"], "risk_id", "chunk_index")


def token_budget(spark, d):
    message = F.array(F.struct(F.lit("system").alias("role"), F.lit("judge").alias("content")), F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    rows = t.table(spark, d, "documents").where("text is not null").select("doc_id", X.message_tokens(message).cast("bigint").alias("input_tokens"))
    return rows.withColumn("max_tokens", X.output_budget(F.col("input_tokens"), 2048, 1024))


def truncate_messages(spark, d):
    rows = t.table(spark, d, "documents").where("text is not null").select("doc_id", X.truncated_length(F.length("text")).alias("kept"), "text")
    return rows.where("kept is not null").select("doc_id", "kept", F.md5(F.substring("text", F.lit(1), F.col("kept").cast("int")).cast("binary")).alias("digest"))


def context_overflow(spark, d):
    length = F.length("text").cast("string")
    message = F.concat(F.lit("maximum context length is 8192 tokens. However, you requested 500 output tokens and your prompt contains at least "), length, F.lit(" input tokens"))
    return t.table(spark, d, "documents").where("text is not null").select("doc_id", X.reduced_output(message).alias("max_tokens"))


def call_usage_by_stage(spark, d):
    rows = t.table(spark, d, "events").withColumn("tokens", F.get_json_object("props", "$.k").cast("bigint"))
    return rows.groupBy(F.col("event_type").alias("stage")).agg(
        F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("most"), F.countDistinct("user_id").alias("users")
    )


def policy_split(spark, d):
    """Whole policies on one side: every fifth in the order of a seeded hash is for evaluation."""
    rows = t.judged(spark, d).select("candidate_id", _policy().alias("policy"))
    order = Window.orderBy(mining.seeded(0, "policy"), F.col("policy"))
    side = rows.select("policy").distinct().withColumn("side", F.when(F.row_number().over(order) % 5 == 0, "eval").otherwise("train"))
    return rows.join(side, "policy").select("candidate_id", "policy", "side")


def corpus_retrieval(spark, d):
    """The risks that any chunk of a document retrieves, and how many of its accepted ones are among them."""
    rows = t.candidates(spark, d).groupBy("source").agg(
        F.countDistinct(F.when(F.col("bm25_rank") > 0, F.col("risk_id"))).alias("retrieved"),
        F.countDistinct(F.when((F.col("bm25_rank") > 0) & (F.col("decision") == "accepted"), F.col("risk_id"))).alias("both"),
        F.countDistinct(F.when(F.col("decision") == "accepted", F.col("risk_id"))).alias("accepted"),
    )
    return rows.select("source", "retrieved", "accepted", F.round(F.when(F.col("accepted") > 0, F.col("both") / F.col("accepted")).otherwise(F.lit(1.0)), 6).alias("recall"))


def verdict_examples(spark, d):
    """Judged candidates as examples: label and the first 200 characters of the quote."""
    rows = t.judged(spark, d).where("justification is not null")
    return rows.select("candidate_id", "label", F.substring("justification", 1, 200).alias("quote"))


def recall_examples(spark, d):
    """Of each policy its chunks and the risks that were found relevant."""
    judged = t.judged(spark, d).withColumn("policy", _policy())
    ids = judged.where("label = 1").groupBy("policy").agg(F.array_join(F.array_sort(F.collect_set("risk_id")), ",").alias("expected"))
    chunks = t.chunks(spark, d).where("text is not null").groupBy(_policy().alias("policy")).agg(F.count("*").alias("n_chunks"))
    return chunks.join(ids, "policy")


def extraction_run(spark, d):
    """The whole run over the documents with the model-free stand-ins: merged matches."""
    docs = t.table(spark, d, "documents").select("doc_id", "text").where("text is not null")
    result = pipeline.run_extraction(docs, _catalogue(spark, d), RunConfig(score_floor=0.2))
    return result["merged"].select("risk_id", "query_id", F.round("confidence", 6).alias("confidence"), "accepted_by", "grounding_confidence", "n_matches")


QUERIES = {f.__name__: f for f in (
    policy_split, corpus_retrieval, verdict_examples, recall_examples, extraction_run,
    judge_semi, ground_filtered_anti, ground_batches, multi_pass_union, variant_expand, variant_grounding, merge_best, evidence_cap, evidence_match,
    quote_token_f1, content_overlap, expand_siblings, grounding_groups, mitigation_fallback, threat_fallback, mitigation_index, action_descriptions,
    prf_overall, prf_by_policy, prf_by_taxonomy, prf_category, macro_micro, heatmap_pivot, differences, threshold_sweep, best_threshold, roc_auc,
    pair_type_stats, verdict_f1, grounding_score, retrieval_recall, name_matching, hard_negatives, mined_negatives, first_accepting,
    token_budget, truncate_messages, context_overflow, call_usage_by_stage,
)}

_BRIDGE = "bridge AS (SELECT id AS risk_id, nullif(regexp_extract(id, '^(.*)---', 1), '') AS parent_id FROM catalogue WHERE contains(id, '---'))"
_MATCH = t.CANDIDATES + ", m AS (SELECT *, coalesce(ce, fused, 0.0) AS confidence FROM cand WHERE decision IN ('accepted', 'borderline_judged'))"


def _prf(matched="matched", expected="expected", extracted="extracted", digits=6) -> str:
    p = f"CASE WHEN {extracted} > 0 THEN {matched}::DOUBLE / {extracted} ELSE 0.0 END"
    r = f"CASE WHEN {expected} > 0 THEN {matched}::DOUBLE / {expected} ELSE 0.0 END"
    f = f"CASE WHEN ({p}) + ({r}) > 0 THEN 2 * ({p}) * ({r}) / (({p}) + ({r})) ELSE 0.0 END"
    return f"round({p}, {digits}) AS precision, round({r}, {digits}) AS recall, round({f}, {digits}) AS f1"


_COUNTS = "CAST(sum(e) AS BIGINT) AS expected, CAST(sum(x) AS BIGINT) AS extracted, CAST(sum(e * x) AS BIGINT) AS matched"
_SETS = f"""{t.JUDGED},
pj AS (SELECT *, split_part(source, '/', 1) AS policy FROM judged),
sets AS (SELECT policy, risk_id, max(label) AS e, max(CASE WHEN score >= {THRESHOLD} THEN 1 ELSE 0 END) AS x FROM pj GROUP BY ALL HAVING max(label) = 1 OR max(score) >= {THRESHOLD})"""
_BY = f"{_SETS}, by_policy AS (SELECT policy, {_COUNTS} FROM sets GROUP BY policy)"
_STEPS = "step AS (SELECT DISTINCT threshold FROM (SELECT unnest([" + ", ".join(map(str, sorted({*evaluate.FIXED_THRESHOLDS, *(round(0.05 + 0.01 * i, 2) for i in range(94))}))) + "])::DOUBLE AS threshold))"
_SWEEP = f"{t.JUDGED}, {_STEPS}, swept AS (SELECT threshold, CAST(sum(label) AS BIGINT) AS expected, count(*) FILTER (score >= threshold) AS extracted, CAST(coalesce(sum(label) FILTER (score >= threshold), 0) AS BIGINT) AS matched FROM step, judged GROUP BY threshold)"


def _f1(a: str, b: str) -> str:
    x, y = f"list_distinct({t.tokens_sql(a)})", f"list_distinct({t.tokens_sql(b)})"
    return f"CASE WHEN len(list_intersect({x}, {y})) > 0 THEN 2.0::DOUBLE * len(list_intersect({x}, {y})) / (len({x}) + len({y})) ELSE 0.0 END"


_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"


def _content(c: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda w: NOT list_contains({_STOP}, w)))"


_OVER = f"len(list_intersect({_content('justification')}, {_content('risk_name')}))::DOUBLE / greatest(len({_content('justification')}), len({_content('risk_name')}))"
_VERDICT = f"{t.JUDGED}, vs AS (SELECT candidate_id, label AS e, CASE WHEN decision IN ('accepted', 'borderline_judged') THEN 1 ELSE 0 END AS x FROM judged WHERE label = 1 OR decision IN ('accepted', 'borderline_judged')), vc AS (SELECT {_COUNTS} FROM vs)"
_EXPANDED = f"""{t.VERDICTS}, {EDGES},
found AS (SELECT DISTINCT risk_id AS rid FROM verdict WHERE relevant),
reach AS (
  SELECT rid, dst FROM found JOIN edge ON edge.src = rid
  UNION ALL SELECT rid, dst FROM found JOIN edge ON edge.src = nullif(regexp_extract(rid, '^(.*)---', 1), '') WHERE rid NOT IN (SELECT src FROM edge)),
fresh AS (SELECT dst AS risk_id, min(rid) AS source_risk_id FROM reach WHERE dst NOT IN (SELECT rid FROM found) GROUP BY dst)"""
_ACTIONS = "action AS (SELECT DISTINCT id AS risk_id, target AS action_id FROM link WHERE predicate IN ('broad', 'related'))"
SQL = {
    "policy_split": f"""
WITH {t.JUDGED}, p AS (SELECT DISTINCT split_part(source, '/', 1) AS policy FROM judged),
s AS (SELECT policy, CASE WHEN row_number() OVER (ORDER BY md5('0|' || policy), policy) % 5 = 0 THEN 'eval' ELSE 'train' END AS side FROM p)
SELECT candidate_id, policy, side FROM judged JOIN s ON s.policy = split_part(source, '/', 1)""",
    "corpus_retrieval": f"""
WITH {t.CANDIDATES}, c AS (
  SELECT source, count(DISTINCT risk_id) FILTER (bm25_rank > 0) AS retrieved, count(DISTINCT risk_id) FILTER (bm25_rank > 0 AND decision = 'accepted') AS hit,
    count(DISTINCT risk_id) FILTER (decision = 'accepted') AS accepted FROM cand GROUP BY source)
SELECT source, retrieved, accepted, round(CASE WHEN accepted > 0 THEN hit::DOUBLE / accepted ELSE 1.0 END, 6) AS recall FROM c""",
    "verdict_examples": f"WITH {t.JUDGED} SELECT candidate_id, label, substr(justification, 1, 200) AS quote FROM judged WHERE justification IS NOT NULL",
    "recall_examples": f"""
WITH {t.JUDGED}, {t.CHUNKS}, e AS (SELECT split_part(source, '/', 1) AS policy, string_agg(DISTINCT risk_id, ',' ORDER BY risk_id) AS expected FROM judged WHERE label = 1 GROUP BY 1)
SELECT policy, count(*) AS n_chunks, any_value(expected) AS expected FROM (SELECT split_part(source, '/', 1) AS policy FROM chunk WHERE text IS NOT NULL) JOIN e USING (policy) GROUP BY policy""",
    "judge_semi": f"WITH {t.CANDIDATES}, {t.VERDICTS} SELECT candidate_id, risk_id FROM cand WHERE decision IN ('borderline', 'borderline_judged') AND candidate_id IN (SELECT candidate_id FROM verdict WHERE relevant)",
    "ground_filtered_anti": f"WITH {t.CANDIDATES}, {t.VERDICTS} SELECT cand.candidate_id, cand.risk_id FROM cand JOIN verdict USING (candidate_id) WHERE decision = 'accepted' AND relevant IS NOT TRUE",
    "ground_batches": f"WITH {t.CANDIDATES} SELECT candidate_id, (row_number() OVER (PARTITION BY source, chunk_index ORDER BY candidate_id) - 1) // 15 AS batch FROM cand WHERE decision = 'borderline'",
    "multi_pass_union": "SELECT candidate_id, decision FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY ingested_at, decision DESC NULLS LAST) AS n FROM candidates) WHERE n = 1",
    "variant_expand": f"WITH {t.CANDIDATES}, {_BRIDGE} SELECT candidate_id, coalesce(bridge.risk_id, cand.risk_id) AS risk_id FROM cand LEFT JOIN bridge ON bridge.parent_id = cand.risk_id WHERE decision = 'accepted'",
    "variant_grounding": f"""
WITH {_MATCH}, {t.VERDICTS}, {_BRIDGE}, p AS (SELECT DISTINCT risk_id FROM m), g AS (SELECT DISTINCT risk_id FROM verdict WHERE relevant)
SELECT risk_id, CAST(NULL AS VARCHAR) AS variant_of FROM p WHERE risk_id NOT IN (SELECT parent_id FROM bridge)
UNION ALL SELECT bridge.risk_id, p.risk_id FROM p JOIN bridge ON bridge.parent_id = p.risk_id JOIN g ON g.risk_id = bridge.risk_id""",
    "merge_best": f"""
WITH {_MATCH} SELECT risk_id, candidate_id, confidence, origin, n_matches FROM (
  SELECT *, source || '#' || chunk_index AS origin, count(*) OVER (PARTITION BY risk_id) AS n_matches,
    row_number() OVER (PARTITION BY risk_id ORDER BY confidence DESC, candidate_id) AS n FROM m) WHERE n = 1""",
    "evidence_cap": f"""
WITH {_MATCH}, {t.VERDICTS},
once AS (
  SELECT *, row_number() OVER (PARTITION BY risk_id, text ORDER BY confidence DESC, candidate_id) AS n
  FROM (SELECT m.*, verdict.justification AS text FROM m JOIN verdict USING (candidate_id)) WHERE text IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY risk_id ORDER BY ce DESC NULLS LAST, candidate_id) AS place FROM once WHERE n = 1)
SELECT risk_id, candidate_id, place FROM placed WHERE place <= 3""",
    "evidence_match": f"""
WITH {t.CANDIDATES}, {t.VERDICTS}, {t.CHUNKS},
j AS (
  SELECT candidate_id, {t.tokens_sql('justification')} AS e, {t.tokens_sql('text')} AS c
  FROM verdict JOIN (SELECT candidate_id, source, chunk_index FROM cand) USING (candidate_id) JOIN chunk USING (source, chunk_index)
  WHERE text IS NOT NULL AND justification IS NOT NULL),
s AS (
  SELECT candidate_id, contains(array_to_string(c, ' '), array_to_string(e, ' ')) AS is_exact,
    CASE WHEN len(e) > 0 THEN len(list_intersect(list_distinct(e), c))::DOUBLE / len(list_distinct(e)) ELSE 0.0 END AS o FROM j)
SELECT candidate_id, is_exact, round(o, 6) AS overlap, is_exact OR o >= 0.6 AS matches FROM s""",
    "quote_token_f1": f"""
WITH {t.CANDIDATES}, {t.VERDICTS}
SELECT candidate_id, round({_f1('justification', 'risk_description')}, 6) AS f1 FROM verdict JOIN (SELECT candidate_id, risk_description FROM cand) USING (candidate_id)
WHERE justification IS NOT NULL AND risk_description IS NOT NULL""",
    "content_overlap": f"""
WITH {t.CANDIDATES}, {t.VERDICTS}
SELECT candidate_id, round(CASE WHEN len({_content('justification')}) > 0 AND len({_content('risk_name')}) > 0 THEN {_OVER} ELSE 0.0 END, 6) AS overlap
FROM verdict JOIN (SELECT candidate_id, risk_name FROM cand) USING (candidate_id) WHERE justification IS NOT NULL AND risk_name IS NOT NULL""",
    "expand_siblings": f"WITH {_EXPANDED} SELECT risk_id, source_risk_id FROM fresh",
    "grounding_groups": f"""
WITH {_EXPANDED}, {t.CANDIDATES}, {t.CHUNKS},
near AS (SELECT DISTINCT cand.risk_id, chunk_id FROM cand JOIN chunk USING (source, chunk_index)),
placed AS (
  SELECT fresh.*, coalesce(a.ispartof, b.ispartof, 'ungrouped') AS parent
  FROM fresh LEFT JOIN catalogue a ON a.id = fresh.risk_id LEFT JOIN catalogue b ON b.id = fresh.source_risk_id),
pick AS (SELECT parent, chunk_id, row_number() OVER (PARTITION BY parent ORDER BY chunk_id) AS n FROM (SELECT DISTINCT parent, chunk_id FROM placed JOIN near ON near.risk_id = placed.source_risk_id)),
ch AS (SELECT parent, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY chunk_id) AS chunk_ids FROM pick WHERE n <= 20 GROUP BY parent),
bt AS (SELECT parent, risk_id, (row_number() OVER (PARTITION BY parent ORDER BY risk_id) - 1) // 15 AS batch FROM placed)
SELECT parent, batch, string_agg(risk_id, ',' ORDER BY risk_id) AS risk_ids, any_value(chunk_ids) AS chunk_ids FROM bt JOIN ch USING (parent) GROUP BY parent, batch""",
    "mitigation_fallback": f"""
WITH {CROSS}, {_ACTIONS}
SELECT id AS risk_id, action_id, id AS via FROM catalogue JOIN action ON action.risk_id = id
UNION ALL
SELECT c.id, a.action_id, min(a.risk_id) FROM catalogue c JOIN cross_ids x ON x.risk_id = c.id JOIN action a ON a.risk_id = x.home_id
WHERE c.id NOT IN (SELECT risk_id FROM action) GROUP BY c.id, a.action_id""",
    "threat_fallback": f"""
WITH {CROSS}, across AS (SELECT x.risk_id, min_by(c.concern, x.home_id) AS v FROM cross_ids x JOIN catalogue c ON c.id = x.home_id WHERE c.concern IS NOT NULL GROUP BY x.risk_id)
SELECT id AS risk_id, coalesce(concern, v) AS threat FROM catalogue LEFT JOIN across ON across.risk_id = id""",
    "mitigation_index": """
WITH r AS (SELECT DISTINCT id AS action_id, isdefinedbytaxonomy AS source, unnest(related_mappings) AS risk_id FROM catalogue)
SELECT r.risk_id, action_id, source, CASE WHEN c.risk_type = 'agentic' THEN 'technical' WHEN source = 'lantern' AND split_part(action_id, '-', 1) = 'lantern' THEN 'operational'
  WHEN source = 'tessera' AND split_part(action_id, '-', 1) = 'tessera' THEN 'governance' END AS category
FROM r JOIN catalogue c ON c.id = action_id WHERE starts_with(r.risk_id, 'tessera-')""",
    "action_descriptions": f"""
WITH {CROSS}, {_ACTIONS}, a AS (SELECT DISTINCT action_id FROM action)
SELECT action_id, trim(CASE WHEN trim(concern) <> '' THEN concern WHEN trim(description) <> '' THEN description END) AS description FROM a LEFT JOIN catalogue ON id = action_id""",
    "prf_overall": f"WITH {_SETS}, c AS (SELECT {_COUNTS} FROM sets) SELECT 'all' AS scope, *, {_prf()} FROM c",
    "prf_by_policy": f"WITH {_BY}, s AS (SELECT *, {_prf()} FROM by_policy) SELECT *, recall >= 0.8 AND precision >= 0.6 AS passed FROM s",
    "prf_by_taxonomy": f"""
WITH {_SETS}, c AS (SELECT coalesce(isdefinedbytaxonomy, 'unknown') AS taxonomy, {_COUNTS} FROM sets LEFT JOIN catalogue ON id = risk_id GROUP BY 1) SELECT *, {_prf()} FROM c""",
    "prf_category": f"""
WITH {t.JUDGED}, {CROSS},
l AS (SELECT DISTINCT id AS risk_id, target AS category FROM link WHERE predicate IN ('exact', 'close', 'broad')),
pj AS (SELECT split_part(source, '/', 1) AS policy, category, label, score FROM judged JOIN l USING (risk_id)),
sets AS (SELECT policy, category, max(label) AS e, max(CASE WHEN score >= {THRESHOLD} THEN 1 ELSE 0 END) AS x FROM pj GROUP BY ALL HAVING max(label) = 1 OR max(score) >= {THRESHOLD}),
c AS (SELECT policy, {_COUNTS} FROM sets GROUP BY policy) SELECT *, {_prf()} FROM c""",
    "macro_micro": f"""
WITH {_BY}, s AS (SELECT *, {_prf(digits=12)} FROM by_policy),
a AS (SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, count(*) FILTER (recall >= 0.8 AND precision >= 0.6) AS passed,
  sum(matched) AS matched, sum(expected) AS expected, sum(extracted) AS extracted FROM s),
z AS (SELECT *, {_prf()} FROM a)
SELECT macro_precision, macro_recall, macro_f1, passed, precision AS micro_precision, recall AS micro_recall, f1 AS micro_f1 FROM z""",
    "heatmap_pivot": f"""
WITH {_SETS}, c AS (SELECT policy, coalesce(isdefinedbytaxonomy, 'unknown') AS taxonomy, {_COUNTS} FROM sets LEFT JOIN catalogue ON id = risk_id GROUP BY ALL), s AS (SELECT *, {_prf()} FROM c)
SELECT policy, taxonomy, f1, recall, precision FROM s""",
    "differences": f"""
WITH {_SETS} SELECT policy, coalesce(string_agg(risk_id, ',' ORDER BY risk_id) FILTER (e = 1 AND x = 1), '') AS matched,
  coalesce(string_agg(risk_id, ',' ORDER BY risk_id) FILTER (e = 1 AND x = 0), '') AS missing, coalesce(string_agg(risk_id, ',' ORDER BY risk_id) FILTER (e = 0 AND x = 1), '') AS spurious
FROM sets GROUP BY policy""",
    "threshold_sweep": f"WITH {_SWEEP} SELECT *, {_prf()} FROM swept",
    "best_threshold": f"WITH {_SWEEP}, s AS (SELECT *, {_prf()} FROM swept) SELECT threshold, f1 FROM s ORDER BY f1 DESC, threshold LIMIT 1",
    "roc_auc": f"""
WITH {t.JUDGED}, a AS (SELECT score, sum(label) AS tp, sum(1 - label) AS fp FROM judged GROUP BY score),
c AS (SELECT score, sum(tp) OVER w AS tp, sum(fp) OVER w AS fp FROM a WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
z AS (SELECT (fp - lag(fp) OVER w) * (tp + lag(tp) OVER w) / 2.0::DOUBLE AS s FROM c WINDOW w AS (ORDER BY score DESC))
SELECT round(coalesce(CASE WHEN p > 0 AND n > 0 THEN (SELECT sum(s) FROM z) / (p::DOUBLE * n) ELSE 0.0 END, 0.0), 6) AS auc FROM (SELECT sum(tp) AS p, sum(fp) AS n FROM a)""",
    "pair_type_stats": f"""
WITH {t.JUDGED} SELECT coalesce(decision, 'none') AS decision, count(*) AS n, round(avg(CASE WHEN (score >= {THRESHOLD})::INT = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy, round(avg(score), 6) AS mean,
  round(median(score), 6) AS median, round(stddev_pop(score), 6) AS std FROM judged GROUP BY 1""",
    "verdict_f1": f"WITH {_VERDICT} SELECT 'verdicts' AS scope, *, {_prf()} FROM vc",
    "grounding_score": f"""
WITH {_VERDICT}, f AS (SELECT *, {_prf()} FROM vc),
q AS (SELECT coalesce(avg({_f1('justification', 'risk_description')}), 0.0) AS q FROM judged WHERE label = 1 AND decision IN ('accepted', 'borderline_judged') AND justification IS NOT NULL AND risk_description IS NOT NULL)
SELECT round(0.8 * f1 + 0.2 * q, 5) AS score FROM f, q""",
    "retrieval_recall": f"""
WITH {t.JUDGED}, e AS (SELECT DISTINCT split_part(source, '/', 1) AS policy, risk_id FROM judged WHERE label = 1),
g AS (SELECT DISTINCT split_part(source, '/', 1) AS policy, risk_id FROM cand WHERE bm25_rank > 0),
p AS (SELECT DISTINCT split_part(source, '/', 1) AS policy FROM judged)
SELECT p.policy, round(CASE WHEN count(e.risk_id) > 0 THEN count(g.risk_id)::DOUBLE / count(e.risk_id) ELSE 1.0 END, 6) AS recall
FROM p LEFT JOIN e USING (policy) LEFT JOIN g ON g.policy = e.policy AND g.risk_id = e.risk_id GROUP BY p.policy""",
    "hard_negatives": f"""
WITH {t.JUDGED}, pos AS (SELECT DISTINCT split_part(source, '/', 1) AS policy, risk_id FROM judged WHERE label = 1),
pool AS (SELECT DISTINCT split_part(source, '/', 1) AS policy, risk_id FROM cand WHERE decision = 'discarded'),
r AS (SELECT *, row_number() OVER (PARTITION BY policy ORDER BY md5('0|' || policy || '|' || risk_id), risk_id) AS n FROM pool ANTI JOIN pos USING (policy, risk_id))
SELECT r.policy, r.risk_id FROM r JOIN (SELECT policy, 3 * count(*) AS w FROM pos GROUP BY policy) USING (policy) WHERE n <= w""",
    "mined_negatives": f"""
WITH {t.JUDGED}, room AS (SELECT source, greatest(least(5, 12 - sum(label)), 0) AS r FROM judged GROUP BY source),
n AS (SELECT source, candidate_id, row_number() OVER (PARTITION BY source ORDER BY score DESC, candidate_id) AS place FROM judged WHERE label = 0)
SELECT source, candidate_id, place FROM n JOIN room USING (source) WHERE place <= r""",
    "first_accepting": f"WITH {t.CANDIDATES} SELECT source, risk_id, min(chunk_index) AS chunk_index FROM cand WHERE decision = 'accepted' GROUP BY ALL",
    "token_budget": """
WITH i AS (SELECT doc_id, 2 + 4 + length('judge') // 3 + 4 + length(text) // 3 AS input_tokens FROM documents WHERE text IS NOT NULL)
SELECT doc_id, input_tokens, CAST(CASE WHEN 2048 - input_tokens - 500 - 64 < 256 THEN 256 ELSE least(1024, 2048 - input_tokens - 500 - 64) END AS BIGINT) AS max_tokens FROM i""",
    "truncate_messages": "SELECT doc_id, greatest(CAST(floor(length(text) * 0.6) AS BIGINT), 500) AS kept, md5(substr(text, 1, greatest(CAST(floor(length(text) * 0.6) AS BIGINT), 500))) AS digest FROM documents WHERE length(text) > 500",
    "context_overflow": "SELECT doc_id, CASE WHEN 8192 - length(text) - 32 >= 256 THEN 8192 - length(text) - 32 END AS max_tokens FROM documents WHERE text IS NOT NULL",
    "call_usage_by_stage": """
SELECT event_type AS stage, count(*) AS calls, CAST(sum(k) AS BIGINT) AS tokens, max(k) AS most, count(DISTINCT user_id) AS users
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type""",
}
