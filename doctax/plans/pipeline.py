"""A run from documents to merged matches, as one plan per stage.

Search (padded texts, BM25 and vectors fused, scored, classified; or by generated queries, with the rest as
fallback), judge, grounding in batches and passes, variants of families, expansion to siblings with
grounding of groups, merging with capped evidence, and, if wanted, actions and causal chains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions.text import tokens
from ..operators import catalog, chunk, context, enrich, expand, ground, merge, providers, retrieval
from ..operators import select as decide
from ..shared import settled

KEYS = ["query_id"]
#: What is known of a candidate; texts stay out of what is ranked and joined again.
FIELDS = ("query_id", "risk_id", "candidate_id", "bm25_rank", "lexical_rank", "embedding_distance", "rrf_score", "fused_place", "cross_encoder_score")
CHAIN = ("threat", "threat_source", "vulnerability", "consequence", "impact")
MATCH = ("query_id", "risk_id", "confidence", "cross_encoder_score", "accepted_by", "grounding_confidence", "quotes")


def lexical_scorer(pairs: DataFrame) -> DataFrame:
    """A stand-in for a cross-encoder: the share of an entry's words that the text has (both split once, before they are paired)."""
    share = F.size(F.array_intersect("entry_words", "words")) / F.size("entry_words")
    return pairs.withColumn("cross_encoder_score", F.when(F.size("entry_words") > 0, share).otherwise(F.lit(0.0)))


class Calls:
    """The model calls of a run; each stage's are written, so that they are made once."""

    def __init__(self, provider: str):
        self.provider, self.made = provider, []

    def ask(self, rows: DataFrame, stage: str) -> DataFrame:
        self.made.append(settled(providers.call_model(rows, stage, self.provider)))
        return self.made[-1]

    def log(self) -> DataFrame | None:
        log = None
        for one in self.made:
            log = one if log is None else log.unionByName(one)
        return log


def search(asked: DataFrame, corpus: DataFrame, config: RunConfig, scorer=lexical_scorer, embeddings: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Candidates of texts ``(query_id, text)``: both lists fused, twice the top scored, the top of those kept."""
    found = retrieval.bm25(corpus, asked.select("query_id", "text"), config.lexical_top).select("query_id", F.col("id").alias("risk_id"), F.col("place").alias("bm25_rank"))
    found = found.withColumn("embedding_distance", F.lit(None).cast("double"))
    if embeddings is not None:
        near = retrieval.dense(embeddings[1], embeddings[0], config.dense_top).select(F.col("query_id").cast("string"), F.col("id").cast("string").alias("risk_id"), (1 - F.col("similarity")).alias("d"))
        found = found.drop("embedding_distance").join(near.withColumnRenamed("d", "embedding_distance"), ["query_id", "risk_id"], "full_outer")
    found = found.withColumn("candidate_id", F.concat_ws("|", "query_id", "risk_id")).withColumn("cross_encoder_score", F.lit(None).cast("double"))
    fused = retrieval.best(retrieval.rrf_fuse(found, KEYS, "candidate_id", config.lexical_top), KEYS, "rrf", "candidate_id", 2 * config.top, "fused_place").withColumnRenamed("rrf", "rrf_score")
    if not config.use_cross_encoder:
        kept = fused.where((F.col("rrf_score") >= config.rrf_floor) & (F.col("fused_place") <= config.top))
        return kept.withColumn("cross_encoder_score", F.lit(None).cast("double")).select(*FIELDS)
    split = lambda c: F.array_distinct(tokens(F.col(c)))
    texts = corpus.select(F.col("id").alias("risk_id"), F.col("text").alias("entry_text"), split("text").alias("entry_words"))
    pairs = fused.drop("cross_encoder_score").join(F.broadcast(texts), "risk_id").join(asked.select("query_id", "text", split("text").alias("words")), "query_id")
    scored = scorer(pairs).drop("text", "entry_text", "words", "entry_words")
    return retrieval.reranked(scored, KEYS, "candidate_id", config.top, config.rescue_rank).select(*FIELDS)


def classified(candidates: DataFrame, config: RunConfig) -> DataFrame:
    """Candidates with their ``class``; without a cross-encoder all that are left are accepted."""
    if not config.use_cross_encoder:
        return candidates.withColumn("class", F.lit("accepted"))
    return decide.classify(
        candidates, KEYS, "candidate_id", config.threshold_high, config.threshold_low, accept=config.accept, judge=config.judge, floor=config.score_floor, rescue_rank=config.rescue_rank
    )


def generated_queries(chunks: DataFrame, calls: Calls, size: int = 5) -> tuple[DataFrame, DataFrame]:
    """Queries ``(group, query_no, text)`` that a model makes of runs of up to ``size`` chunks, and the chunks ``(group, query_id)`` of each run.

    Blank queries fall away; a run whose call failed has none.
    """
    runs = context.section_groups(chunks, ["doc_id"], "chunk_index", size).withColumn("group", F.concat_ws("#", F.col("doc_id").cast("string"), "run", "part"))
    texts = runs.groupBy("group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda c: c["text"]), "\n\n").alias("text"))
    made = calls.ask(texts.select(F.col("group").alias("key"), F.to_json(F.struct("text")).alias("payload")), "queries")
    rows = made.where("answer is not null").select(F.col("key").alias("group"), F.posexplode(F.from_json("answer", "array<string>")).alias("query_no", "q"))
    return rows.select("group", "query_no", F.trim("q").alias("text")).where("text <> ''"), runs.select("group", "query_id")


def searched_by_queries(queries: DataFrame, members: DataFrame, found: DataFrame) -> DataFrame:
    """The candidates of generated queries for every chunk of their run; a risk that several queries found counts for the first.

    ``found`` has the candidates by ``query_id`` ``group@query_no``.
    """
    named = queries.select(F.concat_ws("@", "group", F.col("query_no").cast("string")).alias("query_id"), "group", "query_no")
    spread = found.join(named, "query_id").drop("query_id").join(members, "group")
    first = F.min_by(F.struct(*(F.col(c) for c in FIELDS if c not in ("query_id", "risk_id", "candidate_id"))), F.struct("query_no", "candidate_id")).alias("r")
    once = spread.groupBy("query_id", "risk_id").agg(first).select("query_id", "risk_id", "r.*")
    return once.withColumn("candidate_id", F.concat_ws("|", "query_id", "risk_id")).select(*FIELDS)


def payloads(candidates: DataFrame, texts: DataFrame, size: int = 0, passes: int = 1) -> DataFrame:
    """``(key, payload)`` of calls about the candidates of each chunk in batches of ``size``, each asked ``passes`` times.

    ``candidates`` has ``query_id, risk_id, name, description``, ``texts`` ``query_id, text``; the key is ``query_id@batch@pass``.
    """
    risk = F.struct("risk_id", F.col("name").alias("risk_name"), F.col("description").alias("risk_description"))
    grouped = ground.in_batches(candidates, KEYS, "risk_id", size).groupBy("query_id", "batch").agg(F.array_sort(F.collect_list(risk)).alias("risks")).join(texts, "query_id")
    rows = grouped.withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(passes))))
    key = F.concat_ws("@", "query_id", F.col("batch").cast("string"), F.col("pass").cast("string"))
    return rows.select(key.alias("key"), F.to_json(F.struct("text", "risks")).alias("payload"))


def answered(calls: DataFrame) -> DataFrame:
    """Grounded answers ``(query_id, risk_id, quotes, grounding_confidence)``, of several passes the first."""
    said = ground.grounded(providers.verdicts(calls)).select(
        F.regexp_replace("key", r"@\d+@\d+$", "").alias("query_id"), F.regexp_extract("key", r"@(\d+)$", 1).cast("int").alias("pass"), "risk_id", "quotes", F.col("confidence").alias("grounding_confidence")
    )
    return merge.first_pass_wins(said, ["query_id", "risk_id"], "pass").drop("pass")


def with_variants(matches: DataFrame, bridge: DataFrame, names: DataFrame, texts: DataFrame, calls: Calls) -> DataFrame:
    """Matches with parents of families replaced by the variants that are grounded in the same chunk; scores are inherited."""
    parents = matches.join(bridge.select(F.col("parent_id").alias("risk_id")).distinct(), "risk_id", "left_semi")
    pairs = parents.select("query_id", F.col("risk_id").alias("parent_id")).join(bridge, "parent_id")
    asked = calls.ask(payloads(pairs.select("query_id", "risk_id").distinct().join(names, "risk_id"), texts), "variants")
    said = answered(asked).join(pairs, ["query_id", "risk_id"])
    inherited = parents.select("query_id", F.col("risk_id").alias("parent_id"), "confidence", "cross_encoder_score", "accepted_by")
    return matches.join(parents.select("query_id", "risk_id"), ["query_id", "risk_id"], "left_anti").select(*MATCH).unionByName(said.join(inherited, ["query_id", "parent_id"]).select(*MATCH))


def expanded_matches(found: DataFrame, found_chunks: DataFrame, catalogue: DataFrame, texts: DataFrame, calls: Calls, passes: int = 1) -> DataFrame:
    """Matches of siblings of found risks: grounded in groups of up to 15 risks and 20 chunks, each quote in the first chunk that has it.

    ``found`` has ``risk_id``, ``found_chunks`` ``risk_id, query_id``. The confidence is 0.
    """
    fresh = expand.expand_siblings(found, catalog.expansion_edges(catalogue), catalogue)
    groups = expand.grounding_groups(fresh, found_chunks.select("risk_id", F.col("query_id").alias("chunk_id")).distinct(), catalogue.select("id", "ispartof"))
    groups = settled(groups.withColumn("group", F.concat_ws("#", "parent", F.col("batch").cast("string"))))
    names = catalogue.select(F.col("id").alias("risk_id"), F.coalesce("name", F.lit("")).alias("risk_name"), F.coalesce("description", F.lit("")).alias("risk_description"))
    risks = groups.select("group", F.explode("risk_ids").alias("risk_id")).join(F.broadcast(names), "risk_id").groupBy("group").agg(F.array_sort(F.collect_list(F.struct("risk_id", "risk_name", "risk_description"))).alias("risks"))
    passages = groups.select("group", F.explode("chunk_ids").alias("query_id")).join(texts, "query_id").select("group", F.col("query_id").alias("chunk_id"), "text")
    whole = passages.groupBy("group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))), lambda p: p["text"]), "\n---\n").alias("text"))
    rows = risks.join(whole, "group").withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(passes))))
    key = F.concat_ws("@", "group", F.lit("0"), F.col("pass").cast("string"))
    said = answered(calls.ask(rows.select(key.alias("key"), F.to_json(F.struct("text", "risks")).alias("payload")), "expand")).withColumnRenamed("query_id", "group")
    quotes = ground.located(said.select("group", "risk_id", F.explode("quotes").alias("quote")), passages, "group")
    by_chunk = quotes.groupBy("group", "risk_id", F.col("chunk_id").alias("query_id")).agg(F.array_sort(F.collect_set("quote")).alias("quotes"))
    joined = by_chunk.join(said.select("group", "risk_id", "grounding_confidence"), ["group", "risk_id"])
    return joined.withColumns({"confidence": F.lit(0.0), "cross_encoder_score": F.lit(None).cast("double"), "accepted_by": F.lit("expansion")}).select(*MATCH)


def merged_matches(matches: DataFrame, most: int = 3) -> DataFrame:
    """One row a risk: its best match, the number of matches, and at most ``most`` different quotes with their chunks."""
    best = F.max_by(F.struct("query_id", "confidence", "accepted_by", "grounding_confidence", "quotes"), F.struct("confidence", "query_id")).alias("r")
    merged = matches.groupBy("risk_id").agg(best, F.count("*").alias("n_matches")).select("risk_id", "r.*", "n_matches")
    spans = matches.select("risk_id", "query_id", "confidence", F.col("cross_encoder_score").alias("score"), F.explode("quotes").alias("text"))
    kept = merge.cap_evidence(spans, ["risk_id"], "query_id", most).groupBy("risk_id").agg(F.array_sort(F.collect_list(F.struct("place", "query_id", "text"))).alias("evidence"))
    return merged.join(kept, "risk_id", "left")


def causal_chains(merged: DataFrame, names: DataFrame, texts: DataFrame, calls: Calls) -> DataFrame:
    """``merged`` with the five parts of a causal chain that a model makes of a risk and the chunks of its evidence; null without evidence."""
    chunks = merged.select("risk_id", F.explode(F.array_distinct(F.transform("evidence", lambda e: e["query_id"]))).alias("query_id")).join(texts, "query_id")
    asked = chunks.groupBy("risk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("query_id", "text"))), lambda p: p["text"]), "\n---\n").alias("text")).join(names, "risk_id")
    payload = F.to_json(F.struct("text", F.array(F.struct("risk_id", F.col("name").alias("risk_name"), F.col("description").alias("risk_description"))).alias("risks")))
    said = calls.ask(asked.select(F.col("risk_id").alias("key"), payload.alias("payload")), "causal").where("answer is not null")
    first = F.from_json("answer", "array<struct<" + ",".join(f"{c}:string" for c in CHAIN) + ">>")[0]
    return merged.join(providers.causal_chain(said.select(F.col("key").alias("risk_id"), first.alias("c")).select("risk_id", "c.*"), CHAIN), "risk_id", "left")


def run_extraction(
    documents: DataFrame, catalogue: DataFrame, config: RunConfig = RunConfig(), provider: str = "lexical", scorer=lexical_scorer,
    embeddings: tuple[DataFrame, DataFrame] | None = None, actions: DataFrame | None = None, home: str | None = None,
) -> dict[str, DataFrame]:
    """The stages of a run over ``documents (doc_id, text)``: chunks, candidates, calls, matches, merged.

    ``embeddings`` may give vectors of chunks and of entries, each ``(id, v)``; without them retrieval is lexical
    only. ``actions (risk_id, action_id)`` are listed with the risks, by way of the crosswalk to the taxonomy ``home``
    if there is one. Documents without text give nothing. Without a judge borderline candidates are promoted; without
    grounding nothing is expanded, and families stay as they are.
    """
    calls = Calls(provider)
    kept_entries = settled(catalog.prune_agentic(catalogue, documents))
    entries = settled(catalog.collapse_variants(kept_entries))
    corpus = retrieval.corpus_of(entries)
    pieces = chunk.plain_chunks(documents.where("trim(text) <> ''"), "doc_id", "text", config.chunk_tokens)
    chunks = pieces.withColumn("query_id", F.concat_ws("#", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))).withColumn("section", F.lit(None).cast("string"))
    chunks = settled(chunks)
    asked = context.padded(chunks, ["doc_id"], "chunk_index", config.context_sentences).select("query_id", F.col("padded").alias("text"))
    if config.query_generation:
        queries, members = generated_queries(chunks, calls)
        of = queries.select(F.concat_ws("@", "group", F.col("query_no").cast("string")).alias("query_id"), "text")
        by_query = searched_by_queries(queries, members, search(of, corpus, config, scorer, None))
        by_query = settled(by_query)
        rest = asked.join(by_query.select("query_id").distinct(), "query_id", "left_anti")
        scored = by_query.withColumn("class", F.lit("accepted")).unionByName(classified(search(rest, corpus, config, scorer, embeddings), config))
    else:
        scored = classified(search(asked, corpus, config, scorer, embeddings), config)
    scored = settled(scored)
    names = F.broadcast(entries.select(F.col("id").alias("risk_id"), "name", "description"))
    around = context.contexts(chunks.select("doc_id", "chunk_index", "text", "section"), ["doc_id"], "chunk_index", config.context_words)
    texts = settled(chunks.join(around, ["doc_id", "chunk_index"], "left").select("query_id", F.coalesce("context", "text").alias("text")))
    chosen = scored.where("class in ('accepted', 'borderline')").join(names.select("risk_id"), "risk_id", "left_semi")
    borderline = chosen.where("class = 'borderline'")
    kept = chosen.where("class = 'accepted'").withColumn("decision", F.lit("accepted"))
    ask = lambda rows, stage, passes: calls.ask(payloads(rows.join(names, "risk_id"), texts, config.grounding_batch, passes), stage)
    if config.use_judge and config.use_cross_encoder:
        said = providers.verdicts(ask(borderline, "judge", 1)).select(F.regexp_replace("key", r"@\d+@\d+$", "").alias("query_id"), "risk_id", "relevant")
        kept = kept.unionByName(ground.confirmed(borderline, said, ["query_id", "risk_id"], "relevant").withColumn("decision", F.lit("borderline_judged")))
    elif config.use_cross_encoder:
        kept = kept.unionByName(borderline.withColumn("decision", F.lit("borderline_judged")))
    kept = settled(kept)
    matches = kept.withColumn("confidence", decide.confidence(config.use_cross_encoder)).withColumn("accepted_by", decide.accepted_by(config.use_cross_encoder, not config.use_judge))
    bridge, known = catalog.variants(kept_entries), F.broadcast(kept_entries.select(F.col("id").alias("risk_id"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("description", F.lit("")).alias("description")))
    if config.use_grounding:
        matches = matches.join(answered(ask(kept, "ground", config.grounding_passes)), ["query_id", "risk_id"]).select(*MATCH)
        matches = settled(with_variants(settled(matches), bridge, known, texts, calls))
        if config.expand_siblings:
            found_chunks = kept.select("risk_id", "query_id").unionByName(matches.select("risk_id", "query_id"))
            more = settled(expanded_matches(matches.select("risk_id"), found_chunks, kept_entries, texts, calls, config.grounding_passes))
            matches = matches.unionByName(with_variants(more, bridge, known, texts, calls))
    else:
        matches = matches.withColumn("quotes", F.array().cast("array<string>")).withColumn("grounding_confidence", F.lit("ungrounded")).select(*MATCH)
    matches = settled(matches)
    merged = settled(merged_matches(matches, config.max_evidence))
    if actions is not None:
        across = catalog.crosswalk(kept_entries, home) if home else actions.select("risk_id", F.lit(None).cast("string").alias("home_id")).limit(0)
        listed = enrich.actions_of(merged.select("risk_id"), actions, across).groupBy("risk_id").agg(F.array_sort(F.collect_set("action_id")).alias("actions"))
        merged = merged.join(listed, "risk_id", "left")
    if config.causal_synthesis:
        both = entries.select(F.col("id").alias("risk_id"), "name", "description").unionByName(known).dropDuplicates(["risk_id"])
        merged = causal_chains(merged, both, texts, calls)
    named = scored.join(names, "risk_id").join(texts, "query_id")
    log = calls.log()
    return {"chunks": chunks, "candidates": named, "matches": matches, "merged": merged} | ({"calls": log} if log is not None else {})
