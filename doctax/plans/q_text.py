"""Queries on texts, chunks and the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import catalog as cat
from ..operators import chunk as chunking
from ..operators import context
from ..sources import documents as docs
from . import tables as t

HOME = "tessera"


def token_counts(spark, d):
    return t.table(spark, d, "documents").where("text is not null").select("doc_id", X.word_count(F.col("text")).alias("n_tokens"))


def sentence_counts(spark, d):
    return t.table(spark, d, "documents").where("text is not null").select("doc_id", F.size(X.sentences(F.col("text"))).cast("bigint").alias("n_sentences"))


def empty_documents(spark, d):
    rows = t.table(spark, d, "parsed_documents").groupBy("parsed_id").agg(F.max("content").alias("content"))
    return rows.where(F.coalesce(F.trim("content"), F.lit("")) == "").select("parsed_id")


def plain_chunks(spark, d):
    rows = t.table(spark, d, "parsed_documents").groupBy("parsed_id").agg(F.max("content").alias("content"))
    return chunking.plain_chunks(rows, "parsed_id", "content").select("parsed_id", "chunk_index", F.length("text").cast("bigint").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


def padded_text(spark, d):
    rows = context.padded(t.chunks(spark, d), ["source"], "chunk_index")
    return rows.where("text is not null").select("chunk_id", F.md5(F.col("padded").cast("binary")).alias("digest"))


def section_groups(spark, d):
    return context.section_groups(t.chunks(spark, d), ["source"], "chunk_index").select("chunk_id", "run", "part")


def chunk_context(spark, d):
    rows = context.contexts(t.chunks(spark, d), ["source"], "chunk_index")
    return rows.select("source", "chunk_index", X.word_count(F.col("context")).alias("n_words"), "context")


def chunk_summaries(spark, d):
    rows = t.candidates(spark, d)
    by = rows.groupBy("source", "chunk_index").agg(
        F.count("*").alias("retrieved"), F.count_if(F.col("decision") == "accepted").alias("accepted"), F.count_if(F.startswith("decision", F.lit("borderline"))).alias("borderline"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("decision") == "accepted", F.col("risk_id")))), ",").alias("accepted_ids"),
    )
    return by


def taxonomy_infer(spark, d):
    own = tuple((p, p.rstrip("-")) for p in ("civic-scale-", "harbour-list-", "lantern-", "mlr-2-", "tessera-group-"))
    ids = t.table(spark, d, "catalogue")
    return ids.select("id", X.taxonomy_of(F.col("id"), own).alias("inferred"), X.taxonomy_of(F.col("id")).alias("published"))


def excluded_taxonomies(spark, d):
    kept = cat.without_taxonomies(t.table(spark, d, "catalogue"), ("mlr-2", "lantern"))
    return kept.groupBy("isdefinedbytaxonomy").agg(F.count("*").alias("n"))


def agentic_filter(spark, d):
    return cat.prune_agentic(t.table(spark, d, "catalogue"), t.table(spark, d, "documents")).select("id", "risk_type")


def agentic_documents(spark, d):
    return t.table(spark, d, "documents").where("text is not null").select("doc_id", X.speaks_of_agents(F.col("text")).alias("speaks"))


def variant_collapse(spark, d):
    return cat.collapse_variants(t.table(spark, d, "catalogue"))


def expansion_graph(spark, d):
    return cat.expansion_edges(t.table(spark, d, "catalogue"))


def crossmap_normalise(spark, d):
    return cat.crosswalk(t.table(spark, d, "catalogue"), HOME)


def mapping_counts(spark, d):
    return cat.mapping_links(t.table(spark, d, "catalogue")).groupBy("id", "predicate").agg(F.count("*").alias("n"))


def cleaned_descriptions(spark, d):
    rows = t.table(spark, d, "catalogue").withColumn("defined", F.concat("name", F.lit(" is defined as if the "), "description"))
    return rows.select("id", X.cleaned_description(F.col("name"), F.col("defined")).alias("clean"))


def risk_text(spark, d):
    rows = t.table(spark, d, "catalogue")
    parts = F.concat_ws(". ", "name", F.nullif(F.substring("description", 1, 300), F.lit("")), F.nullif(F.substring("concern", 1, 200), F.lit("")))
    return rows.select("id", parts.alias("text"))


def table_serialise(spark, d):
    """Each target as a table of one row, all its columns."""
    names = ["source", "target_share", "max_repeats"]

    def serialise(frames):
        for frame in frames:
            frame["block"] = [chunking.table_text(names, [row]) for row in frame[names].values.tolist()]
            yield frame[["source", "block"]]

    rows = t.table(spark, d, "mix_targets").select("source", *(F.col(c).cast("string") for c in names[1:])).fillna("")
    return rows.mapInPandas(serialise, "source string, block string")


def prompt_hash(spark, d):
    rows = t.table(spark, d, "catalogue")
    return rows.select("id", F.sha2(F.concat(F.coalesce("name", F.lit("")), F.coalesce("description", F.lit(""))), 256).alias("digest"))


def html_to_text(spark, d):
    rows = t.table(spark, d, "parsed_documents").groupBy("parsed_id").agg(F.max("content").alias("content"))
    pages = rows.where(F.col("content").rlike(r"(?i)<(html|body|p|h[1-6]|table|ul|div)\b"))
    return docs.html_text(pages, "parsed_id", "content")


QUERIES = {f.__name__: f for f in (
    token_counts, sentence_counts, empty_documents, plain_chunks, padded_text, section_groups, chunk_context, chunk_summaries, taxonomy_infer,
    excluded_taxonomies, agentic_filter, agentic_documents, variant_collapse, expansion_graph, crossmap_normalise, mapping_counts,
    cleaned_descriptions, risk_text, table_serialise, prompt_hash, html_to_text,
)}

_PHRASES = " OR ".join(f"contains(lower(text), '{p}')" for p in X.AGENTIC_PHRASES)
_CONTENT = "doc AS (SELECT parsed_id, max(content) AS content FROM parsed_documents GROUP BY parsed_id)"
_LINKS = "link AS (" + " UNION ALL ".join(f"SELECT id, '{m.removesuffix('_mappings')}' AS predicate, unnest({m}) AS target FROM catalogue" for m in cat.MAPPINGS) + ")"
_OWN = " ".join(f"WHEN starts_with(id, '{p}') THEN '{p.rstrip('-')}'" for p in ("civic-scale-", "harbour-list-", "lantern-", "mlr-2-", "tessera-group-"))
_PUBLISHED = " ".join(f"WHEN starts_with(id, '{p}') THEN '{n}'" for p, n in X.TAXONOMY_PREFIXES)
CROSS = f"""{_LINKS},
side AS (
  SELECT l.id, l.target, a.isdefinedbytaxonomy = '{HOME}' AS h, b.isdefinedbytaxonomy = '{HOME}' AS k
  FROM link l JOIN catalogue a ON a.id = l.id JOIN catalogue b ON b.id = l.target),
cross_ids AS (SELECT DISTINCT CASE WHEN h THEN target ELSE id END AS risk_id, CASE WHEN h THEN id ELSE target END AS home_id FROM side WHERE h <> k)"""
EDGES = f"""{_LINKS},
both_ways AS (
  SELECT a.id AS src, b.id AS dst FROM catalogue a JOIN catalogue b ON a.ispartof = b.ispartof
  UNION SELECT id, target FROM link UNION SELECT target, id FROM link),
edge AS (SELECT DISTINCT src, dst FROM both_ways WHERE src <> dst AND src IN (SELECT id FROM catalogue) AND dst IN (SELECT id FROM catalogue))"""
SQL = {
    "token_counts": f"SELECT doc_id, len({t.tokens_sql('text')}) AS n_tokens FROM documents WHERE text IS NOT NULL",
    "sentence_counts": f"SELECT doc_id, len({t.sentences_sql('text')}) AS n_sentences FROM documents WHERE text IS NOT NULL",
    "empty_documents": f"WITH {_CONTENT} SELECT parsed_id FROM doc WHERE coalesce(trim(content, ' '), '') = ''",
    "plain_chunks": f"""
WITH RECURSIVE {_CONTENT},
cut AS (
  SELECT parsed_id, content, CAST(0 AS BIGINT) AS pos, CAST(-1 AS BIGINT) AS chunk_index, CAST(NULL AS VARCHAR) AS piece FROM doc WHERE content IS NOT NULL
  UNION ALL
  SELECT parsed_id, content, pos + length(p), chunk_index + 1, p FROM (
    SELECT parsed_id, content, pos, chunk_index,
      CASE WHEN length(content) <= 2048 THEN content
           WHEN pos + 2048 >= length(content) THEN substr(content, pos + 1)
           WHEN length(regexp_extract(substr(content, pos + 2, 2047), '[^\n]*$')) < 2047
             THEN substr(content, pos + 1, 2048 - length(regexp_extract(substr(content, pos + 2, 2047), '[^\n]*$')))
           ELSE substr(content, pos + 1, 2048) END AS p
    FROM cut WHERE pos < length(content) OR chunk_index = -1))
SELECT parsed_id, chunk_index, length(piece) AS n_chars, md5(piece) AS digest FROM cut WHERE chunk_index >= 0""",
    "padded_text": f"""
WITH {t.CHUNKS},
near AS (
  SELECT *, lag(text) OVER w AS prev, lead(text) OVER w AS nxt FROM chunk WINDOW w AS (PARTITION BY source ORDER BY chunk_index)),
cut AS (SELECT *, {t.sentences_sql('prev')} AS p, {t.sentences_sql('nxt')} AS n FROM near)
SELECT chunk_id, md5(array_to_string(list_concat(list_concat(coalesce(p[-2:], []), [text]), coalesce(n[1:2], [])), ' ')) AS digest
FROM cut WHERE text IS NOT NULL""",
    "section_groups": f"""
WITH {t.CHUNKS},
fill AS (SELECT *, last_value(section IGNORE NULLS) OVER (PARTITION BY source ORDER BY chunk_index ROWS UNBOUNDED PRECEDING) AS s FROM chunk),
flag AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 1 WHEN lag(s) OVER w IS NOT DISTINCT FROM s THEN 0 ELSE 1 END AS f FROM fill WINDOW w AS (PARTITION BY source ORDER BY chunk_index)),
runs AS (SELECT *, sum(f) OVER (PARTITION BY source ORDER BY chunk_index ROWS UNBOUNDED PRECEDING) AS run FROM flag)
SELECT chunk_id, CAST(run AS BIGINT) AS run, CAST((row_number() OVER (PARTITION BY source, run ORDER BY chunk_index) - 1) // 5 AS BIGINT) AS part FROM runs""",
    "chunk_summaries": f"""
WITH {t.CANDIDATES}
SELECT source, chunk_index, count(*) AS retrieved, count(*) FILTER (decision = 'accepted') AS accepted, count(*) FILTER (starts_with(decision, 'borderline')) AS borderline,
  coalesce(string_agg(DISTINCT risk_id, ',' ORDER BY risk_id) FILTER (decision = 'accepted'), '') AS accepted_ids
FROM cand GROUP BY source, chunk_index""",
    "taxonomy_infer": f"SELECT id, CASE {_OWN} ELSE 'unknown' END AS inferred, CASE {_PUBLISHED} ELSE 'unknown' END AS published FROM catalogue",
    "excluded_taxonomies": "SELECT isdefinedbytaxonomy, count(*) AS n FROM catalogue WHERE isdefinedbytaxonomy NOT IN ('mlr-2', 'lantern') GROUP BY 1",
    "agentic_filter": f"""
SELECT id, risk_type FROM catalogue WHERE risk_type IS DISTINCT FROM 'agentic' OR (SELECT coalesce(bool_or({_PHRASES}), false) FROM documents)""",
    "agentic_documents": f"SELECT doc_id, ({_PHRASES}) AS speaks FROM documents WHERE text IS NOT NULL",
    "variant_collapse": r"""
WITH part AS (SELECT id, coalesce(name, '') AS name, coalesce(description, '') AS description, nullif(regexp_extract(id, '^(.*)---', 1), '') AS parent_id FROM catalogue),
fam AS (
  SELECT parent_id, regexp_replace(min_by(name, id), ' - [^-]*$', '') AS head, count(*) AS n,
    string_agg(DISTINCT substr(id, length(parent_id) + 4), ', ' ORDER BY substr(id, length(parent_id) + 4)) AS labels
  FROM part WHERE parent_id IS NOT NULL GROUP BY parent_id)
SELECT id, name, description, coalesce(fam.n, 0) AS n_variants FROM part LEFT JOIN fam ON fam.parent_id = part.id WHERE part.parent_id IS NULL
UNION ALL
SELECT parent_id, head || ' (' || n || ' variants)', labels, n FROM fam WHERE parent_id NOT IN (SELECT id FROM part WHERE parent_id IS NULL)""",
    "expansion_graph": f"WITH {EDGES} SELECT src, dst FROM edge",
    "crossmap_normalise": f"WITH {CROSS} SELECT risk_id, home_id FROM cross_ids",
    "mapping_counts": f"WITH {_LINKS} SELECT id, predicate, count(*) AS n FROM link GROUP BY id, predicate",
    "cleaned_descriptions": "SELECT id, CASE WHEN name || description IS NULL THEN '' ELSE description END AS clean FROM catalogue",
    "risk_text": "SELECT id, concat_ws('. ', name, nullif(substr(description, 1, 300), ''), nullif(substr(concern, 1, 200), '')) AS text FROM catalogue",
    "table_serialise": """
SELECT source, concat_ws(chr(10), '<!-- table -->', '', '```', 'source: ' || source, 'target_share: ' || coalesce(CAST(target_share AS VARCHAR), ''),
  'max_repeats: ' || coalesce(CAST(max_repeats AS VARCHAR), ''), '```', '', '<!-- /table -->') AS block FROM mix_targets""",
    "prompt_hash": "SELECT id, sha256(coalesce(name, '') || coalesce(description, '')) AS digest FROM catalogue",
}
