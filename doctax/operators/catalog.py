"""The catalogue: exclusion, pruning, variant collapse and its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import speaks_of_agents, variant_parent

MAPPINGS = ("exact_mappings", "close_mappings", "broad_mappings", "narrow_mappings", "related_mappings")
#: Taxonomies that aren't searched.
EXCLUDED_TAXONOMIES = (
    "mit-ai-risk-repository-causal", "ibm-granite-guardian", "nist-ai-rmf", "owasp-llm-2.0", "ailuminate-v1.0", "owasp-asi", "shieldgemma-taxonomy",
)


def without_taxonomies(catalogue: DataFrame, excluded: tuple[str, ...] = EXCLUDED_TAXONOMIES) -> DataFrame:
    return catalogue.where(~F.col("isdefinedbytaxonomy").isin(*excluded))


def prune_agentic(catalogue: DataFrame, documents: DataFrame, text_col: str = "text") -> DataFrame:
    """The catalogue without agentic entries, unless a document speaks of agents."""
    speaks = documents.agg(F.coalesce(F.bool_or(speaks_of_agents(F.col(text_col))), F.lit(False)).alias("__agents"))
    kept = ~F.col("risk_type").eqNullSafe("agentic") | F.col("__agents")
    return catalogue.crossJoin(F.broadcast(speaks)).where(kept).drop("__agents")


def variants(catalogue: DataFrame) -> DataFrame:
    """Bridge ``(parent_id, risk_id)`` of entries that are variants."""
    return catalogue.select(variant_parent(F.col("id")).alias("parent_id"), F.col("id").alias("risk_id")).where("parent_id is not null")


def collapse_variants(catalogue: DataFrame) -> DataFrame:
    """Entries that aren't variants, and one for each family: ``(id, name, description, n_variants)``.

    A family's name is that of its first variant by id before the last `` - ``, with the number of variants; its
    description lists the sorted labels. A parent that is an entry itself keeps its own name and
    description, so that ids stay unique. Null names and descriptions are empty.
    """
    parts = catalogue.select(
        "id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("description", F.lit("")).alias("description"), variant_parent(F.col("id")).alias("parent_id")
    )
    family = parts.where("parent_id is not null").withColumn("label", F.expr("substring(id, length(parent_id) + 4)"))
    head = F.regexp_replace(F.min_by("name", "id"), r" - [^-]*$", "")
    grouped = family.groupBy("parent_id").agg(head.alias("head"), F.array_sort(F.collect_set("label")).alias("labels"), F.count("*").alias("n_variants"))
    own = parts.where("parent_id is null").drop("parent_id").join(grouped.select(F.col("parent_id").alias("id"), "n_variants"), "id", "left")
    fresh = grouped.join(own.select(F.col("id").alias("parent_id")), "parent_id", "left_anti")
    named = fresh.select(
        F.col("parent_id").alias("id"), F.concat("head", F.lit(" ("), "n_variants", F.lit(" variants)")).alias("name"), F.array_join("labels", ", ").alias("description"), "n_variants"
    )
    return own.select("id", "name", "description", F.coalesce("n_variants", F.lit(0)).cast("bigint").alias("n_variants")).unionByName(named)


def mapping_links(catalogue: DataFrame) -> DataFrame:
    """All mappings as rows ``(id, predicate, target)``; null and empty lists give none, nor do columns that the catalogue hasn't."""
    none = F.array().cast("array<string>")
    kinds = [F.struct(F.lit(m.removesuffix("_mappings")).alias("predicate"), (F.coalesce(F.col(m), none) if m in catalogue.columns else none).alias("targets")) for m in MAPPINGS]
    return catalogue.select("id", F.explode(F.array(*kinds)).alias("m")).select("id", "m.predicate", F.explode("m.targets").alias("target"))


def expansion_edges(catalogue: DataFrame) -> DataFrame:
    """``(src, dst)`` of siblings under one parent and of mappings in either direction; both ends are in the catalogue."""
    member = catalogue.select(F.col("id").alias("src"), "ispartof").where("ispartof is not null")
    sibling = member.join(member.select(F.col("src").alias("dst"), "ispartof"), "ispartof").select("src", "dst")
    links = mapping_links(catalogue).select(F.col("id").alias("src"), F.col("target").alias("dst"))
    both = sibling.unionByName(links).unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    known = catalogue.select(F.col("id").alias("dst"))
    return both.where("src <> dst").distinct().join(known, "dst", "left_semi").join(known.withColumnRenamed("dst", "src"), "src", "left_semi").select("src", "dst")


def crosswalk(catalogue: DataFrame, home: str) -> DataFrame:
    """``(risk_id, home_id)``: mappings between the home taxonomy and others, whichever side states them; home to home falls away."""
    of = catalogue.select("id", (F.col("isdefinedbytaxonomy") == home).alias("is_home"))
    links = mapping_links(catalogue).join(of, "id").join(of.select(F.col("id").alias("target"), F.col("is_home").alias("to_home")), "target")
    links = links.where(F.col("is_home") != F.col("to_home"))
    risk = F.when(F.col("is_home"), F.col("target")).otherwise(F.col("id"))
    home_id = F.when(F.col("is_home"), F.col("id")).otherwise(F.col("target"))
    return links.select(risk.alias("risk_id"), home_id.alias("home_id")).distinct()
