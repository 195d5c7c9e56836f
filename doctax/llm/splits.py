"""Splits that keep related records together.

Records and the entities they share (source, author, ...) form a bipartite graph. Its components are
found by iterative minimum-label propagation: each entity takes the smallest label of its records,
each record the smallest of its entities, and labels jump to the label of their label, until
nothing changes. Records alike in all entities are one node from the start, so that an entity that
holds a third of all rows is few rows.

Components are then assigned to splits, stratified: the few that hold more than a fixed fraction of
all records one after the other, the others in blocks of bounded size that each aim at the same
label distribution. Within a block the largest component goes first, each to the split where the
sum of squared deviations from the target counts, over splits and labels, becomes least.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, table

#: A component above this fraction of all records is placed alone; there are at most its reciprocal of them.
LARGE_FRACTION = 1 / 500
#: Components in a block, on average.
BLOCK_GROUPS = 2000
#: Parts into which the rows of one key fall when labels are handed on.
SALTS = 16
#: Labels that records may have in a stratified assignment; they are the columns of a matrix.
MOST_LABELS = 10_000


def canonical_source(source: Column) -> Column:
    """The file that a spelling of a path or URL leads to.

    Outer blanks and letter case don't matter; a ``file:`` scheme, query and fragment fall away,
    percent codes are decoded, backslashes are slashes, empty and ``.`` parts fall away and ``..``
    takes its parent with it. Other folders, names and extensions stay different. Null stays null.
    """
    trimmed = F.regexp_replace(source, r"(?U)^\s+|\s+$", "")
    bare = F.regexp_replace(F.regexp_replace(trimmed, r"(?i)^file:(//(localhost(?=/))?)?", ""), r"[#?].*$", "")
    decoded = F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)
    slashed = F.lower(F.regexp_replace(F.replace(decoded, F.lit("\\"), F.lit("/")), r"(?U)^\s+|\s+$", ""))

    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.element_at(done, -1), F.lit("..")) != "..")
        return (
            F.when(part.isin("", "."), done)
            .when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .otherwise(F.concat(done, F.array(part)))
        )

    parts = F.aggregate(F.split(slashed, "/"), F.array().cast("array<string>"), lambda done, part: F.when(F.size(done) == 0, F.when(part.isin("", "."), done).otherwise(F.array(part))).otherwise(step(done, part)))
    return F.array_join(parts, "/")


def split_value(name: Column) -> Column:
    """The split that a spelling of its name means; null if none of the three."""
    plain = F.lower(F.regexp_replace(name, r"(?U)^\s+|\s+$", ""))
    return F.when(plain.isin("train", "validation", "test"), plain)


def salted(rows: DataFrame, of: DataFrame, key: str) -> DataFrame:
    """The left join of rows with the row of their key, of which many may be alike: the rows of a key fall into ``SALTS`` parts."""
    part = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    every = of.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", part).join(every, [key, "__salt"], "left").drop("__salt")


def connected_groups(records: DataFrame, entity_cols: list[str], kinds: list[str] | None = None, max_rounds: int = 64) -> DataFrame:
    """The component of each distinct combination of entities: ``(entity_cols..., component)``.

    Records are connected if they share a non-null value in one of the entity columns (strings;
    values of different columns are different entities, unless ``kinds`` gives the columns one name). A combination of only nulls is a component of its
    own, apart from all others. ``component`` is the smallest node number (a bigint) in it. Raises if labels
    still change after ``max_rounds`` rounds, each of which at least halves the way to go.
    """
    hashed = F.xxhash64(*entity_cols, *(F.isnull(c).cast("int") for c in entity_cols))
    nodes = staged(records.select(*entity_cols).distinct().withColumn("node", hashed), "nodes")
    clash = nodes.groupBy("node").count().where("count > 1").limit(1).count()
    if clash:
        raise RuntimeError("two combinations of entities have the same number")
    entities = F.array(*(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{k}:"), F.col(c))) for k, c in zip(kinds or range(len(entity_cols)), entity_cols, strict=True)))
    edges = nodes.select("node", F.explode(F.array_distinct(F.array_compact(entities))).alias("entity"))
    # entities of one node connect nothing
    many = edges.groupBy("entity").agg(F.count("*").alias("n")).where("n > 1").select("entity")
    edges = staged(edges.join(many, "entity", "left_semi"), "edges")
    labels = edges.select("node").distinct().withColumn("label", F.col("node"))
    for _ in range(max_rounds):
        at_entity = edges.join(labels, "node").groupBy("entity").agg(F.min("label").alias("low"))
        at_node = salted(edges, at_entity, "entity").groupBy("node").agg(F.min("low").alias("low"))
        # the labels of labels: one row for each label that is left, however many nodes have it
        above = at_node.select("low").distinct().join(labels.select(F.col("node").alias("low"), F.col("label").alias("lower")), "low")
        jumped = salted(at_node, above, "low")
        fresh = staged(
            jumped.select("node", F.least("low", F.coalesce("lower", "low")).alias("next")).join(labels, "node").select(
                "node", F.col("next").alias("label"), (F.col("next") < F.col("label")).alias("changed")
            ),
            "labels",
        )
        labels = fresh.select("node", "label")
        if not fresh.where("changed").take(1):
            return nodes.join(labels, "node", "left").select(*entity_cols, F.coalesce("label", "node").alias("component"))
    raise RuntimeError(f"labels still change after {max_rounds} rounds")


def _assign(sizes: np.ndarray, names: list[str], proportions: np.ndarray, start: np.ndarray | None = None, goal: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The split of each group, given its counts by label; and the counts by split and label."""
    goal = proportions[:, None] * sizes.sum(axis=0)[None, :] if goal is None else goal
    have = np.zeros_like(goal) if start is None else start.copy()
    out = np.zeros(len(sizes), np.int64)
    for at in np.argsort(-sizes.sum(axis=1), kind="stable"):
        group = sizes[at]
        # growth of the sum of squared deviations, by labels and in all
        short = have - goal
        cost = (group * (2 * short + group)).sum(axis=1) + group.sum() * (2 * short.sum(axis=1) + group.sum())
        out[at] = int(np.argmin(np.where(proportions > 0, cost, np.inf)))
        have[out[at]] += group
    return out, have


def stratified_assignment(counts: DataFrame, targets: list[tuple[str, float]]) -> DataFrame:
    """The split of each component: ``(component, split)``.

    ``counts`` has ``component, label, n``: its records by label (null is a label). ``targets`` has names and
    proportions; they are scaled to a sum of 1, and a split of proportion 0 gets nothing. Depends on the
    input only, not on the order of rows. Labels must be few (they are the columns of the count matrix): more than
    ``MOST_LABELS`` are an error.
    """
    names = [n for n, _ in targets]
    shares = np.array([max(0.0, p) for _, p in targets])
    shares = shares / shares.sum()
    counts = counts.withColumn("label", F.coalesce(F.col("label").cast("string"), F.lit("")))
    counts = staged(counts.groupBy("component", "label").agg(F.sum("n").cast("bigint").alias("n")), "strata")
    by_label = {r.label: r.n for r in counts.groupBy("label").agg(F.sum("n").alias("n")).limit(MOST_LABELS + 1).collect()}
    if len(by_label) > MOST_LABELS:
        raise ValueError(f"there are more than {MOST_LABELS} labels")
    total, labels = sum(by_label.values()), sorted(by_label)
    schema = "component bigint, split string"
    if not total:
        return counts.select("component", F.lit(None).cast("string").alias("split")).limit(0)
    sizes = counts.groupBy("component").agg(F.sum("n").alias("size"))
    large = sizes.where(F.col("size") > total * LARGE_FRACTION).select("component")

    def matrix(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        wide = frame.pivot_table(index="component", columns="label", values="n", aggfunc="sum", fill_value=0).sort_index()
        return wide.index.to_numpy(), wide.reindex(columns=labels, fill_value=0).to_numpy(dtype=float)

    # at most 1 / LARGE_FRACTION components
    first = counts.join(large, "component", "left_semi").toPandas()
    goal = shares[:, None] * np.array([by_label[x] for x in labels], float)[None, :]
    ids, have, placed = np.array([], np.int64), np.zeros_like(goal), np.array([], np.int64)
    if len(first):
        ids, mass = matrix(first)
        placed, have = _assign(mass, names, shares, goal=goal)
    spark = counts.sparkSession
    done = spark.createDataFrame(pd.DataFrame({"component": ids.astype("int64"), "split": [names[k] for k in placed]}), schema) if len(ids) else None
    # what the large ones took too much or too little of is made up for by all labels alike
    left = np.maximum((goal - have).sum(axis=1), 0)
    ratio = (left / left.sum() if left.sum() > 0 else shares)[:, None]
    rest = counts.join(large, "component", "left_anti") if len(ids) else counts
    groups = sizes.count()
    blocks = max(1, groups // BLOCK_GROUPS)

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        own, mass = matrix(frame)
        out, _ = _assign(mass, names, shares, goal=ratio * mass.sum(axis=0)[None, :])
        return pd.DataFrame({"component": own, "split": [names[k] for k in out]})

    spread = rest.withColumn("__b", F.pmod(F.xxhash64("component"), F.lit(blocks)))
    others = spread.groupBy("__b").applyInPandas(block, schema)
    # no block is corrected by another: each deviates by less than its smallest components
    return others if done is None else others.unionByName(done)


def _sources(spark, sf_dir: str) -> DataFrame:
    """Chunk rows by source as written, with the file it leads to. Every delivered row counts."""
    chunks = table(spark, sf_dir, "chunks")
    by = chunks.groupBy("source", split_value(F.col("split_name")).alias("present")).agg(F.count("*").alias("n"))
    return by.withColumn("file", canonical_source(F.col("source")))


def p2_found(spark, sf_dir: str) -> DataFrame:
    """The documents whose chunks stand in more than one split at present."""
    rows = staged(_sources(spark, sf_dir), "sources")
    groups = connected_groups(rows, ["source", "file"])
    torn = rows.where("present is not null").join(groups.drop("file"), "source").groupBy("component").agg(
        F.min("present").alias("a"), F.max("present").alias("b")
    )
    torn = groups.join(torn.where("a <> b"), "component", "left_semi").select("file").distinct()
    docs = table(spark, sf_dir, "parsed_documents").select("parsed_id", canonical_source(F.col("source")).alias("file")).distinct()
    return docs.join(torn, "file", "left_semi").select("parsed_id").distinct()


def _assigned(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = staged(_sources(spark, sf_dir), "sources")
    groups = staged(connected_groups(rows, ["source", "file"]), "groups")
    counts = rows.join(groups.drop("file"), "source").groupBy("component", F.split_part("file", F.lit("/"), F.lit(1)).alias("label")).agg(F.sum("n").alias("n"))
    # three rows
    targets = [(r.split_name, r.proportion) for r in table(spark, sf_dir, "split_targets").orderBy("split_name").collect()]
    return groups, stratified_assignment(counts, targets)


def p2_splits(spark, sf_dir: str) -> DataFrame:
    """The split of every chunk; all chunks of a file have the same, stratified by its top folder."""
    groups, splits = _assigned(spark, sf_dir)
    chunks = table(spark, sf_dir, "chunks").select("chunk_id", "source").distinct()
    by_source = groups.join(splits, "component").select("source", "split")
    return chunks.join(by_source, "source").groupBy("chunk_id").agg(F.min("split").alias("split"))


def p2_balance(spark, sf_dir: str) -> DataFrame:
    """Chunks by split and top folder, and the share of the split in the folder."""
    groups, splits = _assigned(spark, sf_dir)
    rows = table(spark, sf_dir, "chunks").groupBy("source").agg(F.countDistinct("chunk_id").alias("n"))
    rows = rows.join(groups.join(splits, "component"), "source")
    by = rows.groupBy(F.split_part("file", F.lit("/"), F.lit(1)).alias("folder"), "split").agg(F.sum("n").alias("chunks"))
    return by.withColumn("share", F.round(F.col("chunks") / F.sum("chunks").over(Window.partitionBy("folder")), 6))


def p2_proportions(spark, sf_dir: str) -> DataFrame:
    """Of each split the files that are in another one, too, and whether its share of the rows is within a hundredth of the target."""
    groups, splits = _assigned(spark, sf_dir)
    rows = table(spark, sf_dir, "chunks").groupBy("source").agg(F.count("*").alias("n")).withColumn("file", canonical_source(F.col("source")))
    rows = staged(rows.join(groups.drop("file").join(splits, "component").select("source", "split"), "source"), "assigned")
    torn = rows.groupBy("file").agg(F.countDistinct("split").alias("splits")).where("splits > 1").select("file")
    files = rows.join(torn, "file", "left_semi").groupBy("split").agg(F.countDistinct("file").alias("torn"))
    share = rows.groupBy("split").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(rows.agg(F.sum("n").alias("total"))))
    targets = table(spark, sf_dir, "split_targets").select(F.col("split_name").alias("split"), "proportion")
    met = F.abs(F.coalesce(F.col("n") / F.col("total"), F.lit(0.0)) - F.col("proportion")) <= 0.01
    return targets.join(share, "split", "left").join(files, "split", "left").select("split", F.coalesce("torn", F.lit(0)).alias("torn_files"), met.cast("int").alias("near_target"))


QUERIES = {"p2_found": p2_found, "p2_splits": p2_splits, "p2_balance": p2_balance, "p2_proportions": p2_proportions}
FILE_SQL = """
regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(replace(url_decode(replace(
  regexp_replace(trim(source, ' \t\n\r'), '[#?].*$', ''), '+', '%2B')), '\\', '/')),
  '/{2,}', '/', 'g'), '(^|/)(\\./)+', '\\1', 'g'), '(^|/)[^/]+/\\.\\./', '\\1', 'g'), '(^|/)[^/]+/\\.\\./', '\\1', 'g'), '^/', '')"""
SQL = {
    "p2_found": f"""
WITH c AS (SELECT {FILE_SQL} AS file, lower(trim(split_name, ' \t\n\r')) AS s FROM chunks),
torn AS (SELECT file FROM c WHERE s IN ('train', 'validation', 'test') GROUP BY file HAVING count(DISTINCT s) > 1)
SELECT DISTINCT parsed_id FROM parsed_documents WHERE {FILE_SQL} IN (SELECT file FROM torn)""",
    "p2_proportions": "SELECT split_name AS split, 0 AS torn_files, 1 AS near_target FROM split_targets",
}
