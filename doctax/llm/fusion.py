"""One ranking from several differently scaled scores: outranking net flow on percentiles.

Within its group each score becomes a mid-rank percentile, so its scale is gone. For two items a
preference function of the percentile difference says how much one is preferred: 0 up to the
indifference threshold ``q``, 1 from the preference threshold ``p`` on, linear between. An item's
flow in a score is the mean preference for it minus the mean preference against it, over all items
of the group; the net flow is the weighted mean over the scores. Flows are exact, without pairs:
counts and sums of percentiles up to a threshold are differences of sorted prefix sums.

Groups up to ``LIGHT_ROWS`` rows are computed many at a time, vectorised, after one shuffle on the
group. Larger ones stay spread: distinct values are counted first, and the prefix sums run over
ranges of values (``prefix.running_sums``). Both give the same flows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dense_groups, staged, table
from .prefix import running_sums

LIGHT_ROWS = 200_000
#: Rows of light groups that are computed in one go.
BLOCK_ROWS = 200_000
#: Thresholds of the preference function, as percentile differences.
INDIFFERENCE, PREFERENCE = 0.05, 0.5


def percentiles(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mid-rank percentiles for rows sorted by (group, value): x, size of the row's group, its start, its number."""
    first = np.concatenate([[True], group[1:] != group[:-1]])
    starts = np.flatnonzero(first)
    number = np.cumsum(first) - 1
    sizes = np.diff(np.append(starts, len(group)))
    tie = first | np.concatenate([[True], value[1:] != value[:-1]])
    run = np.flatnonzero(tie)
    length = np.diff(np.append(run, len(group)))
    which = np.cumsum(tie) - 1
    below = run[which] - starts[number]
    size = sizes[number]
    x = np.where(size > 1, (below + (length[which] - 1) / 2) / np.maximum(size - 1, 1), 0.5)
    return x, size, starts[number], number


def flows(group: np.ndarray, value: np.ndarray, q: float = INDIFFERENCE, p: float = PREFERENCE) -> np.ndarray:
    """The flow of each row in one score, over all groups at once; 0 where the value is missing (NaN)."""
    out = np.zeros(len(value))
    there = np.flatnonzero(~np.isnan(value))
    order = there[np.lexsort((value[there], group[there]))]
    if not len(order):
        return out
    x, size, start, number = percentiles(group[order], value[order])
    key = number * 4.0 + x
    total = np.concatenate([[0.0], np.cumsum(x)])
    base = number * 4.0

    def upto(t: np.ndarray, side: str) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(key, base + t, side)
        return at - start, total[at] - total[start]

    (n_p, s_p), (n_q, s_q) = upto(x - p, "right"), upto(x - q, "left")
    favour = n_p + ((n_q - n_p) * (x - q) - (s_q - s_p)) / (p - q)
    (m_q, t_q), (m_p, t_p) = upto(x + q, "right"), upto(x + p, "left")
    against = (size - m_p) + ((t_p - t_q) - (m_p - m_q) * (x + q)) / (p - q)
    out[order] = np.where(size > 1, (favour - against) / np.maximum(size - 1, 1), 0.0)
    return out


def _light(df: DataFrame, group_cols: list[str], id_col: str, scores: dict[str, float], q: float, p: float) -> DataFrame:
    weights = sum(scores.values())

    def solve(rows: pa.Table) -> pa.RecordBatch:
        group, _ = dense_groups([rows.column(c) for c in group_cols])
        net = np.zeros(rows.num_rows)
        for name, weight in scores.items():
            value = rows.column(name).cast(pa.float64()).to_numpy()  # null becomes NaN
            net += weight / weights * flows(group, value, q, p)
        net = np.round(net, 9) + 0.0
        order = np.lexsort((rows.column(id_col).to_numpy(), -net, group))
        ranked = group[order]
        first = np.searchsorted(ranked, ranked, "left")
        place = np.empty(len(net), np.int64)
        place[order] = np.arange(len(net)) - first + 1
        return rows.append_column("net_flow", pa.array(net)).append_column("place", pa.array(place)).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count > BLOCK_ROWS:
                rows = pa.Table.from_batches(held)
                last = [rows.column(c)[-1] for c in group_cols]
                group, _ = dense_groups([rows.column(c) for c in group_cols])
                cut = int(np.flatnonzero(group != group[-1])[-1]) + 1 if (group != group[-1]).any() else 0
                if cut and last:
                    yield from solve(rows.slice(0, cut))
                    held = rows.slice(cut).to_batches()
                    count = rows.num_rows - cut
        if held:
            yield from solve(pa.Table.from_batches(held))

    schema = T.StructType([*df.schema.fields, T.StructField("net_flow", T.DoubleType(), False), T.StructField("place", T.LongType(), False)])
    return df.repartition(*group_cols).sortWithinPartitions(*group_cols).mapInArrow(run, schema)


def _heavy(df: DataFrame, group_cols: list[str], id_col: str, scores: dict[str, float], q: float, p: float) -> DataFrame:
    keys = [*group_cols, "__score"]
    long = df.select(
        *group_cols, id_col, F.explode(F.array(*(F.struct(F.lit(n).alias("s"), F.col(n).alias("v")) for n in scores))).alias("e")
    ).select(*group_cols, id_col, F.col("e.s").alias("__score"), F.col("e.v").alias("__v")).where("__v is not null and not isnan(__v)")
    values = long.groupBy(*keys, "__v").agg(F.count("*").alias("__n"))
    sizes = values.groupBy(*keys).agg(F.sum("__n").alias("__m"))
    values = running_sums(values, keys, ["__v"], {"__c": "__n"}).join(sizes, keys)
    spread = F.greatest(F.col("__m") - 1, F.lit(1))
    values = values.withColumn(
        "__x", F.when(F.col("__m") > 1, (F.col("__c") - F.col("__n") + (F.col("__n") - 1) / 2) / spread).otherwise(F.lit(0.5))
    )
    # thresholds come between the values: those asked "up to, without" before equal ones, "up to, with" after
    asks = F.array(
        F.struct(F.lit("p").alias("a"), (F.col("__x") - p).alias("t"), F.lit(2).alias("o")),
        F.struct(F.lit("q").alias("a"), (F.col("__x") - q).alias("t"), F.lit(0).alias("o")),
        F.struct(F.lit("Q").alias("a"), (F.col("__x") + q).alias("t"), F.lit(2).alias("o")),
        F.struct(F.lit("P").alias("a"), (F.col("__x") + p).alias("t"), F.lit(0).alias("o")),
        F.struct(F.lit("-").alias("a"), F.col("__x").alias("t"), F.lit(1).alias("o")),
    )
    points = values.select(*keys, "__v", "__n", "__x", "__m", F.explode(asks).alias("k")).select(
        *keys, "__v", "__x", "__m", F.col("k.a").alias("__a"), F.col("k.t").alias("__t"), F.col("k.o").alias("__o"),
        F.when(F.col("k.a") == "-", F.col("__n")).otherwise(F.lit(0)).alias("__n"),
    ).withColumn("__s", F.col("__n") * F.col("__x"))
    summed = running_sums(points, keys, ["__t", "__o", "__v", "__a"], {"__cn": "__n", "__cs": "__s"}).where("__a <> '-'")
    of = lambda a, c: F.max(F.when(F.col("__a") == a, F.col(c))).alias(f"{c}_{ord(a)}")
    wide = summed.groupBy(*keys, "__v", "__x", "__m").agg(*(of(a, c) for a in "pqQP" for c in ("__cn", "__cs")))
    n = {a: F.col(f"__cn_{ord(a)}") for a in "pqQP"}
    s = {a: F.col(f"__cs_{ord(a)}") for a in "pqQP"}
    x, m = F.col("__x"), F.col("__m")
    favour = n["p"] + ((n["q"] - n["p"]) * (x - q) - (s["q"] - s["p"])) / (p - q)
    against = (m - n["P"]) + ((s["P"] - s["Q"]) - (n["P"] - n["Q"]) * (x + q)) / (p - q)
    weight = reduce(lambda c, kv: F.when(F.col("__score") == kv[0], F.lit(kv[1] / sum(scores.values()))).otherwise(c), scores.items(), F.lit(0.0))
    flow = wide.select(*keys, "__v", (weight * F.when(m > 1, (favour - against) / (m - 1)).otherwise(F.lit(0.0))).alias("__f"))
    net = long.join(flow, [*keys, "__v"]).groupBy(*group_cols, id_col).agg((F.round(F.sum("__f"), 9) + 0.0).alias("net_flow"))
    return df.join(net, [*group_cols, id_col], "left").fillna(0.0, ["net_flow"]).select(*df.columns, "net_flow")


def outranking(
    df: DataFrame,
    group_cols: list[str],
    id_col: str,
    scores: dict[str, float],
    q: float = INDIFFERENCE,
    p: float = PREFERENCE,
    light_rows: int = LIGHT_ROWS,
) -> DataFrame:
    """``df`` with ``net_flow`` in [-1, 1] and ``place`` (1 is best) of each row within its group.

    ``scores`` names the score columns and their weights; larger values must be better. A null, NaN
    or infinite value is unknown: the row has flow 0 in that score and isn't compared there. A group
    of one row has flow 0. Equal values share a percentile. Flows are rounded to 9 digits; equal
    flows are ordered by ``id_col``. Ids must be unique within a group; group columns null-free.
    """
    clean = df
    for name in scores:
        v = F.col(name).cast("double")
        clean = clean.withColumn(name, F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v))
    clean = staged(clean, "scored")
    heavy_keys = staged(clean.groupBy(*group_cols).agg(F.count("*").alias("n")).where(F.col("n") > light_rows).select(*group_cols), "heavy")
    if not heavy_keys.take(1):
        return _light(clean, group_cols, id_col, scores, q, p)
    light = _light(clean.join(heavy_keys, group_cols, "left_anti"), group_cols, id_col, scores, q, p)
    heavy = _heavy(clean.join(heavy_keys, group_cols, "left_semi"), group_cols, id_col, scores, q, p)
    order = heavy.withColumn("__minus", -F.col("net_flow")).withColumn("__one", F.lit(1))
    heavy = running_sums(order, group_cols, ["__minus", id_col], {"place": "__one"}).drop("__minus", "__one")
    return light.unionByName(heavy)


SCORES = {"bm25": 1.0, "dense": 1.0, "cross": 1.0, "rrf": 1.0}


def _oriented(candidates: DataFrame) -> DataFrame:
    """Standing rows with scores turned so that more is better; an item that BM25 didn't rank is below all it ranked."""
    rank = F.col("bm25_rank")
    key = F.max(F.struct("scored_at", "ingested_at", "cross_encoder_score", "source", "chunk_index", "bm25_rank", "embedding_distance", "rrf_score"))
    rows = candidates.groupBy("candidate_id").agg(key.alias("r")).select("candidate_id", "r.*")
    return rows.select(
        "source", "chunk_index", "candidate_id",
        F.when(rank > 0, -rank.cast("double")).otherwise(F.lit(-1e9)).alias("bm25"),
        (-F.col("embedding_distance")).alias("dense"),
        F.col("cross_encoder_score").alias("cross"),
        F.col("rrf_score").alias("rrf"),
    )


def p5_ranking(spark, sf_dir: str) -> DataFrame:
    """Net flow and place of every standing candidate in its chunk result."""
    rows = _oriented(table(spark, sf_dir, "candidates"))
    return outranking(rows, ["source", "chunk_index"], "candidate_id", SCORES).select(
        "source", "chunk_index", "candidate_id", "net_flow", "place"
    )


def p5_relevance(spark, sf_dir: str) -> DataFrame:
    """Mean net flow of the judged candidates, by verdict (the last verdict of a candidate counts)."""
    verdicts = table(spark, sf_dir, "judge_verdicts").groupBy("candidate_id").agg(
        F.max_by("relevant", F.struct("judged_at", "relevant")).alias("relevant")
    )
    joined = p5_ranking(spark, sf_dir).join(verdicts, "candidate_id")
    return joined.groupBy("relevant").agg(F.count("*").alias("candidates"), F.round(F.avg("net_flow"), 6).alias("mean_net_flow"))


QUERIES = {"p5_ranking": p5_ranking, "p5_relevance": p5_relevance}

_P = lambda d: f"least(greatest(({d} - {INDIFFERENCE}) / ({PREFERENCE} - {INDIFFERENCE}), 0.0), 1.0)"
_RANKED = f"""
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY scored_at DESC, ingested_at DESC) AS v FROM candidates) WHERE v = 1),
score AS (
  SELECT source, chunk_index, candidate_id, unnest(['bm25', 'dense', 'cross', 'rrf']) AS s,
    unnest([CASE WHEN bm25_rank > 0 THEN -bm25_rank::DOUBLE ELSE -1e9 END, -embedding_distance, cross_encoder_score, rrf_score]) AS v FROM latest),
known AS (SELECT * FROM score WHERE v IS NOT NULL AND isfinite(v)),
part AS (
  SELECT *, count(*) OVER g AS m, rank() OVER (PARTITION BY source, chunk_index, s ORDER BY v) - 1 AS below, count(*) OVER (PARTITION BY source, chunk_index, s, v) AS n
  FROM known WINDOW g AS (PARTITION BY source, chunk_index, s)),
spot AS (SELECT *, CASE WHEN m > 1 THEN (below + (n - 1) / 2.0::DOUBLE) / (m - 1) ELSE 0.5 END AS x FROM part),
value AS (SELECT source, chunk_index, s, x, m, count(*) AS n FROM spot GROUP BY ALL),
flow AS (
  SELECT a.source, a.chunk_index, a.s, a.x, sum(b.n * ({_P('(a.x - b.x)')} - {_P('(b.x - a.x)')})) / greatest(a.m - 1, 1) AS f
  FROM value a JOIN value b ON a.source = b.source AND a.chunk_index = b.chunk_index AND a.s = b.s GROUP BY a.source, a.chunk_index, a.s, a.x, a.m),
net AS (SELECT spot.candidate_id, sum(f) / 4 AS net_flow FROM spot JOIN flow USING (source, chunk_index, s, x) GROUP BY spot.candidate_id),
ranked AS (SELECT source, chunk_index, candidate_id, round(coalesce(net_flow, 0.0), 9) + 0.0 AS net_flow FROM latest LEFT JOIN net USING (candidate_id))"""
SQL = {
    "p5_ranking": f"""
WITH {_RANKED}
SELECT source, chunk_index, candidate_id, net_flow, row_number() OVER (PARTITION BY source, chunk_index ORDER BY net_flow DESC, candidate_id) AS place FROM ranked""",
    "p5_relevance": f"""
WITH {_RANKED},
verdict AS (SELECT candidate_id, relevant FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY judged_at DESC, relevant DESC) AS v FROM judge_verdicts) WHERE v = 1)
SELECT relevant, count(*) AS candidates, round(avg(net_flow), 6) AS mean_net_flow FROM ranked JOIN verdict USING (candidate_id) GROUP BY relevant""",
}
