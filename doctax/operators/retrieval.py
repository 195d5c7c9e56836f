"""Lexical and dense retrieval, fusion and rescue."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import finite, rrf_term
from ..functions.text import tokens

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Terms times entries up to which the index is a matrix in every task (8 bytes a cell).
MATRIX_CELLS = 8_000_000
#: Vectors in a block of the dense search.
CORPUS_BLOCK, QUERY_BLOCK = 8192, 1024


def corpus_of(entries: DataFrame) -> DataFrame:
    """``(id, text)`` of catalogue entries: name and description."""
    return entries.select("id", F.concat(F.coalesce("name", F.lit("")), F.lit(": "), F.coalesce("description", F.lit(""))).alias("text"))


def postings(corpus: DataFrame) -> DataFrame:
    """``(id, term, tf, dl)``."""
    words = corpus.select("id", tokens(F.col("text")).alias("w"))
    return words.select("id", F.size("w").cast("bigint").alias("dl"), F.explode("w").alias("term")).groupBy("id", "term", "dl").agg(F.count("*").alias("tf"))


def idf(corpus: DataFrame) -> DataFrame:
    """``(term, df, idf)``: ln(N - df + 0.5) - ln(df + 0.5); where that is negative, a quarter of the mean over all terms."""
    size = corpus.agg(F.count("*").alias("n"))
    df = postings(corpus).groupBy("term").agg(F.count("*").alias("df"))
    raw = df.crossJoin(F.broadcast(size)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25_index(corpus: DataFrame) -> DataFrame:
    """``(term, id, w)``: what a word of a query adds to an entry's score."""
    posts = postings(corpus)
    mean = corpus.select(F.size(tokens(F.col("text"))).alias("n")).agg(F.avg("n").alias("avgdl"))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return posts.join(idf(corpus), "term").crossJoin(F.broadcast(mean)).select("term", "id", weight.alias("w"))


def bm25(corpus: DataFrame, queries: DataFrame, top: int, matrix_cells: int = MATRIX_CELLS) -> DataFrame:
    """``(query_id, id, score, place)`` of the best ``top`` entries with a positive score; ties go to the smaller id.

    ``queries`` has ``query_id, text``. A word that a query repeats counts each time. The index is counted first:
    where terms times entries stay within ``matrix_cells``, as for a catalogue, it goes to the tasks as a matrix and
    queries are scored in blocks by one product each, without a shuffle. Beyond, words of queries are joined
    with postings. Scores are rounded to 6 digits before they are ranked.
    """
    index = bm25_index(corpus).persist()
    shape = index.agg(F.countDistinct("term").alias("t"), F.countDistinct("id").alias("e")).first()
    if shape.t * shape.e <= matrix_cells:
        rows = index.toArrow()
        index.unpersist()
        return _bm25_matrix(rows, queries, top)
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("n"))
    scored = asked.join(index, "term").groupBy("query_id", "id").agg(F.round(F.sum(F.col("n") * F.col("w")), 6).alias("score")).where("score > 0")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return scored.withColumn("place", F.row_number().over(place).cast("bigint")).where(F.col("place") <= top)


def _bm25_matrix(index: pa.Table, queries: DataFrame, top: int) -> DataFrame:
    terms, ids = sorted(set(index.column("term").to_pylist())), sorted(set(index.column("id").to_pylist()))
    at, of = {t: k for k, t in enumerate(terms)}, {i: k for k, i in enumerate(ids)}
    weights = np.zeros((len(terms), len(ids)))
    rows = [at[t] for t in index.column("term").to_pylist()], [of[i] for i in index.column("id").to_pylist()]
    weights[rows] = index.column("w").to_numpy()
    shared = queries.sparkSession.sparkContext.broadcast((terms, ids, weights))
    key = dict(queries.dtypes)["query_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, ids, weights = shared.value
        known, names = pa.array(terms, pa.string()), pa.array(ids, pa.string())
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                words = part.column("words").fill_null([])
                term = pc.index_in(words.flatten(), value_set=known)
                row = pc.list_parent_indices(words)
                there = pc.is_valid(term).to_numpy(zero_copy_only=False)
                flat = row.to_numpy()[there] * len(terms) + term.drop_null().to_numpy().astype(np.int64)
                counts = np.bincount(flat, minlength=part.num_rows * len(terms)).reshape(part.num_rows, -1)
                score = np.round(counts.astype(np.float64) @ weights, 6) if len(terms) else np.zeros((part.num_rows, 0))
                order = np.argsort(-score, axis=1, kind="stable")[:, :top]  # entries stand by id: ties keep that order
                best = np.take_along_axis(score, order, axis=1)
                q, k = np.nonzero(best > 0)
                columns = [part.column("query_id").take(pa.array(q)), names.take(pa.array(order[q, k])), pa.array(best[q, k]), pa.array(k.astype(np.int64) + 1)]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "id", "score", "place"])

    return queries.select("query_id", tokens(F.col("text")).alias("words")).mapInArrow(run, f"query_id {key}, id string, score double, place bigint")


def unit(vector) -> F.Column:
    """The vector over its length; a vector of length 0 stays."""
    values = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda n, x: n + x * x))
    return F.transform(values, lambda x: x / F.when(norm > 0, norm).otherwise(F.lit(1.0)))


def dot(a, b) -> F.Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda n, x: n + x)


def _blocks(df: DataFrame, key: str, size: int) -> DataFrame:
    """Rows packed into blocks ``(ids, matrix)`` of unit vectors, task by task."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                rows = np.array(part.column("v").to_pylist(), dtype=np.float64).reshape(part.num_rows, -1)
                norm = np.linalg.norm(rows, axis=1, keepdims=True)
                rows = rows / np.where(norm > 0, norm, 1.0)
                ids = np.array(part.column("id").to_numpy(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([rows.tobytes()], pa.binary())], [f"{key}_ids", f"{key}_rows"])

    return df.mapInArrow(pack, f"{key}_ids binary, {key}_rows binary")


def dense(corpus: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """``(query_id, id, similarity, place)``: the ``top`` entries of the highest cosine; ties go to the smaller id.

    Both sides have ``id, v``; null vectors fall away. Query blocks meet corpus blocks: each pair is one matrix
    product of which only the ``top`` per query leave the task. Similarities are rounded to 6 digits.
    """
    left = _blocks(corpus.where("v is not null"), "c", CORPUS_BLOCK)
    right = _blocks(queries.where("v is not null"), "q", QUERY_BLOCK)

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values in batch.to_pylist():
                ids, asked = np.frombuffer(values["c_ids"], np.int64), np.frombuffer(values["q_ids"], np.int64)
                rows = np.frombuffer(values["c_rows"]).reshape(len(ids), -1)
                wanted = np.frombuffer(values["q_rows"]).reshape(len(asked), -1)
                score = np.round(wanted @ rows.T, 6) + 0.0
                order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :top]
                columns = (np.repeat(asked, order.shape[1]), ids[order].ravel(), np.take_along_axis(score, order, 1).ravel())
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "id", "similarity"])

    found = left.crossJoin(right).mapInArrow(product, "query_id bigint, id bigint, similarity double")
    place = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("id"))
    return found.withColumn("place", F.row_number().over(place).cast("bigint")).where(F.col("place") <= top)


def maxsim(texts: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, id, score)``: for each token vector of a query the best cosine in the text, summed, by the query's tokens.

    Both sides have ``id, tokens`` (array of vectors). The cost is that of all token pairs: meant for a small side of queries.
    """
    q = queries.select(F.col("id").alias("query_id"), F.transform("tokens", unit).alias("qt"))
    d = texts.select("id", F.transform("tokens", unit).alias("dt"))
    best = F.transform("qt", lambda x: F.array_max(F.transform("dt", lambda y: dot(x, y))))
    score = F.aggregate(best, F.lit(0.0), lambda n, x: n + x) / F.size("qt")
    return q.crossJoin(d).select("query_id", "id", score.alias("score"))


def late_interaction(texts: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """The ``top`` texts of a query by ``maxsim`` with a positive score, rounded to 5 digits: ``(query_id, id, score, place)``."""
    scored = maxsim(texts, queries).withColumn("score", F.round("score", 5)).where("score > 0")
    return best(scored, ["query_id"], "score", "id", top)


def hybrid_late(lexical: DataFrame, late: DataFrame, keys: list[str], id_col: str, top: int = 10, rescue_rank: int = 0) -> DataFrame:
    """BM25 and late interaction fused: the ``top`` by the sum of reciprocal ranks, with the late score as ``cross_encoder_score`` (0 if it has none).

    ``lexical`` has ``bm25_rank``, ``late`` ``score`` and ``place``. What BM25 ranks up to ``rescue_rank`` is added if it was lost.
    """
    a = lexical.where("bm25_rank > 0").select(*keys, id_col, F.col("bm25_rank").cast("bigint").alias("bm25_rank"))
    b = late.where("score > 0").select(*keys, id_col, "score", F.col("place").cast("bigint").alias("late_rank"))
    fused = a.join(b, [*keys, id_col], "full_outer").withColumn("rrf", F.round(rrf_term(F.col("bm25_rank")) + rrf_term(F.col("late_rank")), 6))
    order = Window.partitionBy(*keys).orderBy(F.desc("rrf"), F.asc(id_col))
    placed = fused.withColumn("place", F.row_number().over(order).cast("bigint"))
    rescued = F.coalesce(F.col("bm25_rank") <= rescue_rank, F.lit(False))
    kept = placed.where((F.col("place") <= top) | rescued)
    return kept.select(*keys, id_col, "bm25_rank", "rrf", F.coalesce("score", F.lit(0.0)).alias("cross_encoder_score"), (F.col("place") > top).alias("rescued"))


def ranked_lists(candidates: DataFrame, keys: list[str], id_col: str, top: int = 100) -> DataFrame:
    """Candidates with ``lexical_rank`` (``bm25_rank`` above 0) and ``dense_rank`` (place by distance), each up to ``top``.

    Only the first ``top`` of a group are ordered: Spark cuts each task's rows to them before the shuffle, so that a
    group of any size costs little.
    """
    near = candidates.withColumn("__d", finite(F.col("embedding_distance"))).where("__d is not null")
    place = Window.partitionBy(*keys).orderBy(F.asc("__d"), F.asc(id_col))
    near = near.withColumn("dense_rank", F.row_number().over(place).cast("bigint")).where(F.col("dense_rank") <= top).select(id_col, "dense_rank")
    lexical = F.when((F.col("bm25_rank") > 0) & (F.col("bm25_rank") <= top), F.col("bm25_rank").cast("bigint"))
    return candidates.withColumn("lexical_rank", lexical).join(near, id_col, "left")


def rrf_fuse(candidates: DataFrame, keys: list[str], id_col: str, top: int = 100) -> DataFrame:
    """Candidates in either list with ``rrf``, the sum of the reciprocals of 60 plus the rank, rounded to 6 digits."""
    listed = ranked_lists(candidates, keys, id_col, top).where("lexical_rank is not null or dense_rank is not null")
    return listed.withColumn("rrf", F.round(rrf_term(F.col("lexical_rank")) + rrf_term(F.col("dense_rank")), 6))


def best(df: DataFrame, keys: list[str], score: str, id_col: str, top: int, place: str = "place") -> DataFrame:
    """The first ``top`` of each group by score, ties to the smaller id; null scores come last."""
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(score), F.asc(id_col))
    return df.withColumn(place, F.row_number().over(order).cast("bigint")).where(F.col(place) <= top)


def hybrid(candidates: DataFrame, keys: list[str], id_col: str, top: int = 10, floor: float = 0.0) -> DataFrame:
    """The fused list cut to twice ``top``; with a floor what reaches it, else reranked by the cross-encoder.

    Reranking cuts to ``top`` before scores that aren't finite are dropped.
    """
    fused = best(rrf_fuse(candidates, keys, id_col), keys, "rrf", id_col, 2 * top, "fused_place")
    if floor > 0:
        return fused.where(F.col("rrf") >= floor).withColumn("place", F.col("fused_place")).where(F.col("place") <= top)
    scored = fused.withColumn("__score", finite(F.col("cross_encoder_score")))
    return best(scored, keys, "__score", id_col, top).where("__score is not null").drop("__score")


def reranked(scored: DataFrame, keys: list[str], id_col: str, top: int, rescue_rank: int = 0) -> DataFrame:
    """Scored candidates of the fused list cut to the ``top`` of each group by the cross-encoder, with their ``place``.

    The cut comes before scores that aren't finite are dropped; what BM25 ranks up to ``rescue_rank`` stays.
    """
    marked = scored.withColumn("__score", finite(F.col("cross_encoder_score")))
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("__score"), F.asc(id_col))
    rescued = F.coalesce(F.col("lexical_rank") <= rescue_rank, F.lit(False))
    kept = (F.col("place") <= top) & F.col("__score").isNotNull()
    return marked.withColumn("place", F.row_number().over(order).cast("bigint")).where(kept | rescued).drop("__score")


def rescue(candidates: DataFrame, keys: list[str], id_col: str, top: int = 10, rescue_rank: int = 5) -> DataFrame:
    """Reranked candidates and those of the fused list that BM25 ranks up to ``rescue_rank`` but reranking lost."""
    fused = best(rrf_fuse(candidates, keys, id_col), keys, "rrf", id_col, 2 * top, "fused_place")
    scored = fused.withColumn("__score", finite(F.col("cross_encoder_score")))
    kept = best(scored, keys, "__score", id_col, top).where("__score is not null")
    lost = fused.where(F.col("lexical_rank") <= rescue_rank).join(kept.select(id_col), id_col, "left_anti")
    return kept.select(*keys, id_col, "rrf", F.lit(False).alias("rescued")).unionByName(lost.select(*keys, id_col, "rrf", F.lit(True).alias("rescued")))
