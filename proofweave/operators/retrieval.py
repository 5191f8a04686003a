"""Ranking: BM25, cosine, reciprocal-rank fusion.

Queries are a stated set held against all rows. Defined results: an empty corpus or query set gives no rows;
texts without tokens count in the corpus size and mean length but never match; ties go to the smaller id;
scores are compared after rounding to nine digits so that the order of summation cannot decide a rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofweave.operators import skew

K1, B = 1.5, 0.75
#: Bytes of the query terms up to which they are broadcast.
BROADCAST_BYTES = 32 << 20
#: Cells of a matrix that a task holds at once (8 bytes each), and tokens of documents that it scores at once.
CELLS, TOKENS = 4_000_000, 100_000
#: Documents of a term from which the join by term splits it.
HOT_TERM = 100_000
#: Query vectors that are sent to the tasks at once.
VECTORS_AT_ONCE = 16_384


def term_counts(docs: DataFrame, words: Column, key: str = "doc_id") -> DataFrame:
    """``key, term, tf, dl`` of every document: distinct terms are counted inside the row's array, without a
    shuffle of single tokens."""
    held = docs.select(key, words.alias("w")).withColumn("dl", F.size("w"))
    each = held.select(key, "dl", "w", F.explode(F.array_distinct("w")).alias("term"))
    return each.select(key, "term", (F.col("dl") - F.size(F.array_remove("w", F.col("term")))).alias("tf"), "dl")


def bm25_stats(docs: DataFrame, words: Column) -> DataFrame:
    """``term, df, idf`` of the corpus."""
    sets = docs.select(F.array_distinct(words).alias("w"))
    n = F.lit(docs.count())
    df = sets.select(F.explode("w").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.select("term", "df", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def bm25_top(queries: DataFrame, docs: DataFrame, query_words: Column, doc_words: Column, k: int = 25, k1: float = K1, b: float = B, by_matrix: bool | None = None) -> DataFrame:
    """``query_id, doc_id, rnk, score`` for ``queries(query_id, ...)`` and ``docs(doc_id, ...)``.

    A repeated query token adds again. If the query terms are within :data:`BROADCAST_BYTES` (checked), their
    weights go to the tasks as sparse rows, and every batch of documents is scored in one scan: the terms it
    holds make a small matrix, of whose product with the queries, block by block, only the best rows of each
    query are shuffled. Beyond that bound documents and queries are joined by term, frequent terms in pieces by
    their exact count. ``by_matrix`` forces one of the two in tests.
    """
    asked = queries.select("query_id", F.explode(query_words).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("m"))
    held = docs.select("doc_id", doc_words.alias("w"))
    shape = held.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("w")).alias("mean")).first()
    n, mean = shape["n"], float(shape["mean"] or 1.0)
    if by_matrix is None:
        by_matrix = 0 < asked.agg(F.coalesce(F.sum(F.octet_length("term") + 32), F.lit(0)).alias("b")).first()["b"] <= BROADCAST_BYTES
    wanted = asked.select("term").distinct()
    if by_matrix:
        wanted = F.broadcast(wanted)
    df = held.select(F.explode(F.array_distinct("w")).alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(df, "term").select("query_id", "term", (F.col("m") * idf * (k1 + 1)).alias("weight"))
    if by_matrix:
        scored = _scored_by_matrix(weighed, held, k, k1, b, mean)
    else:
        part = F.col("weight") * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.greatest("dl", F.lit(1)) / F.lit(mean)))
        hot = skew.hot_keys(df, ["term"], HOT_TERM, "df")
        counted, asked_ = skew.salted(term_counts(docs, doc_words), hot, ["term"], F.col("doc_id")), skew.repeated(weighed, hot, ["term"])
        scored = counted.join(asked_, ["term", "salt"]).groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 9).alias("score")).where("score > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rnk", F.row_number().over(order).cast("long")).where(F.col("rnk") <= k).select("query_id", "doc_id", "rnk", "score")


def _scored_by_matrix(weighed: DataFrame, held: DataFrame, k: int, k1: float, b: float, mean: float) -> DataFrame:
    """``query_id, doc_id, score``: of every batch of documents the best ``k`` of each query, ties included."""
    kinds = {f.name: f.dataType.simpleString() for f in weighed.schema} | {f.name: f.dataType.simpleString() for f in held.schema}
    local = weighed.toPandas().sort_values(["term", "query_id"], ignore_index=True)  # within BROADCAST_BYTES
    terms, starts = np.unique(local["term"].to_numpy(object), return_index=True)
    names, query = np.unique(local["query_id"].to_numpy(object), return_inverse=True)
    sent = held.sparkSession.sparkContext.broadcast((list(names), list(terms), np.append(starts, len(local)), query, local["weight"].to_numpy(float)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, terms, starts, query, weight = sent.value
        table, ids = pa.array(terms, pa.string()), pa.array(names)
        if not len(terms):
            return
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOKENS, "right")), at + 1)
                yield from _score_batch(batch.slice(at, to - at), table, ids, starts, query, weight, k, k1, b, mean)
                at = to

    return held.mapInArrow(score, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double")


def _score_batch(batch: pa.RecordBatch, table: pa.Array, ids: pa.Array, starts: np.ndarray, query: np.ndarray, weight: np.ndarray, k: int, k1: float, b: float, mean: float) -> Iterator[pa.RecordBatch]:
    lists = batch.column(1)
    offsets = np.asarray(lists.offsets, np.int64) - lists.offsets[0].as_py()
    length = np.diff(offsets)
    term = np.asarray(pc.fill_null(pc.index_in(lists.flatten(), value_set=table), -1), np.int64)
    row = np.repeat(np.arange(len(length)), length)[term >= 0]
    cell, tf = np.unique(row * len(table) + term[term >= 0], return_counts=True)
    row, present = cell // len(table), cell % len(table)
    here, column = np.unique(present, return_inverse=True)
    if not len(here):
        return
    held = np.zeros((len(length), len(here)))
    held[row, column] = tf / (tf + k1 * (1 - b + b * np.maximum(length[row], 1) / mean))
    # Postings of the terms that the batch holds.
    many = starts[here + 1] - starts[here]
    posting = np.repeat(starts[here] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    line, asked, value = np.repeat(np.arange(len(here)), many), query[posting], weight[posting]
    wide = max(1, CELLS // max(len(here), len(length)))
    for first in range(0, len(ids), wide):
        own = (asked >= first) & (asked < first + wide)
        matrix = np.zeros((len(here), min(wide, len(ids) - first)))
        matrix[line[own], asked[own] - first] = value[own]
        scores = np.round(held @ matrix, 9)
        least = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k] if len(scores) > k else np.zeros(scores.shape[1])
        doc, found = np.nonzero((scores >= least) & (scores > 0))
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(found + first)), batch.column(0).take(pa.array(doc)), pa.array(scores[doc, found])], names=["query_id", "doc_id", "score"])


def cosine_top(queries: DataFrame, vectors: DataFrame, k: int = 25, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, vec_id, rnk, sim``: nearest vectors by cosine, zero vectors at similarity 0.

    Query vectors go to the tasks in blocks of bounded size; every batch keeps its own best ``k`` per query,
    so only ``k`` rows a batch and query are shuffled.
    """
    n_blocks = -(-queries.count() // VECTORS_AT_ONCE)
    out = None
    for k_ in range(max(n_blocks, 1)):
        block = queries.where(F.pmod(F.xxhash64(key), F.lit(n_blocks)) == k_) if n_blocks > 1 else queries
        part = _cosine_block(block, vectors, k, key, vector)
        out = part if out is None else out.unionByName(part)
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm == 0, 1, norm)


def _cosine_block(queries: DataFrame, vectors: DataFrame, k: int, key: str, vector: str) -> DataFrame:
    local = queries.select(key, vector).where(F.col(vector).isNotNull()).toPandas()
    names = local[key].to_numpy()
    matrix = _unit(np.stack([np.asarray(v, np.float64) for v in local[vector]])) if len(local) else np.empty((0, 1))
    sent = vectors.sparkSession.sparkContext.broadcast((names, matrix))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = sent.value
        for batch in batches:
            held = [(i, v) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if v is not None]
            if not held or not len(names):
                continue
            rows = np.asarray([i for i, _ in held])
            sims = np.round(_unit(np.asarray([v for _, v in held], np.float64)) @ matrix.T, 9)
            keep = np.lexsort((np.broadcast_to(rows[:, None], sims.shape), -sims), axis=0)[:k] if len(rows) > k else np.tile(np.arange(len(rows))[:, None], (1, len(names)))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(names, len(keep))), pa.array(rows[keep].ravel()), pa.array(np.take_along_axis(sims, keep, 0).ravel())], names=["query_id", key, "sim"])

    near = vectors.select(key, vector).mapInArrow(score, f"query_id long, {key} long, sim double")
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), key)
    return near.withColumn("rnk", F.row_number().over(order).cast("long")).where(F.col("rnk") <= k).select("query_id", key, "rnk", "sim")


def fuse(ranked: list[DataFrame], k: int = 60, top: int = 25) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists ``query_id, doc_id, rnk``: ``query_id, doc_id, rnk, score``.
    Ties go to the better rank in the first list, then the second, and so on, then to the smaller id."""
    both = None
    for i, one in enumerate(ranked):
        part = one.select("query_id", "doc_id", F.lit(i).alias("list"), "rnk")
        both = part if both is None else both.unionByName(part)
    first = [F.coalesce(F.min(F.when(F.col("list") == i, F.col("rnk"))), F.lit(1 << 40)).alias(f"r{i}") for i in range(len(ranked))]
    summed = both.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (k + F.col("rnk"))), 12).alias("score"), *first)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *[f"r{i}" for i in range(len(ranked))], "doc_id")
    return summed.withColumn("n", F.row_number().over(order).cast("long")).where(F.col("n") <= top).select("query_id", "doc_id", F.col("n").alias("rnk"), "score")
