"""Exact top-k vector search for batches of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from reelspark.session import parallelism

#: Queries scored against a batch of vectors in one product.
QUERY_BLOCK = 512


def _score(k: int, cosine: bool):
    def unit(m: np.ndarray) -> np.ndarray:
        if not cosine:
            return m
        length = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(length > 0, length, np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A row is one block of vectors with one block of queries.
            for ids, vectors, names, queries in zip(*(batch.column(i) for i in range(4))):
                ids, names = ids.values, names.values
                x = np.array(vectors.values.flatten()).reshape(len(ids), -1).astype(np.float64)
                q = np.array(queries.values.flatten()).reshape(len(names), -1).astype(np.float64)
                scores = np.round(unit(q) @ unit(x).T, 9)
                best = min(k, len(ids))
                for i in range(len(names)):
                    row = np.where(np.isnan(scores[i]), -np.inf, scores[i])
                    edge = -np.partition(-row, best - 1)[best - 1]
                    keep = np.flatnonzero((row >= edge) & (row > -np.inf))  # with all ties at the edge
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(names[i], len(keep)), ids.take(pa.array(keep)), pa.array(row[keep])], names=["query_id", "item_id", "score"]
                    )

    return run


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", block: int = 2_048) -> DataFrame:
    """Rows (query_id, item_id, score, rank): the ``k`` best of ``vectors`` for every query, without loss.

    ``vectors`` has (item_id, vector), ``queries`` (query_id, vector), ids are whole numbers
    or strings; both may be of any size: each side is cut into blocks, every block of vectors meets every block
    of queries, one matrix product scores a pair and only its k best per query (with ties)
    go on. Ties are settled by the smaller item. ``metric`` is cosine or dot; scores are
    rounded to 9 digits. Null vectors take no part, nor do zero vectors under cosine.
    """
    if metric not in ("cosine", "dot") or k < 1:
        raise ValueError("metric must be cosine or dot, k at least 1")
    vectors, queries = vectors.where("vector is not null and item_id is not null"), queries.where("vector is not null and query_id is not null")
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    by_query = queries.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).alias("qb")).agg(
        F.collect_list(F.struct("query_id", "vector")).alias("q")
    )
    # Blocks of vectors form within partitions, before anything is exchanged.
    numbered = vectors.select("item_id", "vector", F.floor(F.monotonically_increasing_id() / block).alias("vb"))
    by_block = numbered.groupBy("vb").agg(F.collect_list(F.struct("item_id", "vector")).alias("v"))
    # Pairs of blocks spread over ``lanes`` tasks for every block of queries, also if there is only one.
    lanes = parallelism(vectors)
    count = lambda n: F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))
    left = by_block.withColumn("lane", F.pmod("vb", F.lit(lanes))).withColumn("qb", F.explode(count(n_blocks)))
    pairs = left.join(by_query.withColumn("lane", F.explode(count(lanes))), ["qb", "lane"])
    flat = pairs.select(F.col("v.item_id"), F.col("v.vector").alias("vectors"), F.col("q.query_id"), F.col("q.vector").alias("queries"))
    kinds = [queries.schema["query_id"].dataType.simpleString(), vectors.schema["item_id"].dataType.simpleString()]
    scored = flat.mapInArrow(_score(k, metric == "cosine"), f"query_id {kinds[0]}, item_id {kinds[1]}, score double")
    place = F.row_number().over(W.Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))
    return scored.withColumn("rank", place).where(F.col("rank") <= k)
