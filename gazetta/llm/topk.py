"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Vectors become sparse rows of integer weights: floor(scale * x). Rows and
queries are dealt into blocks. A task takes one block of each, walks the
dimensions one by one, scatters every query's weight times the postings of
that dimension into a dense array of scores, and selects each query's best.
The blocks' winners are merged per query. Work is queries times rows;
memory is a block of each.

Vectors that are null, or hold null or non-finite components, and rows with
a null id take no part. Vectors of different lengths meet in the dimensions
they share. Queries that share an id count once, with the smallest of their
vectors; rows with a query's own id are never its candidates. Ids are numbers. Components are expected to fit integers: the sums
are 64-bit.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazetta.session import stash


def _accumulated(queries: list[np.ndarray], rows: list[np.ndarray]) -> np.ndarray:
    """Scores of every query against every row, dimension by dimension."""
    width = max((len(v) for v in rows), default=0)
    dense = np.zeros((width, len(rows)), np.int64)
    for j, v in enumerate(rows):
        dense[: len(v), j] = v
    weights = np.zeros((len(queries), width), np.int64)
    for i, v in enumerate(queries):
        weights[i, : min(width, len(v))] = v[:width]
    # Sums below 2**53 are exact in doubles, which multiply faster.
    exact = width * float(np.abs(dense).max(initial=0)) * float(np.abs(weights).max(initial=0)) < 2**53
    kind = np.float64 if exact else np.int64
    dense, weights = dense.astype(kind), weights.astype(kind)
    scores = np.zeros((len(queries), len(rows)), kind)
    for term in range(width):
        holders, posted = np.flatnonzero(weights[:, term]), np.flatnonzero(dense[term])
        if len(holders) == len(queries) and len(posted) == len(rows):
            scores += np.multiply.outer(weights[:, term], dense[term])
        elif len(holders) and len(posted):
            scores[np.ix_(holders, posted)] += np.multiply.outer(weights[holders, term], dense[term, posted])
    return scores.astype(np.int64)


def _best(k: int, step: int = 128):
    def run(q: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if q.empty or rows.empty:  # an empty side has no columns
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        rows = rows.sort_values("vec_id", kind="stable")
        ids, vectors = rows["vec_id"].to_numpy(np.int64), [np.asarray(v) for v in rows["w"]]
        out = []
        for at in range(0, len(q), step):
            part = q.iloc[at : at + step]
            scores = _accumulated([np.asarray(v) for v in part["w"]], vectors)
            for query, line in zip(part["query_id"], scores, strict=True):
                free = np.flatnonzero(ids != query)
                if len(free) > k:
                    line_free = line[free]
                    cut = np.partition(line_free, len(free) - k)[len(free) - k]
                    # Ids ascend, so of the scores at the cut the first are the smallest ids.
                    over, tied = free[line_free > cut], free[line_free == cut]
                    free = np.concatenate([over, tied[: k - len(over)]])
                out += [(query, int(ids[j]), int(line[j])) for j in free]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = 4096, row_block: int = 4096, least_blocks: int = 24) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest scores, ties to the smaller id."""

    def weights(df: DataFrame) -> DataFrame:
        v = F.col(vector_col)
        sound = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
        whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
        return df.where(F.col(id_col).isNotNull() & v.isNotNull()).where(sound).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("w"))

    rows = weights(vectors)
    asked = stash(weights(queries).withColumnRenamed("vec_id", "query_id").groupBy("query_id").agg(F.min("w").alias("w")))
    n_q = max(1, math.ceil(asked.count() / query_block))
    n_r = max(least_blocks, math.ceil(rows.count() / row_block))
    # Every block of rows meets every block of queries.
    rows = rows.withColumn("r", (F.monotonically_increasing_id() % n_r).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    asked = asked.withColumn("q", F.pmod(F.xxhash64("query_id"), F.lit(n_q)).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(n_r - 1))))
    # A stated number of partitions is not coalesced, so blocks spread over all tasks.
    parts = 4 * n_q * n_r
    asked, rows = asked.repartition(parts, "q", "r"), rows.repartition(parts, "q", "r")
    found = asked.groupBy("q", "r").cogroup(rows.groupBy("q", "r")).applyInPandas(_best(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
