"""Vectors in shards and queries in blocks: the frame shared by the two searches.

Rows are dealt to shards of about ``shard_rows`` by a hash of their id, and each
shard becomes one row holding its index as bytes. Queries are packed into blocks
likewise. In a search some blocks meet some shards as a cogroup, so a task holds at most ``TOGETHER``
of each, whatever the table's size, and hands on the k best of a query. No row is unfolded into a join:
Spark does not count what an explode multiplies, and would broadcast such a side.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HITS = "query_id long, vec_id long, score double, exact long"
#: Blocks, and shards, that meet in one task at most.
TOGETHER = 16


def finite(vector: Column) -> Column:
    """True for a vector that is there, not empty and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


def unique_rows(ids: np.ndarray, rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Ids ascending and their vectors; of rows that share an id the lexicographically least stays."""
    m = np.stack(rows)
    order = np.lexsort((*m.T[::-1], ids))
    ids, m = ids[order], m[order]
    first = np.ones(len(ids), bool)
    first[1:] = ids[1:] != ids[:-1]
    return ids[first], m[first]


def pack(rows: DataFrame, key: str, parts: int, build: Callable[[np.ndarray, np.ndarray], bytes]) -> DataFrame:
    """``rows(vec_id, v)`` as one row per (length of v, part): ``dim, <key>, blob``."""

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, m = unique_rows(pdf["vec_id"].to_numpy(np.int64), list(pdf["v"]))
        return pd.DataFrame({"dim": [m.shape[1]], key: [int(pdf[key].iloc[0])], "blob": [build(ids, m)]})

    dealt = rows.select("vec_id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias(key))
    return dealt.groupBy("dim", key).applyInPandas(each, f"dim int, {key} int, blob binary")


def parts_of(rows: int, each: int) -> int:
    return max(1, math.ceil(rows / each))


def search(blocks: DataFrame, shards: DataFrame, n_blocks: int, low: int, high: int, scan: Callable, k: int, score: str) -> DataFrame:
    """Every block against the shards ``low`` to ``high - 1``: of the rows that ``scan(block, shard)`` returns the k best by ``score`` of each query and group of shards."""
    n = high - low
    across = -(-n_blocks // TOGETHER)
    # as few copies of the queries as keep the task slots busy
    down = max(-(-n // TOGETHER), min(n, -(-4 * blocks.sparkSession.sparkContext.defaultParallelism // across)))
    copies = lambda parts, name: F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias(name)
    left = shards.where((F.col("shard") >= low) & (F.col("shard") < high)).select("dim", ((F.col("shard") - low) % down).alias("y"), copies(across, "x"), "blob")
    right = blocks.select("dim", (F.col("block") % across).alias("x"), copies(down, "y"), "blob")

    def each(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = [pickle.loads(x) for x in held["blob"]]
        out = [best_rows(pd.concat([scan(queries, x) for x in found]), k, score) for queries in map(pickle.loads, asked["blob"] if found else [])]
        return pd.concat(out) if out else pd.DataFrame({c: np.empty(0, np.int64) for c in ("query_id", "vec_id", "score", "exact")})

    dealt = [x.repartition(across * down, "dim", "x", "y").groupBy("dim", "x", "y") for x in (left, right)]
    return dealt[0].cogroup(dealt[1]).applyInPandas(each, HITS)


def best_rows(hits: pd.DataFrame, k: int, score: str) -> pd.DataFrame:
    """The k best of ``hits`` for each query by ``score`` falling, then ``vec_id``."""
    by, of = hits[score].to_numpy(), hits["query_id"].to_numpy()
    order = np.lexsort((hits["vec_id"].to_numpy(), ~by if by.dtype.kind == "i" else -by, of))
    first = np.flatnonzero(np.diff(of[order], prepend=of[order[:1]] - 1))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
    return hits.iloc[order[rank < k]]


def ranked(hits: DataFrame, k: int, score: str) -> DataFrame:
    """The k best hits of each query by ``score`` falling, then ``vec_id``, with their rank."""
    best = Window.partitionBy("query_id").orderBy(F.col(score).desc(), F.col("vec_id"))
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def merge(scores: np.ndarray, ids: np.ndarray, more: np.ndarray, more_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two sets of hits per row, best first, ties to the smaller id."""
    s, i = np.concatenate((scores, more), 1), np.concatenate((ids, more_ids), 1)
    falling = ~s if s.dtype.kind == "i" else -s  # the least integer has no negative
    order = np.lexsort((i, falling), axis=1)[:, :k]
    return np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
