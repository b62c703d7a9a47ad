"""Exact top-k by inner product over integer vectors: a KD-tree per shard.

A tree splits at the median of its widest side down to leaves of some tens of
rows; every node keeps the tight box of its rows. For a query q the best score in
a box is the sum over dimensions of max(q * low, q * high). The search is
best-first: each query opens the node with the best bound next and stops when that
bound falls below its kth score. All queries of a block advance together, one node
each per step, so the work is matrix work.

Shards are searched in three waves (one shard, about the square root of their
number, the rest). Between waves the kth score that each query has found is
carried along and prunes whole subtrees of the later shards.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shards as S
from .common import materialize, session

LEAF_ROWS = 64
NONE = np.iinfo(np.int64).min


def build_tree(ids: np.ndarray, m: np.ndarray, leaf_rows: int = LEAF_ROWS) -> dict:
    """Arrays of a KD-tree: rows in leaf order, and per node its box, children and row range."""
    order = np.arange(len(ids))
    low, high, child, span = [], [], [], []
    todo = [(0, len(ids), -1)]
    while todo:
        a, b, parent = todo.pop()
        node, rows = len(low), m[order[a:b]]
        low.append(rows.min(0))
        high.append(rows.max(0))
        child.append([-1, -1])
        span.append((a, b))
        if parent >= 0:
            child[parent][child[parent][0] >= 0] = node
        if b - a > leaf_rows:
            wide = int(np.argmax(high[-1].astype(float) - low[-1]))
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(rows[:, wide], mid)]
            todo += [(a, a + mid, node), (a + mid, b, node)]
    return {"ids": ids[order], "rows": m[order], "low": np.array(low), "high": np.array(high), "child": np.array(child), "span": np.array(span)}


def exact_matrices(q: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
    """As double where every sum of products is below 2^53 and so exact, else as they are (64-bit integers).

    Vectors whose score could pass 2^63 are an error: the result's scores are 64-bit integers.
    """
    top = lambda m: float(np.abs(m.astype(float)).max(initial=0))
    most = top(q) * max(map(top, others)) * q.shape[1]
    if most < 2**52:
        return tuple(x.astype(np.float64) for x in (q, *others))
    if most >= 2**62:
        raise OverflowError("a score could pass 64 bits; scale the vectors down")
    return (q, *others)


def scan_tree(block: dict, tree: dict, k: int) -> pd.DataFrame:
    """Hits of a block's queries in one tree that can still be among their k best."""
    q, rows, low, high = exact_matrices(block["rows"], tree["rows"], tree["low"], tree["high"])
    zero = np.zeros((), q.dtype)
    bound = np.maximum(q, zero) @ high.T + np.minimum(q, zero) @ low.T
    floor = -np.inf if q.dtype == np.float64 else NONE
    kth = block["kth"].astype(q.dtype) if q.dtype != np.float64 else np.where(block["kth"] == NONE, -np.inf, block["kth"].astype(float))
    best = np.full((len(q), k), floor, q.dtype)
    best_ids = np.full((len(q), k), np.iinfo(np.int64).max)
    open_ = np.full(bound.shape, floor, q.dtype)
    open_[:, 0] = bound[:, 0]
    live = np.arange(len(q))
    while len(live):
        node = open_[live].argmax(1)
        top = open_[live, node]
        going = (top > floor) & (top >= np.maximum(kth[live], best[live, -1]))
        live, node = live[going], node[going]
        open_[live, node] = floor
        inner = tree["child"][node, 0] >= 0
        for side in (0, 1):
            at, to = live[inner], tree["child"][node[inner], side]
            open_[at, to] = bound[at, to]
        at, leaf = live[~inner], node[~inner]
        order = np.argsort(leaf, kind="stable")
        at, leaf = at[order], leaf[order]
        for chunk in np.split(np.arange(len(leaf)), np.flatnonzero(np.diff(leaf)) + 1):
            if len(chunk):
                a, b = tree["span"][leaf[chunk[0]]]
                who = at[chunk]
                score = q[who] @ rows[a:b].T
                score[tree["ids"][None, a:b] == block["ids"][who][:, None]] = floor
                gain = score.max(1) >= np.maximum(kth[who], best[who, -1])
                who, score = who[gain], score[gain]
                if len(who):
                    best[who], best_ids[who] = S.merge(best[who], best_ids[who], score, np.broadcast_to(tree["ids"][a:b], score.shape), k)
    at, rank = np.nonzero((best > floor) & (best >= kth[:, None]))
    exact = best[at, rank]
    return pd.DataFrame({"query_id": block["ids"][at], "vec_id": best_ids[at, rank], "score": exact.astype(float), "exact": exact.astype(np.int64)})


def pack_tree(ids: np.ndarray, m: np.ndarray) -> bytes:
    return pickle.dumps(build_tree(ids, m))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = 1024, block_rows: int = 1024) -> DataFrame:
    """The k rows of ``vectors`` with the largest inner product for each row of ``queries``.

    Both frames are ``(vec_id long, v array<long>)``. Returns ``query_id, rank, vec_id,
    score`` (long), ties to the smaller ``vec_id``; a query with fewer candidates gets
    all. A row with the query's own id is no candidate. Rows with null id, null or
    empty vector take no part; rows that share an id count once (the least vector);
    only vectors of the query's own length are candidates; other columns are dropped. Scores are 64-bit
    integers; vectors whose scores could reach 2^62 raise an error rather than wrap.
    """
    session(vectors)
    vectors, queries = (x.where("vec_id is not null and size(v) > 0").select("vec_id", "v") for x in (vectors, queries))
    n_shards, n_blocks = S.parts_of(vectors.count(), shard_rows), S.parts_of(queries.count(), block_rows)
    trees = materialize(S.pack(vectors, "shard", n_shards, pack_tree))
    ask = lambda ids, m: pickle.dumps({"ids": ids, "rows": m, "kth": np.full(len(ids), NONE)})
    blocks = materialize(S.pack(queries, "block", n_blocks, ask))
    second = min(n_shards, 1 + int(np.ceil(np.sqrt(n_shards))))
    hits = None
    for low, high in ((0, 1), (1, second), (second, n_shards)):
        if low < high:
            if hits is not None:
                blocks = with_bounds(blocks, hits, k, n_blocks)
            wave = materialize(S.search(blocks, trees, n_blocks, low, high, lambda b, t: scan_tree(b, t, k), k, "exact"))
            hits = wave if hits is None else hits.unionByName(wave)
    return S.ranked(hits, k, "exact").select("query_id", "rank", "vec_id", F.col("exact").alias("score"))


def with_bounds(blocks: DataFrame, hits: DataFrame, k: int, n_blocks: int) -> DataFrame:
    """Blocks whose queries carry the kth score found so far."""
    kth = S.ranked(hits, k, "exact").where(F.col("rank") == k).select("query_id", "exact")
    kth = kth.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int"))

    def each(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for blob in left["blob"]:
            x = pickle.loads(blob)
            x["kth"] = pd.Series(right["exact"].to_numpy(), index=right["query_id"].to_numpy()).reindex(x["ids"], fill_value=NONE).to_numpy(np.int64)
            out.append(pickle.dumps(x))
        return pd.DataFrame({"dim": left["dim"], "block": left["block"], "blob": out})

    return blocks.groupBy("block").cogroup(kth.groupBy("block")).applyInPandas(each, "dim int, block int, blob binary")


def op2(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e"))
    v = e.where(S.finite(F.col("e"))).select("vec_id", F.transform("e", lambda x: F.floor(x.cast("double") * 64).cast("long")).alias("v"))
    return top_k(v, v.where("vec_id % 20 = 0"), 20)


OP2_SQL = """
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id,
             CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM q a JOIN q b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
