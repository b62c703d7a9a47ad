"""Approximate nearest neighbours: score-aware quantisation with four-bit table scans.

Vectors are scaled to length 1 and cut into pairs of dimensions, each coded by one
of 16 centres (four bits). Codes and centres minimise the anisotropic loss
|r|^2 + (eta - 1) (r . x)^2 of the residual r: error along the vector changes
inner products with the queries that matter and weighs eta times as much as error
across it. A query becomes a table of 16 partial products per pair; two
pairs share one byte of code, so a scan adds one table entry per byte. The best
candidates of each shard are scored again exactly, in double precision on the
original vectors.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shards as S
from .common import materialize, session

CENTRES = 16
PAIR = 2


def padded(m: np.ndarray) -> np.ndarray:
    """Unit rows as double, with zero columns up to a multiple of two pairs."""
    m = m.astype(np.float64)
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    return np.pad(m, ((0, 0), (0, -m.shape[1] % (2 * PAIR))))


def assign(x: np.ndarray, centres: np.ndarray, eta: float, sweeps: int = 2) -> np.ndarray:
    """Codes (rows, pairs) by coordinate descent on the anisotropic loss."""
    pairs = x.reshape(len(x), -1, PAIR)
    across = ((pairs[:, :, None] - centres[None]) ** 2).sum(-1)
    along = ((pairs[:, :, None] - centres[None]) * pairs[:, :, None]).sum(-1)
    codes = across.argmin(-1)
    total = np.take_along_axis(along, codes[..., None], 2)[..., 0].sum(1)
    at = np.arange(len(x))
    for _ in range(sweeps):
        for m in range(codes.shape[1]):
            rest = total - along[at, m, codes[:, m]]
            codes[:, m] = (across[:, m] + (eta - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(1)
            total = rest + along[at, m, codes[:, m]]
    return codes


def train(sample: np.ndarray, eta: float, rounds: int = 6) -> np.ndarray:
    """Centres (pairs, 16, 2) fitted on a sample: codes and weighted least squares in turn."""
    x = padded(sample)
    pairs = x.reshape(len(x), -1, PAIR)
    pick = np.random.default_rng(7).choice(len(x), CENTRES, replace=len(x) < CENTRES)
    centres = pairs[pick].transpose(1, 0, 2).copy()
    for n in range(rounds):
        weight = eta if n else 1.0
        codes = assign(x, centres, weight, 1)
        chosen = centres[np.arange(pairs.shape[1])[None], codes]
        total = ((pairs - chosen) * pairs).sum((1, 2))
        for m in range(pairs.shape[1]):
            y = pairs[:, m]
            rest = total - ((y - chosen[:, m]) * y).sum(1)
            pull = 1 + (weight - 1) * (rest + (y * y).sum(1))
            for c in range(CENTRES):
                own = codes[:, m] == c
                if own.any():
                    a = own.sum() * np.eye(PAIR) + (weight - 1) * y[own].T @ y[own]
                    centres[m, c] = np.linalg.solve(a, (y[own] * pull[own, None]).sum(0))
    return centres


def pack_index(ids: np.ndarray, m: np.ndarray, centres: dict, eta: float) -> bytes:
    """A shard: ids, original vectors and, where centres of this length exist, bytes of two codes."""
    found, codes = centres.get(m.shape[1]), None
    if found is not None:
        own = np.concatenate([assign(padded(m[a : a + 1024]), found, eta) for a in range(0, len(m), 1024)])
        codes = (own[:, 0::2] * CENTRES + own[:, 1::2]).astype(np.uint8).T.copy()
    return pickle.dumps({"ids": ids, "rows": m.astype(np.float32) if np.array_equal(m, m.astype(np.float32)) else m, "codes": codes})


def scan_codes(block: dict, index: dict, centres: dict, k: int, rerank: int) -> pd.DataFrame:
    """The k best of a shard for each query, by exact cosine among the ``rerank`` best by tables."""
    q, rows = block["rows"].astype(np.float64), index["rows"].astype(np.float64)
    norms, q_norms = np.linalg.norm(rows, axis=1), np.linalg.norm(q, axis=1)
    out = []
    for a in range(0, len(q), 128):
        part = q[a : a + 128]
        own = index["ids"][None] == block["ids"][a : a + 128, None]
        if index["codes"] is None or len(rows) <= rerank + 1:
            near = np.broadcast_to(np.arange(len(rows)), own.shape)
        else:
            found = centres[q.shape[1]]
            unit = padded(part).reshape(len(part), -1, PAIR)
            table = np.einsum("qmd,mcd->mqc", unit, found).astype(np.float32)
            table = (table[0::2, :, :, None] + table[1::2, :, None, :]).reshape(len(table) // 2, len(part), CENTRES**2)
            guess = np.zeros(own.shape, np.float32)
            for m, code in enumerate(index["codes"]):
                guess += table[m][:, code]
            guess[own] = -np.inf
            near = np.argpartition(-guess, rerank, axis=1)[:, :rerank]
        score = np.einsum("qd,qrd->qr", part, rows[near]) / (q_norms[a : a + 128, None] * norms[near])
        score[np.take_along_axis(own, near, 1)] = -np.inf
        order = np.lexsort((index["ids"][near], -score), axis=1)[:, :k]
        best = np.take_along_axis(score, order, 1)
        at, rank = np.nonzero(best > -np.inf)
        ids = np.take_along_axis(index["ids"][near], order, 1)
        out.append(pd.DataFrame({"query_id": block["ids"][a : a + 128][at], "vec_id": ids[at, rank], "score": best[at, rank], "exact": 0}))
    return pd.concat(out)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, eta: float = 4.0, train_rows: int = 10_000,
    rerank: int = 100, shard_rows: int = 4096, block_rows: int = 1024,
) -> DataFrame:
    """About the k rows of ``vectors`` with the largest cosine for each row of ``queries``.

    Both frames are ``(vec_id long, v array<double>)``. Returns ``query_id, rank, vec_id,
    score`` with the exact cosine, ties to the smaller id. The centres are fitted on
    a sample of about ``train_rows`` rows picked by a hash of the id; every row is
    indexed and scanned. ``rerank`` candidates of each shard are scored exactly.

    Rows with null id, and null, empty, zero or non-finite vectors take no part; rows
    that share an id count once (the least vector). Vectors of a length that the
    sample lacks are searched exactly.
    """
    session(vectors)
    ok = "vec_id is not null and exists(v, x -> x <> 0)"
    vectors, queries = (x.where(S.finite(F.col("v"))).where(ok).select("vec_id", "v") for x in (vectors, queries))
    n, n_blocks = vectors.count(), S.parts_of(queries.count(), block_rows)
    n_shards = S.parts_of(n, shard_rows)
    sample = vectors.where(F.pmod(F.xxhash64(F.lit("sample"), "vec_id"), F.lit(max(n, 1))) < train_rows).limit(2 * train_rows)
    by_length: dict[int, list] = {}
    for v in sorted(sample.toPandas()["v"], key=lambda v: (len(v), *v)):
        by_length.setdefault(len(v), []).append(v)
    centres = {d: train(np.array(rows, np.float64), eta) for d, rows in by_length.items() if len(rows) >= CENTRES}
    index = materialize(S.pack(vectors, "shard", n_shards, lambda ids, m: pack_index(ids, m, centres, eta)))
    blocks = S.pack(queries, "block", n_blocks, lambda ids, m: pickle.dumps({"ids": ids, "rows": m}))
    hits = S.search(blocks, index, n_blocks, 0, n_shards, lambda b, x: scan_codes(b, x, centres, k, rerank), k, "score")
    return S.ranked(hits, k, "score").select("query_id", "rank", "vec_id", "score")


def op3(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return nearest(v, v.where("vec_id % 50 = 0"), 5)
