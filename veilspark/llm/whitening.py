"""Whitening of integer vectors: blockwise TSQR, then a one-sided Jacobi SVD of R.

The fit list holds every distinct vector once. Its rows, centred exactly (n x - S is an
integer), are compressed block by block to a triangular factor R with R'R = Y'Y: each task
keeps one factor, and factors are stacked and factorised again in a tree whose nodes take
``FAN`` of them. Plane rotations then make the columns of R orthogonal; their norms over
the root of n are the standard deviations, and the rotations, accumulated, are the
components. Products of columns are never formed over the data, so small deviations
keep their digits.

What a task holds is one batch and one square matrix of a vector's length; what travels
between tasks, and the model that all tasks get, does not grow with the number of rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shards as S
from .common import materialize, session

#: States that one task merges.
FAN = 16
STATE = "dim int, part long, state binary"
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
MOST = 2**52


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (as columns) and singular values of ``r``, largest value first.

    One-sided Jacobi: in each step every column belongs to one pair, and all pairs are rotated at
    once; a sweep brings all pairs together. Ends when no pair is further from
    orthogonal than rounding.
    """
    d = r.shape[1]
    even = d + d % 2
    w, v = np.zeros((max(r.shape[0], 1), even)), np.eye(even)
    w[: r.shape[0], :d] = r
    ring = np.arange(even)
    for _ in range(sweeps):
        turned = False
        for _ in range(even - 1):
            i, j = ring[: even // 2], ring[: even // 2 - 1 : -1]
            a, b, c = (w[:, i] ** 2).sum(0), (w[:, j] ** 2).sum(0), (w[:, i] * w[:, j]).sum(0)
            far = np.abs(c) > 1e-15 * np.sqrt(a * b)
            if far.any():
                turned = True
                i, j, gap, twice = i[far], j[far], (b - a)[far], 2 * c[far]
                t = np.where(gap < 0, -twice, twice) / (np.abs(gap) + np.hypot(gap, twice))
                cos = 1 / np.hypot(1.0, t)
                sin = cos * t
                for m in (w, v):
                    x, y = m[:, i], m[:, j]
                    m[:, i], m[:, j] = cos * x - sin * y, sin * x + cos * y
            ring = np.concatenate((ring[:1], ring[-1:], ring[1:-1]))
        if not turned:
            break
    norms = np.sqrt((w**2).sum(0))
    order = [k for k in np.argsort(-norms, kind="stable") if np.abs(v[d:, k]).max(initial=0) < 0.5][:d]
    return v[:d, order], norms[order]


def by_length(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, row numbers and matrix of the vectors of each length in a column."""
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    for d in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == d)
        m = flat[offsets[rows][:, None] + np.arange(d)]
        if np.abs(m.astype(float)).max(initial=0) >= MOST:
            raise OverflowError("an entry is beyond 52 bits; scale the vectors down")
        yield d, rows, m


def folded(rows: DataFrame, add: Callable, merge: Callable) -> dict[int, object]:
    """The state of each vector length over all of ``rows(x)``: ``add(state, d, matrix)`` in tasks, ``merge(states)`` in a tree."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, object] = {}
        for batch in batches:
            for d, _, m in by_length(batch.column("x")):
                states[d] = add(states.get(d), d, m)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(list(states), pa.int32()), pa.array([part] * len(states), pa.int64()), pa.array(map(pickle.dumps, states.values()), pa.binary())], names=["dim", "part", "state"])

    def node(pdf: pd.DataFrame) -> pd.DataFrame:
        states = [pickle.loads(x) for x in pdf.sort_values("part")["state"]]
        return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "part": [int(pdf["part"].iloc[0]) // FAN], "state": [pickle.dumps(merge(states))]})

    now = materialize(rows.select("x").mapInArrow(each, STATE))
    while (now.agg(F.max("part")).first()[0] or 0) > 0:
        now = materialize(now.groupBy("dim", F.floor(F.col("part") / FAN)).applyInPandas(node, STATE))
    return {x["dim"]: pickle.loads(x["state"]) for x in now.collect()}


def add_sums(state, d: int, m: np.ndarray):
    n, total = state or (0, np.zeros(d, object))
    return n + len(m), total + m.sum(0).astype(object)


def merge_sums(states: list):
    return sum(n for n, _ in states), sum(t for _, t in states)


def offsets(m: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """n x - S, exactly: 64-bit integers where those hold it, else Python's."""
    fits = float(n) * np.abs(m.astype(float)).max(initial=0) < 2.0**62 and max(map(abs, total), default=0) < 2**62
    return n * m - total.astype(np.int64) if fits else n * m.astype(object) - total


def triangle(blocks: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.concatenate(blocks), mode="r")


def squares(m: np.ndarray) -> np.ndarray:
    """The sum of squares of each row of integers, as 64-bit integers."""
    if m.dtype != object and np.abs(m.astype(float)).max(initial=0) ** 2 * max(m.shape[1], 1) < 2.0**62:
        return (m * m).sum(1)
    out = (m.astype(object) ** 2).sum(1)
    if max(out, default=0) >= 2**63:
        raise OverflowError("a deviation passes 64 bits; scale the vectors down")
    return out.astype(np.int64)


def model_of(r: np.ndarray, n: int, total: np.ndarray, components: int) -> dict:
    """Basis (components as columns), standard deviations and share of the variance, from R.

    Components without variance, as far as rounding tells, are left out. The largest entry of
    a component is positive.
    """
    basis, norms = jacobi(r)
    kept = min(components, int((norms > norms.max(initial=0) * 1e-13 * len(norms)).sum()))
    basis, norms, all_ = basis[:, :kept], norms[:kept], float((norms**2).sum())
    basis = basis * np.where(np.take_along_axis(basis, np.abs(basis).argmax(0)[None], 0) < 0, -1.0, 1.0) if kept else basis
    return {"n": n, "total": total, "basis": basis, "deviation": norms / np.sqrt(n), "explained": norms**2 / all_ if kept else norms}


def project(m: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """n x - S of each row, and its whitened coordinates."""
    off = offsets(m, model["n"], model["total"])
    return off, (off.astype(float) / model["n"]) @ model["basis"] / model["deviation"]


def whiten(vectors: DataFrame, components: int = 16) -> DataFrame:
    """Whitened coordinates of ``vectors(vec_id long, x array<long>)``, one row per row and component.

    Returns ``vec_id, component, n, deviation, whitened, explained, identity_error`` (see the module):
    n distinct vectors, the sum over dimensions of (n x - S)^2, the projection of x - S / n over the
    component's standard deviation, the component's share of the variance, and the largest
    entry of the whitened fit list's covariance minus the identity, measured over the list.

    Null and empty vectors and those with a null entry take no part; a row of null ``vec_id`` stays. Repeated rows come
    back as often as they came and count once in the fit list. Vectors of each length have a fit list of their own. Directions without
    variance give no component, so a list of one vector gives no rows, nor does an empty table. Components of equal variance are any orthogonal
    choice, the same for all rows. Other columns are dropped. Entries beyond 52 bits and deviations beyond 64 are an error.
    """
    spark = session(vectors)
    rows = vectors.where(F.coalesce((F.size("x") > 0) & ~F.exists("x", lambda v: v.isNull()), F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("x").cast("array<long>").alias("x"))
    fit = materialize(rows.select("x").distinct())
    sums = folded(fit, add_sums, merge_sums)

    def add_rows(state, d: int, m: np.ndarray):
        y = offsets(m, *sums[d]).astype(float) / sums[d][0]
        return triangle([y] if state is None else [state, y])

    models = {d: model_of(r, *sums[d], components) for d, r in folded(fit, add_rows, triangle).items()}

    def add_products(state, d: int, m: np.ndarray):
        w = project(m, models[d])[1]
        return [w.sum(0), w.T @ w] if state is None else [state[0] + w.sum(0), state[1] + w.T @ w]

    for d, (first, second) in folded(fit, add_products, lambda states: [sum(x) for x in zip(*states, strict=True)]).items():
        mean = first / models[d]["n"]
        models[d]["error"] = float(np.abs(second / models[d]["n"] - np.outer(mean, mean) - np.eye(len(mean))).max(initial=0))
    sent = spark.sparkContext.broadcast(models)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, m in by_length(batch.column("x")):
                model = sent.value[d]
                k = len(model["deviation"])
                off, white = project(m, model)
                again = pa.array(np.repeat(at, k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(again), model["n"], np.int64)),
                        pa.array(np.repeat(squares(off), k)), pa.array(white.ravel()), pa.array(np.tile(model["explained"], len(at))), pa.array(np.full(len(again), model["error"])),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(each, OUT)


def op12(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(S.finite(F.col("embedding")))
    return whiten(e.select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * 64).cast("long") + 1_000_000).alias("x")))
