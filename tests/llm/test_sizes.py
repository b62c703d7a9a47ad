"""Joins and searches that must not be sized too low: nothing that an explode multiplies is broadcast."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import ann, common, exact_topk, similar, simhash
from veilspark.llm import shards as S


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("together", [1, 3, 16])
def test_search_meets_in_groups(spark, monkeypatch, together):
    """Blocks and shards meet without a join, whatever their grouping, and a group hands on k hits of a query."""
    monkeypatch.setattr(S, "TOGETHER", together, raising=False)
    m = np.random.default_rng(3).integers(-50, 50, (400, 8))
    m[300:] = m[:100]  # copies tie, to the smaller id
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(m)] + [(1000 + k, [1, k - 2]) for k in range(4)], "vec_id long, v array<long>")
    asks = df.where("vec_id % 10 = 0")
    real = df.withColumn("v", F.col("v").cast("array<double>"))
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    found = {"op2": exact_topk.top_k(df, asks, 4, shard_rows=30, block_rows=6), "op3": ann.nearest(real, real.where("vec_id % 10 = 0"), 4, shard_rows=30, block_rows=6)}
    for name, score in (("op2", m @ m.T), ("op3", np.round(unit @ unit.T, 12))):
        got = {}
        for r in found[name].collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
        assert len(got) == 41 and sorted(got[1000].values()) == [1001, 1002, 1003]
        for q in range(0, 400, 10):
            best = [x for x in np.lexsort((np.arange(400), -score[q])).tolist() if x != q][:4]
            assert [got[q][n] for n in (1, 2, 3, 4)] == best
    assert "Join" not in plan(found["op3"])


def test_grid_cells_are_not_broadcast(spark):
    """33 cells of a fingerprint, and 120 parts of a crowded one, count as one row for Spark; they are joined by a shuffle."""
    fps = [int(x) for x in np.random.default_rng(5).integers(-(2**63), 2**63, 300)]
    near = [fps[0] ^ (1 << a) ^ (1 << b) for a in range(0, 60, 3) for b in (1, 62)]
    df = spark.createDataFrame([(x,) for x in dict.fromkeys(fps + near)], "fp long")
    for crowd in (64, 4):
        found = simhash.fingerprint_links(df, crowd=crowd)
        every = [r["fp"] for r in df.collect()]
        assert {tuple(r) for r in found.collect()} == {(a, b) for a in every for b in every if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
        assert "Broadcast" not in plan(found)


def test_wide_grid_is_shuffled(spark, monkeypatch):
    """What is written of the grid comes of a join by shuffle as well."""
    seen = []
    monkeypatch.setattr(simhash, "materialize", lambda df: seen.append(plan(df)) or df)
    simhash.fingerprint_links(spark.range(200).select(F.xxhash64("id").alias("fp")))
    assert len(seen) == 1 and "SortMergeJoin" in seen[0] and "Broadcast" not in seen[0]


def test_near_dedup_shuffles_what_it_unfolds(spark, monkeypatch):
    """Cells of the grid and shingles of texts are many times what Spark takes them for; only counted tables are broadcast."""
    tuples = spark.range(300).select(F.col("id").alias("node"), F.xxhash64("id").alias("fp"))
    assert "BroadcastHashJoin [cell" not in plan(similar.grid_pairs(tuples)) and "SortMergeJoin [cell" in plan(similar.grid_pairs(tuples))
    wide = tuples.withColumn("token", F.explode(F.sequence(F.lit(0), F.lit(40))))
    assert "Broadcast" not in plan(wide.join(common.small(spark.range(50).withColumnRenamed("id", "token"), 10), "token"))
    seen = []
    monkeypatch.setattr(similar, "materialize", lambda df, keep=common.materialize: seen.append(plan(df)) or keep(df))
    monkeypatch.setattr(similar, "SMALL", 3)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join([*words[:k], f"x{k}", *words[k:], f"y{k % 7}"]) for k in range(40)] + [" ".join(f"z{k}{n}" for n in range(30)) for k in range(20)]
    kept = similar.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    shingles = [{tuple(t.split()[n : n + 5]) for n in range(len(t.split()) - 4)} for t in texts]
    root = list(range(60))
    for a in range(60):
        for b in range(a):
            if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root))
    assert seen and not any("BroadcastHashJoin [cell" in x for x in seen)
