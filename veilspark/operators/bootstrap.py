"""Bootstrap intervals with one generator's draws, made in parallel by jumping ahead in its sequence.

A step of xorshift64 is linear over bits, so any number of steps is a 64 x 64 bit matrix, a power of the step's.
The draws of a resample are cut into lanes; a lane jumps to its place in the one sequence that a loop would run
through, and all lanes of a batch step together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

# The shifts of the generator.
LEFT, RIGHT, AGAIN = 13, 7, 17
LANE = 20_000
#: Cases whose counts are sent to all tasks; those of more are joined to the draws.
MOST_CASES = 1_000_000


def stepped(x: np.ndarray) -> np.ndarray:
    """States after one step."""
    x = x ^ (x << np.uint64(LEFT))
    x = x ^ (x >> np.uint64(RIGHT))
    return x ^ (x << np.uint64(AGAIN))


def applied(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    """States under a bit matrix, given by what it makes of each single bit."""
    out = np.zeros_like(x)
    for bit in range(64):
        out ^= np.where((x >> np.uint64(bit)) & np.uint64(1) == 1, matrix[bit], np.uint64(0))
    return out


def powers(count: int) -> list[np.ndarray]:
    """The matrices of 1, 2, 4, ... steps."""
    out = [stepped(np.uint64(1) << np.arange(64, dtype=np.uint64))]
    for _ in range(count - 1):
        out.append(applied(out[-1], out[-1]))
    return out


def ahead(seed: int, steps: np.ndarray) -> np.ndarray:
    """States of the generator of ``seed`` after each of the numbers of steps."""
    x = np.full(len(steps), seed | 1, np.uint64)
    for bit, matrix in enumerate(powers(max(1, int(steps.max(initial=0)).bit_length()))):
        x = np.where((steps >> bit) & 1 == 1, applied(matrix, x), x)
    return x


def resampled(cases: DataFrame, resamples: int, seed: int) -> DataFrame:
    """``r, tp, fp, fn`` of each resample of ``cases(case, tp, fp, fn)``, drawn as a loop over all resamples and draws would."""
    spark = cases.sparkSession
    ordered = stored(numbered(cases))
    n = ordered.count()
    lanes = max(1, -(-n // LANE))
    table = None
    if n <= MOST_CASES:
        rows = ordered.orderBy("i").select("tp", "fp", "fn").toPandas()
        table = spark.sparkContext.broadcast(rows.to_numpy(np.int64))
    every = spark.range(resamples * lanes, numPartitions=max(1, min(resamples * lanes, spark.sparkContext.defaultParallelism * 4)))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            r, lane = np.divmod(batch["id"].to_numpy(np.int64), lanes)
            left = np.minimum(LANE, n - lane * LANE) if n else np.zeros(len(r), np.int64)
            x, sums = ahead(seed, r * n + lane * LANE), np.zeros((len(r), 3), np.int64)
            for k in range(int(left.max(initial=0))):
                x = stepped(x)
                i = (x % np.uint64(n)).astype(np.int64)
                here = left > k
                if table is None:
                    yield pd.DataFrame({"r": r[here], "i": i[here], "tp": 0, "fp": 0, "fn": 0})
                else:
                    sums[here] += table.value[i[here]]
            if table is not None:
                yield pd.DataFrame({"r": r, "i": -1, "tp": sums[:, 0], "fp": sums[:, 1], "fn": sums[:, 2]})

    drawn = every.mapInPandas(each, "r long, i long, tp long, fp long, fn long")
    if table is None:
        drawn = drawn.select("r", "i").join(ordered, "i").select("r", "tp", "fp", "fn")
    return drawn.groupBy("r").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def numbered(cases: DataFrame) -> DataFrame:
    """The cases numbered from 0 in their order, without one task for all: ranges first, then places within them."""
    from pyspark.sql.window import Window

    dealt = stored(cases.repartitionByRange("case").withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each part
    own = F.row_number().over(Window.partitionBy("part").orderBy("case", "tp", "fp", "fn"))
    return dealt.withColumn("own", own).join(F.broadcast(sizes.select("part", before.alias("before"))), "part").select((F.col("before") + F.col("own") - 1).alias("i"), "tp", "fp", "fn")


def f1(tp, fp, fn):
    """2 tp / (2 tp + fp + fn); nothing over nothing is 1."""
    below = 2 * tp + fp + fn
    return F.when(below == 0, 1.0).otherwise(2 * tp / below)


def interval(cases: DataFrame, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """``point_estimate, lower_95, upper_95, resamples``: the micro F1 of ``cases(case, tp, fp, fn)`` and the bounds of its 95 % interval.

    Cases are drawn with replacement in the order of ``case``. Without cases or resamples the bounds are the estimate and ``resamples`` is 0.
    """
    point = cases.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")], F.count("*").alias("n")).select(f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("point_estimate"), "n")
    scores = resampled(cases, resamples, seed).select(f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))
    low = resamples * 25 // 1000
    high = max(low, min(resamples - 1, -(-resamples * 975 // 1000)))
    sorted_ = scores.agg(F.array_sort(F.collect_list("f1")).alias("x"))  # one number for each resample
    there = F.col("n") > 0
    bound = lambda k: F.when(there, F.get("x", F.lit(k))).otherwise(F.col("point_estimate"))
    return point.crossJoin(sorted_).select("point_estimate", F.coalesce(bound(low), "point_estimate").alias("lower_95"), F.coalesce(bound(high), "point_estimate").alias("upper_95"), F.when(there, resamples).otherwise(0).cast("long").alias("resamples"))  # one row each
