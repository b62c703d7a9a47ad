"""Cumulative histograms by pane, merged to ranges, and quantiles interpolated in them.

A pane's histogram is one count for each bound, whatever the number of events; those of several panes add up. The same
expressions run over a batch and over a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def panes(events: DataFrame, labels: list[str], bounds: list[float], pane: str = "30 seconds", late: str | None = None) -> DataFrame:
    """``at`` (end of the pane), labels and ``counts``: how many values are at most each bound, and how many there are.

    ``events`` has ``ts``, ``value`` and the labels; null and NaN values count as above every bound. ``late``: for streams, how far rows may be behind.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if late else rows
    below = [F.count_if(F.coalesce((F.col("value") <= b) & ~F.isnan("value"), F.lit(False))) for b in bounds]
    by = rows.groupBy(F.window("ts", pane).alias("w"), *labels).agg(*[c.alias(f"_{n}") for n, c in enumerate(below)], F.count("*").alias("_all"))
    return by.select(F.col("w.end").alias("at"), *labels, F.array(*[F.col(f"_{n}") for n in range(len(bounds))], F.col("_all")).alias("counts"))


def ranges(by_pane: DataFrame, labels: list[str], size: int, pane_seconds: int, count: int) -> DataFrame:
    """At the end of each pane that has data in its range, the histogram of the last ``size`` panes; ``count`` is the length of ``counts``."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.col("at") + F.make_dt_interval(secs=(k * pane_seconds).cast("double")))
    spread = by_pane.select(F.explode(steps).alias("at"), *labels, "counts")
    return spread.groupBy("at", *labels).agg(*[F.sum(F.get("counts", F.lit(n))).alias(f"_{n}") for n in range(count)]).select("at", *labels, F.array(*[F.col(f"_{n}") for n in range(count)]).alias("counts"))


def quantile(counts: Column, bounds: list[float], q: float) -> Column:
    """The quantile by linear interpolation within its bucket.

    The first bucket begins at 0, or is its bound if that is not positive; beyond the last bound the quantile is that bound; without
    values it is null.
    """
    total = F.get(counts, F.lit(len(bounds)))
    rank = total * q
    said = F.when(total == 0, F.lit(None).cast("double"))
    for n, bound in enumerate(bounds):
        own = F.get(counts, F.lit(n))
        before = F.get(counts, F.lit(n - 1)) if n else F.lit(0)
        low = bounds[n - 1] if n else 0.0
        inside = F.lit(float(bound)) if not n and bound <= 0 else F.lit(low) + (bound - low) * (rank - before) / (own - before)
        said = said.when(own >= rank, F.when(own > before, inside).otherwise(F.lit(low)))
    return said.otherwise(F.lit(float(bounds[-1])))


def firing(rows: DataFrame, labels: list[str], above: str, hold: int, pane_seconds: int) -> DataFrame:
    """``rows(at, labels, above)`` with ``firing``: the condition holds at every evaluation of the last ``hold`` seconds, this one included."""
    back = Window.partitionBy(*labels).orderBy(F.unix_seconds("at")).rangeBetween(-hold, 0)
    return rows.withColumn("firing", F.count_if(F.col(above)).over(back) == hold // pane_seconds + 1)
