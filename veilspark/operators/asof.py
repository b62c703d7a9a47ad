"""As-of joins by one sorted pass: both sides in one table, a window, and the other side's last row carried along.

Time is cut into spans as long as a match may be apart, and the side that is looked up is put into two
neighbouring spans, so a key of any number of rows is many small windows and never one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nearest(left: DataFrame, right: DataFrame, within: int, after: bool) -> DataFrame:
    """``left(key, at, id)`` with the nearest row of ``right(key, at, id)`` after it, or at or before it, as ``found_at, found_id``.

    ``at`` is in microseconds, ``within`` in seconds: rows ``within`` or more apart do not match. After means strictly after, of rows of one
    time the smallest id; before takes rows of the same time, of those the greatest id. A left row without a match has nulls; null keys and times match nothing.
    """
    span = within * 1_000_000
    own = F.floor(F.col("at") / span)
    step = -1 if after else 1
    a = left.select("key", "at", "id", own.alias("span"), F.lit(0).alias("side"))
    b = right.where("key is not null and at is not null").select("key", "at", "id", F.explode(F.array(own, own + step)).alias("span"), F.lit(1).alias("side"))
    # going back in time the looked-up rows of a time come after the others, going forward before
    order = [F.col("at").desc(), F.col("side"), F.col("id").desc()] if after else [F.col("at"), F.col("side").desc(), F.col("id")]
    seen = Window.partitionBy("key", "span").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b).withColumn("f", F.last(F.when(F.col("side") == 1, F.struct("at", "id")), ignorenulls=True).over(seen)).where("side = 0")
    near = F.when(F.col("key").isNotNull() & (F.abs(F.col("f.at") - F.col("at")) < span), F.col("f"))
    return both.select("key", "at", "id", near["at"].alias("found_at"), near["id"].alias("found_id"))
