"""Shared helpers: durable intermediate tables, word counting, components of a graph."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than the six ASCII white-space ones.
WORD = r"[^\x20\x09-\x0D]+"

_OWN: dict[str, str] = {}

#: Rows and bytes in one Arrow batch: texts can be long, so batches stay short.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20


def session(df: DataFrame) -> SparkSession:
    """The session of a frame; Arrow batches of more than ``ARROW_ROWS`` rows or ``ARROW_BYTES``, too many for long texts, are made shorter from now on."""
    spark = df.sparkSession
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        said = spark.conf.get(name)
        if not (said.isdigit() and 0 < int(said) <= most):
            spark.conf.set(name, str(most))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, on a single machine only, below a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if "dir" not in _OWN:
            _OWN["dir"] = tempfile.mkdtemp(prefix="veilspark-")
            atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
        base = _OWN["dir"]
    return f"{base.rstrip('/')}/veilspark-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame as a table in the shared folder and read it back.

    The copy outlives any executor and cuts the lineage; the folder is the
    cluster's checkpoint folder and is cleaned by its own policy.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """A table with a broadcast hint if it has at most ``rows`` rows, else with one for a shuffle.

    Counted first, so that what is broadcast is bounded, on either side of the join; a larger table is joined by a
    shuffle whose skewed partitions Spark splits.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else shuffled(df)


def shuffled(df: DataFrame) -> DataFrame:
    """A table that is joined by a shuffle, never broadcast: Spark does not count what an explode multiplies, and would take it for small."""
    return df.hint("merge")


def word_count(text: Column) -> Column:
    """Number of words of a text as long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_order(source: str = "source") -> list[Column]:
    """Sort key: code-point order, null last."""
    return [F.col(source).asc_nulls_last()]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` (long, a != b) as ``(node, root)``.

    ``root`` is the least node of the component. Alternates large-star and
    small-star rewriting, which needs a number of rounds logarithmic in the size
    of the largest component; every round is a minimum per node (combined before
    the shuffle) and one join, so a node with many links is never gathered.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if not mark["n"] or tuple(mark) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        seen = tuple(mark)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        now = materialize(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(down.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        )
