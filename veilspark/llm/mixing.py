"""Mixing sources to target weights with hash-threshold histograms.

Each document has a 48-bit hash. A source takes a whole number of copies of all
its documents and one more of those whose hash lies below a threshold. The threshold
is found without sorting: words are summed by source and the top 12 bits of the hash,
the bucket in which the running sum passes the budget is split by the next 12 bits,
and so on; after four levels the threshold is exact. Only (source, bucket) sums
are gathered, 4096 per source and level, and reruns give the same documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, session, small, word_count

HASH_BITS, LEVEL_BITS = 48, 12
MOST_COPIES = 3


def targets(sizes: DataFrame, total: int) -> DataFrame:
    """``sizes(source, source_size)`` with each source's ``target``.

    Sources in code-point order, null last, weigh 1, 2, 3, 1, ... and share ``total``; a
    target stops at 3 times its source's size and the excess goes to the others by
    weight. In order of falling weight per size, the first sources are the full ones: with
    k of them full the others get (total - what those hold) / (weight left) for each unit of weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("long")).withColumn("cap", F.col("source_size") * MOST_COPIES)
    fill = Window.orderBy((F.col("cap").cast("double") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    held, weighed = F.sum("cap").over(fill), F.sum("weight").over(fill)
    every = Window.partitionBy()
    w = w.withColumn("level", (F.lit(total) - (held - F.col("cap"))).cast("double") / (F.sum("weight").over(every) - (weighed - F.col("weight"))))
    w = w.withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("cap").cast("double") / F.col("weight"), "source", "level"))).over(every)["level"]
    target = F.least(level * F.col("weight"), F.col("cap").cast("double"))
    return w.select("source", "source_size", F.coalesce(target, F.col("cap").cast("double")).alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source the least hash not taken: ``source, threshold``.

    Taken are the hashes below it, the most whose words, summed by rising hash, stay
    within ``budgets(source, budget)``.
    """
    state = budgets.select("source", F.col("budget").alias("left"), F.lit(0).cast("long").alias("prefix"))
    for level in range(HASH_BITS // LEVEL_BITS):
        low = HASH_BITS - (level + 1) * LEVEL_BITS
        near = rows.join(small(state).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        inside = near.where(F.shiftright("hash", low + LEVEL_BITS) == F.col("prefix"))
        sums = inside.groupBy("source", F.shiftright("hash", low).alias("bucket")).agg(F.sum("size").alias("words"), F.first("left").alias("left"), F.first("prefix").alias("prefix"))
        run = Window.partitionBy("source").orderBy("bucket")
        summed = sums.withColumn("run", F.sum("words").over(run))
        past = summed.where(F.col("run") > F.col("left")).groupBy("source").agg(F.min(F.struct("bucket", (F.col("left") - (F.col("run") - F.col("words"))).alias("left"))).alias("x"))
        found = state.join(past.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
        # no bucket passes the budget: the threshold lies past the last one of this prefix
        none = F.shiftleft(F.col("prefix") + 1, LEVEL_BITS)
        state = materialize(found.select("source", F.coalesce(F.col("x.left"), F.lit(0)).cast("long").alias("left"), F.coalesce(F.col("x.bucket"), none).alias("prefix")))
    return state.select("source", F.col("prefix").alias("threshold"))


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, copies, taken``.

    ``size`` is the number of words (null text: 0), ``taken`` is ``copies`` times it, with 3
    copies at most. The hash is of ``doc_id`` and text, so repeated rows share a
    decision; null ids and sources are ordinary values. Sources without words take
    nothing. An empty table gives an empty result.
    """
    session(docs)
    text = F.col("text").cast("string")
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(F.coalesce(text, F.lit(""))))
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long").alias("hash")))
    sizes = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    total = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    wanted = targets(sizes, total)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = wanted.withColumn("base", F.least(F.floor(ratio), F.lit(MOST_COPIES)).cast("long"))
    plan = materialize(plan.withColumn("budget", F.floor(F.col("target") - F.col("base") * F.col("source_size")).cast("long")))
    cut = thresholds(rows, plan.where("budget > 0 and base < 3").select("source", "budget"))
    plan = plan.join(cut.withColumnRenamed("source", "c"), F.col("source").eqNullSafe(F.col("c")), "left").drop("c").withColumnRenamed("source", "s")
    out = rows.join(small(materialize(plan)), F.col("source").eqNullSafe(F.col("s")))
    copies = F.col("base") + (F.col("hash") < F.coalesce("threshold", F.lit(0))).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "hash")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents in the mix, each as often as it has copies, with all columns of ``docs``."""
    found = mix(docs)
    source, text = F.col("source").cast("string"), F.col("text").cast("string")
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(F.coalesce(text, F.lit(""))))
    marked = docs.withColumn("_vs_hash", F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long")).withColumn("_vs_source", source)
    per = found.groupBy(F.col("source").alias("_vs_s"), F.col("hash").alias("_vs_h")).agg(F.max("copies").cast("int").alias("_vs_copies"))
    joined = marked.join(per, (F.col("_vs_hash") == F.col("_vs_h")) & F.col("_vs_source").eqNullSafe(F.col("_vs_s"))).where("_vs_copies > 0")
    return joined.withColumn("_vs_copy", F.explode(F.sequence(F.lit(1), F.col("_vs_copies")))).select(*docs.columns)


def op6(spark, sf_dir):
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, source,
                  CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || md5(coalesce(text, ''))), 1, 12) AS BIGINT) AS hash
           FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM s),
o AS (SELECT *, CAST((SELECT sum(source_size) FROM s) - (sum(cap) OVER f - cap) AS DOUBLE)
                / ((SELECT sum(weight) FROM w) - (sum(weight) OVER f - weight)) AS level,
             CAST(cap AS DOUBLE) / weight AS r
      FROM w WINDOW f AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT level FROM o WHERE level * weight <= cap ORDER BY r, source NULLS FIRST LIMIT 1),
t AS (SELECT source, source_size, coalesce(least((SELECT level FROM l) * weight, CAST(cap AS DOUBLE)), CAST(cap AS DOUBLE)) AS target FROM o),
p AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS BIGINT) AS base FROM t),
b AS (SELECT *, CAST(floor(target - base * source_size) AS BIGINT) AS budget FROM p),
c AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.base, b.budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash RANGE UNBOUNDED PRECEDING) AS run
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (base + CASE WHEN budget > 0 AND base < 3 AND run <= budget THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
