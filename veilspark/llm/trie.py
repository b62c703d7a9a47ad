"""Prefix trie of conversations by digests, rolled up by pointer jumping.

A node is the sequence of a conversation's first d turns. Each turn has a digest of its
role and text; a prefix's key is made of its depth and the exclusive or of hashes of (position,
turn digest), so keys of all prefixes are running values that can be cut anywhere: a conversation's
running values are taken in chunks of ``CHUNK`` turns, and chunks before are added from a table with one row each.
A node's parent is its key without the last turn. Texts never travel, their digests do.

Sums over subtrees take a number of rounds logarithmic in the greatest depth. After
round k a node has the sum over its descendants nearer than 2^k, and points to its ancestor at
distance 2^k; a round adds what all nodes that point to it have, and
doubles the pointers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, session, small

CHUNK = 4096
#: Most turns that a rebuilt conversation shares with the first of its hundred.
HEAD = 5
ROOT = "0.0.0"


def turn_digests(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, digest, size`` (code points of the text) of every turn of a known conversation; null role or text is empty."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.char_length(text).cast("long").alias("size"))


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns with their position in their conversation (``conv_id, pos, digest, size``), and ``conv_id, own`` with each one's number of turns.

    Turns are dealt by ranges of (conversation, order), so a long conversation lies in
    many parts; positions are those in the part plus the counts of the parts before.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("digest"), F.col("again")]
    spread = turns.withColumn("again", F.monotonically_increasing_id())  # repeated rows can be dealt apart
    dealt = materialize(spread.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()))
    counts = materialize(dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n")))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("conv_id", "part", F.coalesce(before, F.lit(0)).alias("before"))
    local = dealt.withColumn("at", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)))
    placed = local.join(starts, ["conv_id", "part"]).select("conv_id", (F.col("before") + F.col("at")).alias("pos"), "digest", "size")
    return placed, counts.groupBy("conv_id").agg(F.sum("n").alias("own"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as the first of their hundred does: ``conv_id, depth, digest, size`` and ``conv_id, length``."""
    placed, counts = numbered(turn_digests(conversations))
    placed = materialize(placed)
    known = counts.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % (HEAD + 1)).alias("h"))
    bases = counts.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    joined = known.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("there", F.lit(0))))
    joined = materialize(joined.select("conv_id", "base", "h", "k", (F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")))
    rest = placed.join(joined, "conv_id").where("pos > h").select("conv_id", (F.col("k") + F.col("pos") - F.col("h")).alias("depth"), "digest", "size")
    first = placed.where(F.col("pos") <= HEAD).withColumnRenamed("conv_id", "base")
    head = first.join(joined, "base").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "digest", "size")
    return rest.unionByName(head), joined.select("conv_id", "length")


def key(depth: Column, x: Column, y: Column) -> Column:
    return F.concat_ws(".", depth.cast("string"), F.hex(x), F.hex(y))


def prefixes(turns: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, depth, node, parent, size`` of each prefix, and ``conv_id, node`` of each whole conversation, the root's key for turnless ones."""
    own = turns.select("conv_id", "depth", "size", F.floor(F.col("depth") / CHUNK).alias("chunk"), *[F.xxhash64(F.lit(n), "depth", "digest").alias(c) for n, c in enumerate("xy")])
    up_to = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = materialize(own.select("*", *[F.bit_xor(c).over(up_to).alias(f"r{c}") for c in "xy"]))
    totals = materialize(run.groupBy("conv_id", "chunk").agg(*[F.bit_xor(c).alias(f"t{c}") for c in "xy"]))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = materialize(totals.select("conv_id", "chunk", *[F.bit_xor(f"t{c}").over(before).alias(f"b{c}") for c in "xy"]).where("bx is not null"))
    whole = run.join(small(carried), ["conv_id", "chunk"], "left").select("conv_id", "depth", "size", "x", "y", *[F.col(f"r{c}").bitwiseXOR(F.coalesce(f"b{c}", F.lit(0))).alias(f"p{c}") for c in "xy"])
    keys = whole.select("conv_id", "depth", "size", key(F.col("depth"), F.col("px"), F.col("py")).alias("node"), key(F.col("depth") - 1, F.col("px").bitwiseXOR(F.col("x")), F.col("py").bitwiseXOR(F.col("y"))).alias("parent"))
    sums = totals.groupBy("conv_id").agg(*[F.bit_xor(f"t{c}").alias(c) for c in "xy"])
    ends = lengths.join(sums, "conv_id", "left").select("conv_id", key(F.col("length"), F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0))).alias("node"))
    return keys, ends


def end_digests(ends: DataFrame) -> DataFrame:
    """``node, sha``: SHA-256 of the ids of ``ends(node, conv_id)``, ascending and comma-joined.

    Ids are sorted by range over all tasks and joined batch by batch, so a node with many ends
    reaches its one hash as few long strings, which are hashed as they come and never held together.
    """

    def runs(node: np.ndarray) -> Iterator[tuple[int, int]]:
        cuts = [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1).tolist(), len(node)]
        return zip(cuts[:-1], cuts[1:], strict=True)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                node, ids = batch.column("node").to_numpy(zero_copy_only=False), batch.column("conv_id").to_pylist()
                at = list(runs(node))
                yield pa.RecordBatch.from_arrays([pa.array([node[a] for a, _ in at], pa.string()), pa.array([ids[a] for a, _ in at], pa.int64()), pa.array([",".join(map(str, ids[a:b])) for a, b in at], pa.string())], names=["node", "low", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, hashlib.sha256()
        for batch in batches:
            done = []
            for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if node == now:
                    digest.update(b",")
                else:
                    done += [(now, digest.hexdigest())] if now is not None else []
                    now, digest = node, hashlib.sha256()
                digest.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.string())], names=["node", "sha"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], names=["node", "sha"])

    lists = ends.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(joined, "node string, low long, ids string")
    return lists.repartition("node").sortWithinPartitions("node", "low").mapInArrow(hashed, "node string, sha string")


def rolled_up(edges: DataFrame, values: DataFrame, names: list[str]) -> DataFrame:
    """``values(node, *names)`` summed over subtrees; ``edges(node, parent, depth)`` of all nodes but the root."""
    deepest = edges.agg(F.max("depth")).first()[0] or 0
    sums, jumps, step = values, edges.select("node", F.col("parent").alias("up"), "depth"), 1
    while step <= deepest:
        gains = jumps.join(sums, "node").groupBy("up").agg(*[F.sum(c).alias(f"g_{c}") for c in names])
        sums = materialize(sums.join(gains.withColumnRenamed("up", "node"), "node", "left").select("node", *[(F.col(c) + F.coalesce(f"g_{c}", F.lit(0))).alias(c) for c in names]))
        step *= 2
        above = jumps.select(F.col("node").alias("up"), F.col("up").alias("next"))
        jumps = materialize(jumps.where(F.col("depth") >= step).join(above, "up").select("node", F.col("next").alias("up"), "depth"))
    return sums


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations ``turns(conv_id, depth, digest, size)``, ``lengths(conv_id, length)``.

    Returns ``conv_id`` (the smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``, members being the conversations that begin so; see ``op11`` for the rest. No conversation, no node.
    """
    keys, ends = prefixes(turns, lengths)
    ends = materialize(ends)
    root = ends.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).first()
    least = keys.groupBy("node", "parent", "depth", "size").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    top = ends.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    top = top.select(F.lit(ROOT).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("size"), "conv_id", "n_convs")
    nodes = materialize(least.unionByName(top))
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    known = materialize(nodes.join(children, "node", "left").select("node", "parent", "depth", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens")))
    values = known.select("node", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), "saved_tokens")
    sums = rolled_up(known.where("depth > 0").select("node", "parent", "depth"), values, ["n_leaves", "saved_tokens"])
    full = known.drop("saved_tokens").join(sums, "node").join(end_digests(ends), "node", "left")
    full = materialize(full.withColumn("ends_sha256", F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256))))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    above = known.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    deep = full.where("depth > 1").join(above, "parent").select(*columns)
    high = full.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root["conv_id"]).cast("long"))).select(*columns)
    return deep.unionByName(high)


def op11(spark, sf_dir):
    """The trie of ``conversations``, each rebuilt to begin as the first of its hundred does.

    Turns are ordered by ``turn``, null first, ties by the digest of role and text; null role or text counts as empty; rows
    of null ``conv_id`` are left out; repeated rows are turns of their own; texts of any length count whole; other columns are not read; an
    empty table gives an empty result.
    """
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    session(table)
    return prefix_trie(*rebuilt(table))


OP11_SQL = """
WITH t AS (SELECT conv_id, digest, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos
           FROM (SELECT conv_id, turn, length(text) AS size, sha256(concat(CAST(strlen(role) AS VARCHAR), ':', role, text)) AS digest
                 FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL))),
n AS (SELECT conv_id, count(*) AS own FROM t GROUP BY conv_id),
c AS (SELECT n.conv_id, own, n.conv_id - n.conv_id % 100 AS base,
             xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(n.conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
               lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1))))) % 6 AS h FROM n),
k AS (SELECT c.*, least(h, coalesce(b.own, 0)) AS k FROM c LEFT JOIN n b ON b.conv_id = c.base),
r AS (SELECT k.conv_id, t.pos AS depth, digest, size FROM k JOIN t ON t.conv_id = k.base AND t.pos <= k.h
      UNION ALL SELECT k.conv_id, k.k + t.pos - k.h, digest, size FROM k JOIN t ON t.conv_id = k.conv_id AND t.pos > k.h),
whole AS (SELECT k.conv_id, coalesce(keys, []) AS keys FROM k LEFT JOIN (SELECT conv_id, list(digest ORDER BY depth) AS keys FROM r GROUP BY conv_id) USING (conv_id)),
p AS (SELECT r.conv_id, r.depth, r.size, keys[1:r.depth] AS path FROM r JOIN whole USING (conv_id)
      UNION ALL SELECT conv_id, 0, 0, [] FROM whole),
nodes AS (SELECT array_to_string(path, ',') AS node, path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(size) AS saved FROM p GROUP BY path, depth),
kids AS (SELECT array_to_string(path[1:depth - 1], ',') AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
ends AS (SELECT array_to_string(keys, ',') AS node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS sha FROM whole GROUP BY 1),
ups AS (SELECT depth, path, saved, CASE WHEN kids.node IS NULL THEN 1 ELSE 0 END AS leaf, unnest(range(depth + 1)) AS to_depth FROM nodes LEFT JOIN kids USING (node)),
sums AS (SELECT array_to_string(path[1:to_depth], ',') AS node, sum(saved) AS saved, sum(leaf) AS leaves FROM ups GROUP BY 1)
SELECT nodes.conv_id, CAST(nodes.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, nodes.n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM nodes JOIN sums USING (node) LEFT JOIN kids USING (node) LEFT JOIN ends USING (node)
LEFT JOIN nodes up ON nodes.depth > 0 AND up.depth = nodes.depth - 1 AND up.node = array_to_string(nodes.path[1:nodes.depth - 1], ',')
"""
