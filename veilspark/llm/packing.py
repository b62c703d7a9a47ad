"""Mixture-controlled packing: deficit round-robin over source queues.

Documents are dealt to parts of about ``part_tokens`` ids by a hash. Within a part
every source has a queue; each window of 2048 ids credits each source with its
target share and takes from its queue what its credit covers, so that every window
is close to the target proportions and the rest (the deficit) is carried to the
next. Since a part always packs all of its ids, the deficits with which it starts are
known from the id counts of the parts before it, and so is its first sequence
number: parts carry deficits in their order and still run side by side.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, session
from .tokens import keyed, tokenize

WINDOW = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def fill(queues: list[deque], share: np.ndarray, deficit: np.ndarray, window: int = WINDOW) -> list[tuple]:
    """Pieces ``(source, document, start, length, sequence, offset)`` of all queues.

    A queue holds ``[document, ids left to place, ids placed]``. In each window a
    source's deficit grows by its share of the window; sources take turns in order of
    falling deficit, each what its deficit covers, and what no deficit covers goes to
    the sources that have ids left in the same order. Each window is full but the last.
    """
    out, left = [], np.array([sum(x[1] for x in q) for q in queues], np.int64)
    total, sequence = int(left.sum()), 0
    deficit = deficit.astype(float).copy()
    while total:
        room = size = min(window, total)
        deficit += share * size
        order = np.argsort(-deficit, kind="stable")
        grant = np.clip(np.floor(deficit), 0, left).astype(np.int64)[order]
        grant = np.diff(np.minimum(np.cumsum(grant), room), prepend=0)
        for at, k in enumerate(order):  # what is left of the window
            if (more := min(room - int(grant.sum()), int(left[k] - grant[at]))) > 0:
                grant[at] += more
        offset = 0
        for k, take in zip(order.tolist(), grant.tolist(), strict=True):
            if not take:
                continue
            deficit[k] -= take
            left[k] -= take
            queue = queues[k]
            while take:
                head = queue[0]
                n = min(take, head[1])
                out.append((k, head[0], head[2], n, sequence, offset))
                head[1] -= n
                head[2] += n
                take -= n
                offset += n
                if not head[1]:
                    queue.popleft()
        total -= size
        sequence += 1
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, weights: dict | None = None, part_tokens: int = 1_000_000, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents in sequences of ``window`` ids: ``doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset, source``.

    Every id lies in exactly one piece. Sequences are full except the last of each
    part, so padding is under one window in about ``part_tokens`` ids. Target
    proportions are ``weights`` by source (others 0), by default the corpus' own.

    Null text counts as empty and gives its end id; documents of null source have a
    queue of their own. Rows with a null or repeated ``doc_id`` are packed as often as
    they come. An empty table gives an empty result.
    """
    session(docs)
    tokens = materialize(tokenize(keyed(docs, True), tokenizer, end_id))
    sizes = tokens.groupBy("source").agg(F.sum("n").alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(1, -(-total // part_tokens))
    wanted = sizes.withColumn("w", F.col("n").cast("double"))
    if weights is not None:
        table = docs.sparkSession.createDataFrame(list(weights.items()) or [("", 0.0)], "source string, w double")
        wanted = sizes.join(table.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select("source", F.coalesce("w", F.lit(0.0)).alias("w"))
    shares = wanted.select("source", (F.col("w") / F.sum("w").over(Window.partitionBy())).alias("share"))
    dealt = tokens.withColumn("part", F.pmod("h", F.lit(parts)).cast("int"))
    grid = dealt.groupBy("part", "source").agg(F.sum("n").alias("n"))
    own = grid.groupBy("part").agg(F.sum("n").alias("n"))
    up_to = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    prior = own.select("part", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("all_before"), F.coalesce(F.sum(F.ceil(F.col("n") / window)).over(up_to), F.lit(0)).alias("first"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    so_far = grid.select("part", "source", F.coalesce(before, F.lit(0)).alias("before"))
    named = shares.withColumnRenamed("source", "s")
    carry = so_far.join(named, F.col("source").eqNullSafe(F.col("s"))).join(prior, "part")
    carry = materialize(carry.select("part", "source", "share", (F.col("share") * F.col("all_before") - F.col("before")).alias("deficit"), "first"))

    def each(rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h", "doc_id"], kind="stable").reset_index(drop=True)
        state = state.assign(key=[(x is not None and x == x, str(x)) for x in state["source"]]).sort_values("key").reset_index(drop=True)
        at = {k: n for n, k in enumerate(state["key"])}
        queues: list[deque] = [deque() for _ in at]
        kept = [at[(x is not None and x == x, str(x))] for x in rows["source"]]
        for n, (k, size) in enumerate(zip(kept, rows["n"], strict=True)):
            queues[k].append([n, int(size), 0])
        out = fill(queues, state["share"].to_numpy(), state["deficit"].to_numpy(), window)
        made = pd.DataFrame(out, columns=["k", "row", "start", "length", "sequence_id", "offset"])
        width = max(1, len(rows["ids"].iloc[0]) // int(rows["n"].iloc[0])) if len(rows) else 2
        ids = [np.frombuffer(x, f"<u{width}").astype("<u4") for x in rows["ids"]]
        made["ids_crc32"] = [zlib.crc32(ids[r][a : a + n]) for r, a, n in zip(made["row"], made["start"], made["length"], strict=True)]
        made["doc_id"] = rows["doc_id"].astype("Int64").take(made["row"]).to_numpy() if len(rows) else []
        made["doc_tokens"] = rows["n"].take(made["row"]).to_numpy()
        made["source"] = rows["source"].take(made["row"]).to_numpy()
        made["sequence_id"] += int(state["first"].iloc[0])
        return made[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]]

    return dealt.select("part", "doc_id", "source", "h", "n", "ids").groupBy("part").cogroup(carry.groupBy("part")).applyInPandas(each, PIECES)


def op8(spark, sf_dir):
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
