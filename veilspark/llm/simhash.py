"""SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint is embedded as the bit counts of its 16 four-bit segments.
Flipping one bit moves one count by one, so the Manhattan distance of two
embeddings never exceeds the Hamming distance of the fingerprints. Two integer
points at Manhattan distance 2 or less have a lattice point within distance 1 of
both, so a grid of unit cells, in which every fingerprint occupies its own cell
and its 32 neighbours, brings every pair to link together at least once; the
Hamming distance then decides. Equal fingerprints are one node, whatever their
number of documents.

A cell may be crowded when thousands of near copies share a neighbourhood. Its
fingerprints are then joined on 14 of their 16 segments instead (some choice of
14 is equal for any two within 2 bits): such a group has at most 2^8 members by
construction, so no cell makes all pairs of an unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, components, materialize, session, shuffled

SEGMENTS = 16
SEED = 42


def shingle_hashes(text: bytes | None, width: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of a text's shingles, repeats included; none without words.

    A-Z are lower-cased, words are runs free of ASCII white space, shingles are
    ``width`` words joined by a space (the whole sequence if shorter).
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    return np.fromiter((digest(flat[a:b], SEED) for a, b in spans), np.uint64, n)


def fingerprint(text: bytes | None, width: int = 3, tables: int = 1, distinct: bool = False) -> list[int]:
    """Signed 64-bit fingerprints of one text, one per table; zero without words.

    Table 0 takes the shingles' hashes as they are, the others a fixed bijection of
    them. ``distinct``: repeated shingles count once.
    """
    h = shingle_hashes(text, width)
    if distinct:
        h = np.unique(h)
    return [majority(mix(h, t)) for t in range(tables)] if len(h) else [0] * tables


def mix(h: np.ndarray, table: int) -> np.ndarray:
    """Hashes of another table: odd multiplications and shifts, which lose nothing."""
    if not table:
        return h
    with np.errstate(over="ignore"):
        h = (h ^ np.uint64(0x9E3779B97F4A7C15 * (2 * table + 1) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def majority(h: np.ndarray, rows: int = 65536) -> int:
    """Signed integer with each bit set that is set in over half of the hashes."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(h), rows):
        part = np.ascontiguousarray(h[at : at + rows])
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(text: Column, width: int, tables: int = 1, distinct: bool = False) -> Column:
    """Column of fingerprints (array of long) of a text column."""

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(x, width, tables, distinct) for x in batch])

    return F.pandas_udf(each, "array<long>")(text.cast("binary"))


def segment_counts(fp: Column) -> Column:
    """The bit counts of the 16 segments, packed four bits each into a long.

    Counts are 0 to 4; one is added so that a neighbour's -1 to 5 stays in its nibble.
    """
    ones = F.lit(0x1111111111111111)
    counts = [F.shiftrightunsigned(fp, k).bitwiseAND(ones) for k in range(4)]
    return counts[0] + counts[1] + counts[2] + counts[3] + ones


def grid_cells(fp: Column) -> Column:
    """The cell of a fingerprint and the 32 cells at Manhattan distance 1."""
    own = segment_counts(fp)
    steps = [F.lit(1 << 4 * k) for k in range(SEGMENTS)]
    return F.array(own, *[own + s for s in steps], *[own - s for s in steps])


#: Every choice of 14 of the 16 segments, as a mask of the bits kept.
KEPT = [
    (lambda m: m - 2**64 if m >= 2**63 else m)((2**64 - 1) ^ (0xF << 4 * a) ^ (0xF << 4 * b))
    for a, b in combinations(range(SEGMENTS), 2)
]


def fingerprint_links(fps: DataFrame, distance: int = 2, crowd: int = 64) -> DataFrame:
    """Pairs ``(a, b)`` of distinct fingerprints in ``fps(fp)`` within ``distance`` (at most 2) bits.

    ``crowd``: fingerprints in a cell from which its pairs come by shared segments
    instead; both ways are exact, so it moves work only.
    """
    if not 0 <= distance <= 2:
        raise ValueError("the grid covers distances 0 to 2")
    cells = fps.select("fp", F.explode(grid_cells(F.col("fp"))).alias("cell"))
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    close = (F.col("l.fp") < F.col("r.fp")) & (F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= distance)
    sized = materialize(shuffled(cells).join(sizes, "cell"))
    calm = sized.where(F.col("n") <= crowd)
    pairs = shuffled(calm).alias("l").join(calm.alias("r"), (F.col("l.cell") == F.col("r.cell")) & close)
    crowded = sized.where(F.col("n") > crowd).select("fp").distinct()
    masks = F.array(*[F.lit(m) for m in KEPT])
    parts = crowded.select("fp", F.posexplode(F.transform(masks, lambda m: F.col("fp").bitwiseAND(m))).alias("m", "part"))
    hot = shuffled(parts).alias("l").join(parts.alias("r"), (F.col("l.m") == F.col("r.m")) & (F.col("l.part") == F.col("r.part")) & close)
    both = [x.select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b")) for x in (pairs, hot)]
    return both[0].unionByName(both[1]).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id``.

    ``component_id`` is the smallest ``doc_id`` reachable over links, itself included.

    Null text counts as empty, and texts without words have fingerprint zero and
    link to each other like any others. A row with null ``doc_id`` takes part, but
    is never a component's smallest id unless the component has no other (then
    null). Repeated rows come back as often as they came. An empty table gives an
    empty result.
    """
    session(docs)
    marked = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprints(F.col(text_col), width).alias("fps")))
    nodes = marked.select("doc_id", F.col("fps")[0].alias("fp"))
    least = nodes.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    roots = components(fingerprint_links(least.select("fp")))
    groups = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    named = groups.join(groups.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("fp", "component_id")
    return nodes.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
