"""Near duplicates by shingle similarity, exact: popcount bounds and a check of every link.

Two texts link if their sets of shingles have a Jaccard similarity of ``similarity`` or
more. A text's fingerprint is the bit map of its shingles' hashes; its embedding are the
bit counts of segments of that map, at least one segment for each ``PER_SEGMENT`` shingles, as a power
of two, so that the counts of a smaller number of segments are sums of those of a larger one. A differing bit moves one count by one,
so the Manhattan distance of two embeddings is never above the number of differing shingles,
which for linked texts is at most (1 - s) / (1 + s) of all: pairs beyond that bound go
unread, all others have their sets of shingles compared.

Pairs meet in a grid first: a 64-bit SimHash of the set of shingles is embedded as the bit counts of its segments, it occupies its own unit
cell and the neighbours, each text meets the least fingerprint of each of its cells if at most two bits differ, and of texts of one
fingerprint each meets the least. Linked texts may differ in more than two bits, about ten at a similarity of 0.8, so the rest follows, exact, for texts that the grid
has not joined.

Cells in which the rest meets are shingles. Of a text with n shingles the first
n - ceil(s n) + 1, in an order that all texts share, are enough: linked texts have one of
those in common. The order takes shingles of overfull hash buckets last, counted
over all texts in one small table, so that common phrases make no large cells.

No cell makes all pairs of a large group. Each text meets the cell's least text
only, and components of the links found are joined. Pairs of texts that are
apart after that are compared in full: cells of up to ``CROWD`` texts by pairs, larger
ones in blocks of bounded size that yield at most a spanning forest of their links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as H
from .common import WORD, components, materialize, session, shuffled, small
from .simhash import grid_cells

PER_SEGMENT, LEAST_SEGMENTS = 8, 32
#: Shingles in a hash bucket, as far as the largest table allows.
FULL, MOST_BUCKETS, PACKED = 1024, 1 << 20, 1024
CROWD = 32
#: Most shingles and texts of a block, tokens multiplied at once, pairs counted at once, pairs of a token that is not multiplied, and texts linked at once.
BLOCK_TOKENS, BLOCK_TEXTS, STRIP, PAIRS, FEW, ROWS = 100_000, 2_000, 2_048, 1_000_000, 64, 256
#: Bits in which fingerprints that meet in the grid differ at most, and shingles counted into fingerprints at once.
NEAR_BITS, COUNTED = 2, 1 << 16
#: Texts that one copy of their common neighbour is compared with.
MEMBERS = 128
#: Rows of a key table that is broadcast; a larger one is joined by a shuffle.
SMALL = 100_000


def prefix_length(n: np.ndarray, similarity: float) -> np.ndarray:
    """How many of n shingles are enough to meet every linked text."""
    return n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1


def bucket_classes(docs: DataFrame, width: int) -> np.ndarray:
    """Class 0 to 15 of each hash bucket: 0 as full as chance has it, more the more texts' shingles it holds.

    There are enough buckets to hold about ``FULL`` shingles each, ``MOST_BUCKETS`` at most: the table stays small.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = 1 << min(max(int(size / 7 / FULL).bit_length(), 10), MOST_BUCKETS.bit_length() - 1)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, part in H.slices(batch.column(0)):
                _, token = H.split(H.token_sets(part, width))
                total += np.bincount(token & (buckets - 1), minlength=buckets)
        blobs = [x.tobytes() for x in np.split(total, buckets // PACKED)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blobs)), pa.int32()), pa.array(blobs, pa.binary())], names=["part", "counts"])

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "counts": [sum(np.frombuffer(x, np.int64) for x in rows["counts"]).tobytes()]})

    count = np.zeros(buckets)
    for row in docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(each, "part int, counts binary").groupBy("part").applyInPandas(added, "part int, counts binary").collect():
        count[row["part"] * PACKED : (row["part"] + 1) * PACKED] = np.frombuffer(row["counts"], np.int64)
    usual = max(1.0, float(np.median(count)))
    excess = np.maximum(0, (count - usual - 6 * np.sqrt(usual)) / np.sqrt(usual))
    return np.minimum(15, np.ceil(np.log2(1 + excess))).astype(np.uint8)


def set_fingerprints(doc: np.ndarray, token: np.ndarray, many: int) -> np.ndarray:
    """The 64-bit fingerprint of each text's set of shingles: a bit is set if it is in over half of their hashes; zero without shingles."""
    ones, n = np.zeros((many, 64), np.int64), np.bincount(doc, minlength=many)
    for at in range(0, len(doc), COUNTED):
        own = doc[at : at + COUNTED]
        h = H.mixed((token[at : at + COUNTED] & (2 ** (H.TOKEN_BITS - 4) - 1)).astype(np.uint64))
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > n[:, None], axis=1, bitorder="little").view(np.int64).ravel()


def signatures(docs: DataFrame, width: int, similarity: float, classes: np.ndarray) -> DataFrame:
    """``docs(doc_id, text)`` as ``doc_id, body, node, n, counts, prefix, fp``: hash, number of shingles, embedding, first shingles and fingerprint."""
    wordless = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) == 0
    own = docs.select("doc_id", F.xxhash64("text").alias("body"), F.when(wordless, F.xxhash64(F.lit(""))).otherwise(F.xxhash64("text")).alias("node"), F.col("text").cast("binary").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in H.slices(batch.column("text")):
                doc, token = H.split(H.token_sets(part, width, classes))
                n = np.bincount(doc, minlength=len(part))
                first = np.cumsum(n) - n
                segments = np.maximum(LEAST_SEGMENTS, 1 << np.ceil(np.log2(np.maximum(n, 1) / PER_SEGMENT)).clip(0).astype(np.int64))
                stop = np.cumsum(segments)
                counts = np.bincount((stop - segments)[doc] + ((token >> 14) & (segments[doc] - 1)), minlength=int(stop[-1]))
                take = np.arange(len(doc)) - first[doc] < prefix_length(n, similarity)[doc]
                ends = np.concatenate(([0], np.cumsum(np.bincount(doc[take], minlength=len(part))))).astype(np.int32)
                packed = np.minimum(counts, 255).astype(np.uint8).tobytes()
                blobs = pa.array([packed[a:b] for a, b in zip((stop - segments).tolist(), stop.tolist(), strict=True)], pa.binary())
                rows = batch.slice(at, len(part))
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in ("doc_id", "body", "node")], pa.array(n), blobs, pa.ListArray.from_arrays(pa.array(ends), pa.array(token[take])), pa.array(set_fingerprints(doc, token, len(part)))], names=["doc_id", "body", "node", "n", "counts", "prefix", "fp"])

    return own.mapInArrow(each, "doc_id long, body long, node long, n long, counts binary, prefix array<long>, fp long")


def grid_pairs(tuples: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of ``tuples(node, fp)`` that the grid brings together: at most 34 for each text, whatever the size of a cell."""
    of = materialize(tuples.groupBy("fp").agg(F.min("node").alias("least")))
    copies = tuples.join(of, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    cells = of.select("fp", "least", F.explode(grid_cells(F.col("fp"))).alias("cell"))
    heads = cells.groupBy("cell").agg(F.count("*").alias("n"), F.min(F.struct("fp", "least")).alias("head")).where("n > 1").select("cell", "head")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("head.fp"))).between(1, NEAR_BITS)
    across = shuffled(cells).join(heads, "cell").where(near).select(F.col("head.least").alias("a"), F.col("least").alias("b")).distinct()
    return copies.unionByName(across)


def possible(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sizes and embeddings, in ``texts(node, n, counts)``, allow a link."""
    side = lambda x: texts.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("counts").alias(f"c{x}"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [batch.column(c).to_numpy() for c in ("na", "nb")]
            near = np.minimum(*n) >= similarity * np.maximum(*n) - 1e-9
            counts = [batch.column(c).to_pylist() for c in ("ca", "cb")]
            size = np.array([(len(x), len(y)) for x, y in zip(*counts, strict=True)]).reshape(-1, 2)
            for kind in {tuple(x) for x in size[near].tolist()}:
                rows = np.flatnonzero(near & (size == kind).all(1))
                own = [np.frombuffer(b"".join(c[k] for k in rows), np.uint8).reshape(len(rows), -1, min(kind)).sum(1, dtype=np.int32) for c in counts]
                near[rows] = np.abs(own[0] - own[1]).sum(1) <= (1 - similarity) / (1 + similarity) * (n[0] + n[1])[rows] + 1e-9
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return small(pairs, SMALL).join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ca", "cb").mapInArrow(each, "a long, b long")


def alike(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose texts, in ``texts(node, text)``, have similar sets of shingles.

    A text that many others are compared with is not copied for each: its members are dealt to parts of about ``MEMBERS``, it
    goes to each part once, and a part is read in order, its hub first.
    """
    sizes = materialize(pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts")))
    body = texts.select("node", F.col("text").cast("binary").alias("text"))
    dealt = pairs.join(small(sizes, SMALL), "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    members = dealt.join(body.withColumnRenamed("node", "b"), "b").select("a", "part", "b", "text")
    hubs = sizes.join(body.withColumnRenamed("node", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "text")
    rows = members.unionByName(hubs).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.empty(0, np.int64)
        for batch in batches:
            a, member = batch.column("a").to_numpy(), batch.column("b").is_valid().to_numpy(zero_copy_only=False)
            near = np.zeros(len(a), bool)
            for at, part in H.slices(batch.column("text")):
                doc, token = H.split(H.token_sets(part, width))
                ends = np.searchsorted(doc, np.arange(len(part) + 1))
                cuts = [0, *(np.flatnonzero(~member[at : at + len(part)]) + 1).tolist(), len(part)]
                for low, high in zip(cuts[:-1], cuts[1:], strict=True):  # members up to the next hub, which comes last
                    stop = high if high == len(part) and member[at + high - 1] else high - 1
                    if stop > low:
                        own = slice(ends[low], ends[stop])
                        size = np.diff(ends[low : stop + 1])
                        shared = np.bincount(doc[own][np.isin(token[own], hub)] - low, minlength=stop - low)
                        near[at + low : at + stop] = shared >= similarity * (size + len(hub) - shared) - 1e-9
                    if stop < high:
                        hub = token[ends[stop] : ends[high]].copy()
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return rows.mapInArrow(each, "a long, b long")


def shared_counts(one: dict, two: dict) -> np.ndarray:
    """How many tokens each text of one block shares with each of another.

    Tokens of many texts are columns of two matrices, multiplied ``STRIP`` columns at a time; pairs of texts that a
    rarer token joins are counted one by one. Besides the result, what this holds is bounded by ``STRIP`` and ``PAIRS``.
    """
    rows = [np.repeat(np.arange(len(x["node"]), dtype=np.int32), x["n"]) for x in (one, two)]
    known = np.intersect1d(one["tokens"], two["tokens"])
    lists = []
    for x, row in zip((one, two), rows, strict=True):
        at = np.searchsorted(known, x["tokens"])
        here = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == x["tokens"]) if len(known) else np.empty(0, np.int64)
        order = here[np.argsort(at[here], kind="stable")]
        lists.append((at[order], row[order], np.bincount(at[here], minlength=len(known))))
    (_, row_a, many_a), (_, row_b, many_b) = lists
    first_a, first_b = np.cumsum(many_a) - many_a, np.cumsum(many_b) - many_b
    out = np.zeros((len(one["node"]), len(two["node"])), np.float32)
    dense = many_a * many_b > FEW
    columns = np.flatnonzero(dense)
    for k in range(0, len(columns), STRIP):
        part = columns[k : k + STRIP]
        m = []
        for row, many, first, size in ((row_a, many_a, first_a, out.shape[0]), (row_b, many_b, first_b, out.shape[1])):
            x = np.zeros((size, len(part)), np.float32)
            n = many[part]
            at = np.repeat(first[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            x[row[at], np.repeat(np.arange(len(part)), n)] = 1
            m.append(x)
        out += m[0] @ m[1].T
    rare = np.flatnonzero(~dense)
    for part in np.split(rare, np.arange(PAIRS // FEW, len(rare), PAIRS // FEW)):
        n = many_a[part] * many_b[part]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(many_b[part], n)
        a, b = row_a[np.repeat(first_a[part], n) + k // wide], row_b[np.repeat(first_b[part], n) + k % wide]
        pair, times = np.unique(a.astype(np.int64) * out.shape[1] + b, return_counts=True)
        out.ravel()[pair] += times
    return out


def block_links(blocks: tuple[dict, dict], similarity: float) -> list[tuple[int, int]]:
    """Links between two blocks (or within one, given twice) that join what is apart: at most a spanning forest."""
    one, two = blocks
    both = shared_counts(one, two)
    names, rank = np.unique(np.concatenate((one["comp"], two["comp"])), return_inverse=True)
    side_a, side_b = rank[: len(one["comp"])], rank[len(one["comp"]) :]
    parent, out = list(range(len(names))), []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for at in range(0, len(both), ROWS):  # what rows so far have joined is not looked at again
        root = np.fromiter(map(find, range(len(names))), np.int64, len(names))
        here = both[at : at + ROWS]
        apart = root[side_a[at : at + ROWS]][:, None] != root[side_b][None]
        i, j = np.nonzero((here >= similarity * (one["n"][at : at + ROWS, None] + two["n"][None] - here) - 1e-4) & apart)
        _, kept = np.unique(root[side_a[at + i]] * len(names) + root[side_b[j]], return_index=True)  # one link for two components
        for k in kept.tolist():
            x, y = find(int(side_a[at + i[k]])), find(int(side_b[j[k]]))
            if x != y:
                parent[x] = y
                out.append((int(one["node"][at + i[k]]), int(two["node"][j[k]])))
    return out


def layer_of(n: Column, similarity: float) -> Column:
    """Class of a text's size: linked texts lie in one class or in two neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(1 / similarity)) + 1e-9).cast("int")


def crowd_links(crowd: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links ``(a, b)`` within each cell of ``crowd(token, layer, node, comp, n)``, and between neighbouring ones, of texts of different ``comp``.

    A cell is cut by hash into blocks of about ``BLOCK_TOKENS`` shingles and ``BLOCK_TEXTS`` texts at most; every block meets the blocks of its own and the
    next layer.
    """
    parts = materialize(crowd.groupBy("token", "layer").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_TOKENS), F.ceil(F.count("*") / BLOCK_TEXTS)).cast("int").alias("parts")))
    dealt = crowd.join(parts, ["token", "layer"]).withColumn("part", F.pmod(F.xxhash64("node", "token"), F.col("parts")).cast("int"))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        doc, token = zip(*[H.split(H.token_sets(pa.array([t], pa.large_binary()), width)) for t in rows["text"]], strict=True)
        n = np.array([len(x) for x in doc], np.int64)
        arrays = {"node": rows["node"].to_numpy(np.int64), "comp": rows["comp"].to_numpy(np.int64), "n": n, "tokens": np.concatenate(token)}
        return pd.DataFrame({**{c: [rows[c].iloc[0]] for c in ("token", "layer", "part")}, **{k: [v.tolist()] for k, v in arrays.items()}})

    made = dealt.join(texts, "node").select("token", "layer", "part", "node", "comp", "text")
    made = made.withColumn("text", F.col("text").cast("binary"))
    blocks = materialize(made.groupBy("token", "layer", "part").applyInPandas(build, "token long, layer int, part int, node array<long>, comp array<long>, n array<long>, tokens array<long>"))
    own = parts.select("token", F.col("layer").alias("to"), F.col("parts").alias("many"))
    names = blocks.select("token", "layer", "part")
    asks = names.withColumn("to", F.explode(F.array("layer", F.col("layer") + 1))).join(own, ["token", "to"])
    asks = materialize(asks.select("token", "layer", "part", "to", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("other")).where("layer < to or part <= other"))
    side = lambda x, *keys: blocks.select("token", *[F.col(o).alias(n) for o, n in zip(("layer", "part"), keys, strict=True)], F.struct("node", "comp", "n", "tokens").alias(x))
    pairs = small(asks, SMALL).join(side("one", "layer", "part"), ["token", "layer", "part"]).join(side("two", "to", "other"), ["token", "to", "other"]).select("one", "two")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(batch.column("one"), batch.column("two"), strict=True):
                both = tuple({k: x[k].values.to_numpy() for k in ("node", "comp", "n", "tokens")} for x in (one, two))
                found = np.array(block_links(both, similarity), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return pairs.mapInArrow(each, "a long, b long")


def links(tuples: DataFrame, texts_of, width: int, similarity: float) -> DataFrame:
    """``(node, root)`` of all texts that link to another; ``tuples(node, n, counts, prefix, fp)`` are the distinct texts."""
    grid = materialize(possible(materialize(grid_pairs(tuples)), tuples, similarity))
    near = materialize(alike(grid, texts_of(grid), width, similarity))
    joined = materialize(components(near))
    # the rest: pairs that the grid did not bring together or join
    cells = tuples.select(F.explode("prefix").alias("token"), "node", "n")
    groups = materialize(cells.groupBy("token").agg(F.count("*").alias("df"), F.min("node").alias("a"), F.max("node").alias("b")).where("df > 1"))
    larger = groups.where("df > 2").select("token", "df", F.col("a").alias("least"))
    members = materialize(cells.join(small(larger, SMALL), "token").select("token", "df", "least", "node", "n"))
    met = groups.where("df = 2").select("a", "b").unionByName(members.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))).distinct()
    for x in ("a", "b"):
        met = met.join(small(joined.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")), SMALL), x, "left")
    met = met.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b").join(small(grid, SMALL), ["a", "b"], "left_anti")
    met = materialize(possible(materialize(met), tuples, similarity))
    first = materialize(near.unionByName(alike(met, texts_of(met), width, similarity)))
    roots = materialize(components(first))
    placed = members.join(roots, "node", "left").select("token", "df", "node", "n", F.coalesce("root", "node").alias("comp"))
    # cells whose texts are not all joined yet; of cells with the same texts one
    apart = placed.groupBy("token", "df").agg((F.min("comp") != F.max("comp")).alias("open"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("texts"))
    apart = materialize(apart.where("open").groupBy("df", "texts").agg(F.min("token").alias("token")).select("token"))
    rest = materialize(placed.join(small(apart, SMALL), "token").select("token", layer_of(F.col("n"), similarity).alias("layer"), "node", "n", "comp"))
    sizes = rest.groupBy("token", "layer").agg(F.count("*").alias("size"))
    full = materialize(sizes.where(F.col("size") > CROWD).select("token", F.explode(F.array(F.col("layer") - 1, "layer", F.col("layer") + 1)).alias("layer")).distinct())
    # texts in cells of a layer that is not crowded and whose neighbours are not
    few = materialize(rest.join(small(full, SMALL), ["token", "layer"], "left_anti"))
    x = few.withColumn("to", F.explode(F.array("layer", F.col("layer") + 1))).alias("x")
    y = few.alias("y")
    sized = (F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n")) & (F.col("x.comp") != F.col("y.comp"))
    once = (F.col("x.layer") < F.col("y.layer")) | (F.col("x.node") < F.col("y.node"))
    pairs = shuffled(x).join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.to") == F.col("y.layer")) & once & sized).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    pairs = materialize(possible(materialize(pairs.join(small(met.unionByName(grid), SMALL), ["a", "b"], "left_anti")), tuples, similarity))
    second = alike(pairs, texts_of(pairs), width, similarity)
    # the crowded cells, their neighbours, and the neighbours of those, which meet them
    near = materialize(full.select("token", F.explode(F.array(F.col("layer") - 1, "layer", F.col("layer") + 1)).alias("layer")).distinct())
    crowd = materialize(rest.join(small(near, SMALL), ["token", "layer"], "left_semi"))
    found = first.unionByName(second)
    if not crowd.isEmpty():
        nodes = crowd.select(F.col("node").alias("a"), F.col("node").alias("b"))
        found = found.unionByName(crowd_links(crowd, texts_of(nodes), width, similarity))
    return components(found)


def text_groups(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """``docs(doc_id, text)`` as ``doc_id, body, first``: the text's hash and the least (doc_id, body) of its group."""
    session(docs)
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = materialize(signatures(own, width, similarity, bucket_classes(own, width)))
    tuples = materialize(keyed.groupBy("node").agg(F.min(F.struct("doc_id", "body")).alias("rep"), F.first(F.struct("n", "counts", "prefix", "fp")).alias("s")).select("node", "rep", "s.n", "s.counts", "s.prefix", "s.fp"))

    def texts_of(pairs: DataFrame) -> DataFrame:
        """``node, text`` of the texts in ``pairs``."""
        needed = materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(tuples, "node").select("node", F.col("rep.doc_id").alias("d"), F.col("rep.body").alias("h")))
        found = own.join(small(needed, SMALL), (F.col("doc_id") == F.col("d")) & (F.xxhash64("text") == F.col("h")))
        return materialize(found.select("node", "text").dropDuplicates(["node"]))

    roots = links(tuples.select("node", "n", "counts", "prefix", "fp"), texts_of, width, similarity)
    groups = materialize(tuples.select("node", "rep").join(roots, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root")))
    firsts = materialize(groups.groupBy("root").agg(F.min("rep").alias("first")))
    named = materialize(groups.join(firsts, "root").select("node", "first"))
    return keyed.select("doc_id", "body", "node").join(named, "node").select("doc_id", "body", "first")


def similar_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, component_id`` over links of similar texts.

    Words are as for fingerprints (A-Z in lower case). Null text counts as empty; texts
    without words are alike. Rows with null ``doc_id`` are left out; repeated rows come
    back as often as they came; an empty table gives an empty result. All links are found
    but for equal 48-bit hashes of different shingles.
    """
    return text_groups(docs, width, similarity).select("doc_id", F.col("first.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group of near duplicates, with all columns of ``docs``.

    The text kept is the one with the group's smallest (``doc_id``, text hash); of
    repeated rows one stays, and other texts under the same id are judged on their own.
    Documents with null id are never matched to others and stay. An empty table stays empty.
    """
    found = materialize(text_groups(docs, width, similarity).groupBy("doc_id", "body", "first").agg(F.count("*").alias("n")))
    key = lambda df, *more: df.select(F.col("doc_id").alias("_vs_d"), F.col("body").alias("_vs_h"), *more)
    here = (F.col("doc_id").cast("long") == F.col("_vs_d")) & (F.col("_vs_body") == F.col("_vs_h"))
    gone = materialize(key(found.where(F.struct("doc_id", "body") != F.col("first"))))
    twice = materialize(key(found.where("n > 1")))
    rows = docs.where("doc_id is not null").withColumn("_vs_body", F.xxhash64("text")).join(small(gone, SMALL), here, "left_anti")
    once = rows.join(small(twice, SMALL), here, "left_anti").unionByName(rows.join(small(twice, SMALL), here, "left_semi").dropDuplicates(["doc_id", "_vs_body"]))
    return once.select(*docs.columns).unionByName(docs.where("doc_id is null"))
