"""Token ids as canonical, length-limited Huffman code in independent blocks.

Code lengths come from the counts of all ids (package-merge, at most ``MAX_BITS``)
and alone define the code. A block holds whole documents, about ``BLOCK_TOKENS``
ids of one code stream, with the bit offset of every ``STRIDE``-th id. Decoding
starts at all those offsets at once and reads one id per step from a table indexed by
the next ``MAX_BITS`` bits, so any block, or any stretch of one, is read alone.

A file set is a folder with two Parquet tables: ``lengths`` (the code lengths,
indexed by id, one row) and ``blocks``. Documents are in ascending ``doc_id`` over
the parts and blocks, null ids last.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, session, shared_dir
from .tokens import keyed, tokenize

MAX_BITS = 20
BLOCK_TOKENS = 1 << 18
STRIDE = 128
BLOCKS = "part int, block int, start long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, offsets array<long>, payload binary"


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits; 0 for ids that never occur.

    Package-merge: at each level the symbols, by weight, are merged with the pairs of
    the level below; the 2n - 2 cheapest at the top say how often each symbol is
    taken, which is its length. A single symbol gets one bit.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("the limit is too short for so many symbols")
    used = used[np.lexsort((used, counts[used]))]
    weight = counts[used].astype(np.int64)
    level, is_pair = weight, []
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate((weight, pairs))
        order = np.argsort(both, kind="stable")
        is_pair.append(order >= len(weight))
        level = both[order]
    depth, take = np.zeros(len(used) + 1, np.int64), 2 * len(used) - 2
    for flags in reversed(is_pair):
        n_pairs = int(flags[:take].sum())
        depth[take - n_pairs] += 1
        take = 2 * n_pairs
    depth[take] += 1
    lengths[used] = np.cumsum(depth[::-1])[::-1][1:]
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), each the successor of the one before."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    top = int(lengths.max(initial=0))
    step = np.uint64(1) << (np.uint64(top) - lengths[used].astype(np.uint64))
    codes[used] = (np.cumsum(step) - step) >> (np.uint64(top) - lengths[used].astype(np.uint64))
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each value of the next ``bits`` bits: the id that they begin with and its code's length."""
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    bits = int(lengths.max(initial=0))
    repeat = np.int64(1) << (bits - lengths[used].astype(np.int64))
    ids, sizes = np.zeros(1 << bits, np.uint32), np.ones(1 << bits, np.int64)
    total = int(repeat.sum())
    ids[:total], sizes[:total] = np.repeat(used, repeat), np.repeat(lengths[used], repeat)
    return ids, sizes, bits


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Big-endian bit stream in 32-bit words, and the bit offset of every STRIDE-th id."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    word = starts >> 5
    window = codes[ids] << (64 - (starts & 31) - size).astype(np.uint64)
    out = np.zeros((int(ends[-1]) + 31 >> 5) + 1, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] |= np.bitwise_or.reduceat(window >> np.uint64(32), first)
    out[word[first] + 1] |= np.bitwise_or.reduceat(window & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes(), starts[::STRIDE]


def decode(payload: bytes, offsets: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The n ids of a block: all stretches in step, one table look-up for each id."""
    ids, sizes, bits = table
    words = np.concatenate((np.frombuffer(payload, ">u4").astype(np.uint64), np.zeros(2, np.uint64)))
    at = np.array(offsets, np.int64)
    out = np.zeros((STRIDE, len(at)), np.uint32)
    mask, end = np.uint64((1 << bits) - 1), (len(words) - 2) * 32
    for step in range(STRIDE):
        word = at >> 5
        window = (words[word] << np.uint64(32)) | words[word + 1]
        key = (window >> (64 - bits - (at & 31)).astype(np.uint64)) & mask
        out[step] = ids[key]
        at = np.minimum(at + sizes[key], end)
    return out.T.reshape(-1)[:n]


def flat_ids(column: pa.Array, width: int) -> np.ndarray:
    """The ids of all documents of a batch, one after the other."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], f"<u{width}")[ends[0] // width : ends[-1] // width] if len(column) and column.buffers()[2] else np.empty(0, f"<u{width}")


def count_ids(tokens: DataFrame, vocabulary: int, width: int) -> np.ndarray:
    """How often each id occurs over all documents; the driver receives one row per id at most."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            total += np.bincount(flat_ids(batch.column("ids"), width), minlength=vocabulary)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    counts = np.zeros(vocabulary, np.int64)
    for row in tokens.select("ids").mapInArrow(each, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row["id"]] = row["n"]
    return counts


def write(tokens: DataFrame, path: str, vocabulary: int, width: int, part_tokens: int = 4_000_000) -> None:
    """Write ``tokens(doc_id, h, n, ids)`` as a file set below ``path``."""
    spark = tokens.sparkSession
    counts = count_ids(tokens, vocabulary, width)
    lengths = code_lengths(counts)
    spark.createDataFrame([(lengths.tobytes(),)], "lengths binary").coalesce(1).write.parquet(f"{path}/lengths")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, held, n, block, start = canonical_codes(lengths), [], 0, 0, 0
        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary())])

        def done(part: int) -> pa.RecordBatch:
            ids = np.concatenate([x for _, x in held])
            payload, offsets = encode(ids, lengths, codes)
            row = {"part": part, "block": block, "start": start, "n_tokens": n, "doc_ids": [d for d, _ in held], "doc_tokens": [len(x) for _, x in held], "offsets": offsets, "payload": payload}
            return pa.RecordBatch.from_pylist([row], schema)

        part = 0
        for batch in batches:
            ids, at = flat_ids(batch.column("ids"), width), 0
            for part, doc_id, size in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), (pc.binary_length(batch.column("ids")).to_numpy() // width).tolist(), strict=True):
                held.append((doc_id, ids[at : at + size]))
                at, n = at + size, n + size
                if n >= BLOCK_TOKENS:
                    yield done(part)
                    held, n, block, start = [], 0, block + 1, start + n
        if held:
            yield done(part)

    parts = max(1, -(-int(counts.sum()) // part_tokens))
    dealt = tokens.select("doc_id", "h", "ids").repartitionByRange(parts, F.col("doc_id").asc_nulls_last(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "h")
    dealt.select(F.spark_partition_id().alias("part"), "doc_id", "ids").mapInArrow(each, BLOCKS).write.parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a file set: ``doc_id, start, n_tokens, ids_crc32``, with ids read from the code."""
    lengths = np.frombuffer(spark.read.parquet(f"{path}/lengths").first()["lengths"], np.uint8)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = decode_table(lengths)
        for batch in batches:
            for x in batch.itertuples(index=False):
                ids = decode(x.payload, x.offsets, x.n_tokens, table)
                ends = np.cumsum(x.doc_tokens)
                starts = ends - x.doc_tokens
                crc = [zlib.crc32(np.ascontiguousarray(ids[a:b])) for a, b in zip(starts, ends, strict=True)]
                yield pd.DataFrame({"doc_id": pd.array(x.doc_ids, dtype="Int64"), "start": x.before + x.start + starts, "n_tokens": x.doc_tokens, "ids_crc32": crc})

    whole = blocks.join(before, "part").select("start", "n_tokens", "doc_ids", "doc_tokens", "offsets", "payload", "before")
    return whole.mapInPandas(each, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, vocabulary: int = 65_536) -> None:
    """Tokenize whole texts and write them as a file set below ``path``.

    Null text counts as empty (its ids are the end id alone). Documents with the same
    or a null ``doc_id`` follow each other by a hash of id and text; repeated rows are
    kept. An empty table gives a file set without blocks.
    """
    spark = session(docs)
    tokens = materialize(tokenize(keyed(docs, False), tokenizer, end_id).drop("source"))
    write(tokens, path, vocabulary, 2 if vocabulary <= 65_536 else 4)


def op9(spark, sf_dir):
    import public_tokenizers

    path = shared_dir(spark)
    encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), path)
    return read(spark, path)
