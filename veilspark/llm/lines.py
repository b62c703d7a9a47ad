"""Line dedup on content-defined chunks.

A text is cut into lines (after each newline, and after each sentence end within a
line, so that a passage set as one paragraph counts as several lines). A rolling
hash over the hashes of each two neighbouring lines puts a chunk boundary where it is
a multiple of ``EVERY``: boundaries depend on nearby lines alone and move with them.
A chunk of ``LEAST_LINES`` lines or more that occurs again anywhere is removed, after its bytes have been compared
with those of its first occurrence, which stays. Where fewer than that many of its lines end with a newline, so
that it is a lines' worth of short sentences, it must have ``LEAST_WORDS`` words.

Such chunks miss passages that hold none of them whole, so a rolling hash over words
gives seeds as well: of each ``REACH`` neighbouring runs of ``GRAM`` words the one with
the least hash. Any ``PASSAGE`` words in a row thus hold a whole seed that depends on
them alone (where few words repeat in turn, one seed for each ``REACH`` words is kept). Every match, chunk or seed, is compared by its bytes and extended
both ways, word by word, against its first occurrence; matches that touch are one
passage. It goes if it holds a repeated chunk or has ``PASSAGE`` words.

Hashes and positions are shuffled, never all texts by chunk. Documents that hold
first occurrences give the bytes of those with ``REACH`` words on either side (the next
seed of a passage starts no later); they travel to the documents that repeat them, where
matches at one distance share them. A copy of a whole text meets the whole first text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as H
from .common import materialize, session, small

EVERY, LEAST_LINES, LEAST_WORDS = 3, 2, 10
GRAM, PASSAGE = 12, 50
REACH = PASSAGE - GRAM + 1
#: Hashes of the white-space byte behind a word.
GAPS = np.random.default_rng(9).integers(0, 2**64, 256, np.uint64)
PLACE = "struct<doc_id:long,t:long,start:int,stop:int>"
ASK = f"array<struct<chunk:long,whole:boolean,first:{PLACE},run:int,shift:int,spans:array<int>>>"


def line_starts(buf: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where lines begin: at a text's start, after a newline, after a sentence end and a space."""
    cut = np.zeros(len(buf) + 1, bool)
    cut[1:] = buf == 10
    cut[2:] |= (buf[1:] == 32) & ((buf[:-1] == 46) | (buf[:-1] == 33) | (buf[:-1] == 63))
    after = ends[1:-1][ends[1:-1] + 1 < len(cut)]
    cut[after + 1] = (buf[after] == 10) if len(after) else False  # a sentence end of the text before is none of this one
    cut[ends[:-1]] = True
    return np.flatnonzero(cut[:-1])


def sliding(x: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """``of`` (minimum or maximum) over each ``width`` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x, done = of(x[:-step], x[step:]), done + step
    return x


def chunk_spans(buf: np.ndarray, ends: np.ndarray, words: np.ndarray, word_ends: np.ndarray, bare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of the first word, stop of the last and hash of the chunks that are removed when they repeat; words begin at ``words``, their hashes are ``bare``.

    Boundaries depend on words alone, a chunk's hash also on the white space between its words: chunks that differ in it have first occurrences of their own.
    """
    at = line_starts(buf, ends)
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    begin = np.searchsorted(words, at)
    n_words = np.diff(begin, append=len(words))
    full = n_words > 0
    number = np.arange(len(words)) - np.repeat(begin[full], n_words[full])
    with np.errstate(over="ignore"):
        h = np.ones(len(at), np.uint64)
        h[full] = np.add.reduceat(bare * H.POWERS[number & 4095], begin[full])
        new = np.zeros(len(at), bool)
        new[np.searchsorted(at, ends[:-1][ends[:-1] < len(buf)])] = True
        roll = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xBF58476D1CE4E5B9)
        first = np.flatnonzero(np.concatenate(([True], new[1:] | ((roll >> np.uint64(33)) % np.uint64(EVERY) == 0))))
        number = np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))
        gap = np.zeros(len(words), np.uint64)
        gap[:-1] = GAPS[buf[word_ends[:-1]]] * (words[1:] - word_ends[:-1]).astype(np.uint64) + H.mixed(GAPS[buf[words[1:] - 1]])
        bounds = np.append(begin[first], len(words))
        held = bounds[1:] > bounds[:-1]
        gap[bounds[1:][held] - 1] = 0  # what follows a chunk's last word is none of it
        place = np.arange(len(words)) - np.repeat(bounds[:-1][held], np.diff(bounds)[held])
        between = np.zeros(len(first), np.uint64)
        between[held] = np.add.reduceat(gap * H.POWERS[place & 4095], bounds[:-1][held])
        whole = H.mixed(np.add.reduceat(H.mixed(h) * H.POWERS[number & 4095], first) + between)
    own_line = buf[np.maximum(at, 1) - 1] == 10
    own_line[np.searchsorted(at, ends[:-1][ends[:-1] < len(buf)])] = True
    words_in = np.add.reduceat(n_words, first)
    plain = (np.add.reduceat(own_line.astype(np.int64), first) >= LEAST_LINES) & (words_in > 0)
    use = (np.diff(first, append=len(at)) >= LEAST_LINES) & (plain | (words_in >= LEAST_WORDS))
    return words[bounds[:-1][use]], word_ends[bounds[1:][use] - 1], whole[use] & np.uint64(2**64 - 2)


def seed_spans(buf: np.ndarray, start: np.ndarray, stop: np.ndarray, doc: np.ndarray, bare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words at which seeds begin, and the seeds' hashes (odd)."""
    if len(start) < PASSAGE:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    n = len(start) - GRAM + 1
    with np.errstate(over="ignore"):
        spaced = bare[:-1] + GAPS[buf[stop[:-1]]] * (start[1:] - stop[:-1]).astype(np.uint64)
        h = sum((spaced[j : j + n] * H.PLACES[j] for j in range(GRAM - 1)), bare[GRAM - 1 :] * H.PLACES[GRAM - 1])
    h = H.mixed(h) | np.uint64(1)
    least = sliding(h, REACH, np.minimum)
    least[doc[: len(least)] != doc[PASSAGE - 1 :]] = 0  # windows lie within one text
    edge = np.zeros(REACH - 1, np.uint64)
    best = sliding(np.concatenate((edge, least, edge)), REACH, np.maximum)
    at = np.flatnonzero(best == h)
    # where words repeat in turn, so that a seed follows its like, one of them for each REACH words is enough
    new = np.concatenate(([True], (h[at[1:]] != h[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]]))) if len(at) else np.empty(0, bool)
    stretch = (at - np.repeat(at[new], np.diff(np.flatnonzero(new), append=len(at)))) // REACH
    at = at[new | np.concatenate(([False], stretch[1:] != stretch[:-1]))] if len(at) else at
    return at, h[at]


def found_in(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Text number, start, stop, hash, words before and words in each chunk and seed of a column of texts."""
    buf, ends = H.buffer(column)
    start, stop, doc = H.word_bounds(buf, ends)
    bare = H.word_hashes(buf, start)
    low, high, chunk = chunk_spans(buf, ends, start, stop, bare)
    seed, h = seed_spans(buf, start, stop, doc, bare)
    first, last = np.searchsorted(start, low), np.searchsorted(start, high)
    first, words = np.concatenate((first, seed)), np.concatenate((last - first, np.full(len(seed), GRAM)))
    low, high = np.concatenate((low, start[seed])), np.concatenate((high, stop[seed + GRAM - 1] if len(seed) else seed))
    of = np.searchsorted(ends[1:], low, "right")
    return of, low - ends[:-1][of], high - ends[:-1][of], np.concatenate((chunk, h)), first - np.searchsorted(start, ends[:-1])[of], words


def spans(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, t, text)`` as a row per chunk or seed: ``chunk`` (its hash, odd for a seed), ``place``, ``word`` (words before it), ``words`` (in it)."""
    schema = pa.struct([("doc_id", pa.int64()), ("t", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in H.slices(batch.column("text"), len(batch)):
                of, low, high, chunk, word, words = found_in(part)
                row, small_int = pa.array(of + at), lambda x: pa.array(x.astype(np.int32))
                place = pa.StructArray.from_arrays([batch.column("doc_id").take(row), batch.column("t").take(row), small_int(low), small_int(high)], fields=list(schema))
                yield pa.RecordBatch.from_arrays([pa.array(chunk.view(np.int64)), place, small_int(word), small_int(words)], names=["chunk", "place", "word", "words"])

    return docs.select("doc_id", "t", F.col("text").cast("binary").alias("text")).mapInArrow(each, f"chunk long, place {PLACE}, word int, words int")


def thinned(t: int, chunk: np.ndarray, start: np.ndarray, stop: np.ndarray, word: np.ndarray, words: np.ndarray, firsts: list) -> list[dict]:
    """What a document asks of first occurrences, from its repeated spans.

    A copy of a whole text (hash ``t``) asks for that text. Else spans of one first document at one distance form a run;
    of a run just those are kept whose surroundings of ``REACH`` words hold all the others and theirs.
    """
    f_doc, f_t, f_start, f_stop = firsts
    whole = np.flatnonzero(f_t == t)
    first = lambda k: {"doc_id": None if f_doc[k] is None else int(f_doc[k]), "t": int(f_t[k]), "start": int(f_start[k]), "stop": int(f_stop[k])}
    if len(whole):
        k = whole[np.argmin(start[whole])]
        return [{"chunk": int(chunk[k]), "whole": True, "first": first(k), "run": 0, "shift": 0, "spans": []}]
    out, runs = [], {}
    for k in np.argsort(word, kind="stable").tolist():
        runs.setdefault((f_doc[k], f_t[k], start[k] - f_start[k]), []).append(k)
    for run, own in enumerate(runs.values()):
        own = np.array(own)
        low, high = word[own] - REACH, word[own] + words[own] + REACH
        kept, covered, at = [], low[0], 0
        while at < len(own):  # of the surroundings that overlap what is covered the one that reaches farthest
            near = at + 1
            while near < len(own) and low[near] < covered:
                near += 1
            kept.append(at + int(np.argmax(high[at:near])))
            covered, at = high[kept[-1]], kept[-1] + 1
            while at < len(own) and high[at] <= covered:
                at += 1
        flat = np.stack((start[own], stop[own], chunk[own] & 1), 1).astype(np.int64).ravel().tolist()
        for n, k in enumerate(own[kept].tolist()):
            out.append({"chunk": int(chunk[k]), "whole": False, "first": first(k), "run": run, "shift": int(start[k] - f_start[k]), "spans": [] if n else flat})
    return out


def windows(firsts: DataFrame) -> DataFrame:
    """``firsts(text, asked)`` as ``chunk, whole, low, bytes``: a first occurrence with ``REACH`` words around it, or the whole text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, asked in zip(batch.column("text").to_pylist(), batch.column("asked").to_pylist(), strict=True):
                buf = np.frombuffer(text, np.uint8)
                start, stop, _ = H.word_bounds(buf, np.array([0, len(buf)]))
                for x in asked:
                    if x["whole"]:
                        out.append((x["chunk"], True, 0, text))
                        continue
                    a, b = np.searchsorted(start, x["start"]) - REACH, np.searchsorted(stop, x["stop"], "left") + REACH
                    low = min(int(start[a]), x["start"]) if a > 0 else 0
                    high = max(int(stop[b]), x["stop"]) if b < len(stop) else len(text)
                    out.append((x["chunk"], False, low, text[low:high]))
            cols = zip(*out, strict=True) if out else [[]] * 4
            kinds = (pa.int64(), pa.bool_(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["chunk", "whole", "low", "bytes"])

    return firsts.select(F.col("text").cast("binary").alias("text"), "asked").mapInArrow(each, "chunk long, whole boolean, low int, bytes binary")


def equal_runs(buf: np.ndarray, ours: np.ndarray, low: int, other: np.ndarray, shift: int) -> list[tuple[int, int]]:
    """Ranges of ``buf`` that equal ``other`` (which begins at ``low`` of its text) moved by ``shift``, cut to whole words of both.

    ``ours`` says which bytes belong to words. Ranges inside ``other`` that are too short for any span are left out.
    """
    a, b = max(low + shift, 0), min(low + shift + len(other), len(buf))
    if a >= b:
        return []
    same = buf[a:b] == other[a - shift - low : b - shift - low]
    step = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    theirs = ~H.WHITE[other]
    pairs = step.reshape(-1, 2) + a
    pairs = pairs[(pairs[:, 1] - pairs[:, 0] >= 2 * LEAST_LINES - 1) | (pairs[:, 0] == a) | (pairs[:, 1] == b)]
    inside = lambda kind, k: 0 < k < len(kind) and kind[k - 1] and kind[k]
    out = []
    for x, y in pairs.tolist():
        own = ours[x:y]
        if inside(ours, x) or inside(theirs, x - shift - low):  # within a word: on to the next
            gap = np.flatnonzero(~own)
            x = x + int(gap[0]) if len(gap) else y
        if y > x and (inside(ours, y) or inside(theirs, y - shift - low)):
            gap = np.flatnonzero(~ours[x:y])
            y = x + int(gap[-1]) + 1 if len(gap) else x
        lead = np.flatnonzero(ours[x:y])
        if len(lead):
            out.append((x + int(lead[0]), y))
    return out


def cuts(text: bytes, whole: bool, asks: list[tuple]) -> list[dict]:
    """Byte ranges to remove from a text, given what it asked for: ``(run, shift, spans, low, bytes)`` of first occurrences."""
    if whole:
        same = asks[0][4] == text and (len(text.split()) >= PASSAGE or any(c & 1 == 0 for c in found_in(pa.array([text], pa.large_binary()))[3].tolist()))
        return [{"start": 0, "stop": len(text)}] if same else []
    buf = np.frombuffer(text, np.uint8)
    ours = ~H.WHITE[buf]
    found: list[tuple[int, int, bool]] = []
    for run in {x[0] for x in asks}:
        merged: list[list[int]] = []
        for low, high in sorted(r for n, shift, _, low, part in asks if n == run for r in equal_runs(buf, ours, low, np.frombuffer(part, np.uint8), shift)):
            if merged and low <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], high)
            else:
                merged.append([low, high])
        own = np.concatenate([x[2] for x in asks if x[0] == run]).reshape(-1, 3)
        for low, high in merged:
            held = own[(own[:, 0] >= low) & (own[:, 1] <= high)]
            if len(held):
                found.append((low, high, bool((held[:, 2] == 0).any())))
    out: list[list] = []
    for low, high, chunk in sorted(found):
        if out and low <= out[-1][1]:
            out[-1] = [out[-1][0], max(out[-1][1], high), out[-1][2] or chunk]
        else:
            out.append([low, high, chunk])
    return [{"start": a, "stop": b} for a, b, chunk in out if chunk or len(text[a:b].split()) >= PASSAGE]


def requests(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, t, text)``: ``doc_id, t, asks`` of each document with spans whose first occurrence is elsewhere."""
    found = materialize(spans(docs))
    seen = materialize(found.groupBy("chunk").agg(F.count("*").alias("n"), F.min("place").alias("first")).where("n > 1").select("chunk", "first"))
    again = found.join(seen, "chunk").where(F.col("place") != F.col("first"))

    def each(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([thinned(t, *map(np.asarray, x[:5]), [np.asarray(y) for y in x[5:]]) for t, *x in zip(*batch, strict=True)], dtype=object)

    flat = F.struct("chunk", F.col("place.start").alias("start"), F.col("place.stop").alias("stop"), "word", "words", F.col("first.doc_id").cast("string").alias("fd"), F.col("first.t").alias("ft"), F.col("first.start").alias("fs"), F.col("first.stop").alias("fe"))
    own = again.groupBy(F.col("place.doc_id").alias("doc_id"), F.col("place.t").alias("t")).agg(F.collect_set(flat).alias("own"))
    ask = F.pandas_udf(each, ASK)("t", *[f"own.{c}" for c in ("chunk", "start", "stop", "word", "words", "fd", "ft", "fs", "fe")])
    asks = materialize(own.select("doc_id", "t", F.explode(ask).alias("ask")).select("doc_id", "t", "ask.*"))
    wanted = asks.select("chunk", "whole", "first").distinct().groupBy(F.col("first.doc_id").alias("d"), F.col("first.t").alias("g")).agg(F.collect_list(F.struct("chunk", "whole", F.col("first.start").alias("start"), F.col("first.stop").alias("stop"))).alias("asked"))
    wanted = materialize(wanted)
    holders = docs.join(small(wanted.select("d", "g"), 100_000), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("g")), "left_semi").dropDuplicates(["doc_id", "t"])
    told = materialize(windows(holders.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("g"))).select("text", "asked")))
    return asks.join(told, ["chunk", "whole"]).groupBy("doc_id", "t").agg(F.collect_list(F.struct("whole", "run", "shift", "spans", "low", "bytes")).alias("asks"))


def without(text: bytes, removed: list[dict]) -> str:
    """The text less its cuts."""
    out, at = [], 0
    for c in removed:
        out.append(text[at : c["start"]])
        at = c["stop"]
    return b"".join([*out, text[at:]]).decode("utf-8", "replace")


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``, ``n_chars`` (if there) kept true, and
    ``_vs_cuts``: the byte ranges removed (null if none).

    The first occurrence is that of the least (doc_id, hash of the text, position), null ids first; a passage may
    also repeat within one text. Rows with the same id and text are one document: they share a decision and none is
    the other's repeat. Null and empty texts stay as they are; rows are all kept; an empty table stays empty. Chunks of
    fewer than ``LEAST_LINES`` lines, or of fewer written lines and ``LEAST_WORDS`` words, go only as part of a passage of ``PASSAGE`` words.
    """
    session(docs)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), F.col("text").cast("string").alias("text"))
    asks = requests(slim).select(F.col("doc_id").alias("_vs_d"), F.col("t").alias("_vs_g"), F.col("asks").alias("_vs_asks"))
    both = docs.withColumn("_vs_t", F.xxhash64("text")).join(asks, F.col("doc_id").cast("long").eqNullSafe(F.col("_vs_d")) & (F.col("_vs_t") == F.col("_vs_g")), "left")

    def each(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, whole, *asked in batches:
            found = [None if t is None else cuts(t, bool(w[0]), list(zip(*x, strict=True))) or None for t, w, *x in zip(texts, whole, *asked, strict=True)]
            yield pd.DataFrame({"cuts": pd.Series(found, dtype=object), "text": pd.Series([None if c is None else without(t, c) for t, c in zip(texts, found, strict=True)], dtype=object)})

    parts = [F.col(f"_vs_asks.{c}") for c in ("whole", "run", "shift", "spans", "low", "bytes")]
    changed = F.pandas_udf(each, "cuts array<struct<start:long,stop:long>>, text string")(F.when(F.col("_vs_asks").isNotNull(), F.col("text").cast("binary")), *parts)
    out = both.withColumn("_vs_out", changed).withColumn("_vs_cuts", F.col("_vs_out.cuts")).withColumn("text", F.coalesce("_vs_out.text", "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_vs_cuts").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return out.select(*docs.columns, "_vs_cuts")


def op5(spark, sf_dir):
    found = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    cuts = F.coalesce("_vs_cuts", F.array().cast("array<struct<start:long,stop:long>>"))
    removed = F.aggregate(cuts, F.lit(0).cast("long"), lambda s, c: s + c["stop"] - c["start"])
    spans = F.array_join(F.transform(cuts, lambda c: F.concat_ws(":", c["start"].cast("string"), c["stop"].cast("string"))), ",")
    return found.select("doc_id", F.size(cuts).cast("long").alias("n_chunks"), removed.alias("removed_bytes"), spans.alias("byte_spans"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))
