"""Links of glossary terms in texts, by Aho-Corasick automata.

Up to ``most`` terms make one automaton, built once per worker from a broadcast list. More terms are never in one
place: texts are cut into chunks of about ``CHUNK`` bytes, a chunk's windows that pass small bit tables of all terms give hashes, these are joined
with the terms' own hashes, and each chunk meets an automaton of the terms joined to it. The tables only spare rows of that
join, and the automaton compares characters, so equal hashes of different strings change nothing. Each text is searched once, whatever the number of terms.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import short_batches, spread, stored

LINKS = "array<struct<start:int,end:int,term:string>>"
MOST_TERMS = 50_000
#: Bytes and rows of a chunk of texts.
CHUNK, CHUNK_ROWS = 1 << 20, 20_000
#: Places whose beginnings are looked up at a time, few enough for a processor's cache.
BLOCK = 1 << 15
#: Bytes of a term by which it is first known (the first byte where it has fewer), most bytes that are hashed, and binary logarithms of the sizes of the tables of longer beginnings and of hashes.
HEAD, LONGEST, HEADS, FEWEST_BITS, MOST_BITS = 6, 48, 20, 16, 26
#: Where the bits of a hash begin that name its bits in the table of hashes.
PROBES = (0, 32)
STYLES = ("markdown", "html", "wiki")

_BUILT: dict[str, ahocorasick.Automaton] = {}


def automaton(name: str, terms: list[str]) -> ahocorasick.Automaton:
    """This worker's automaton of a list of terms; the last one built is kept."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = built_of(terms)
    return _BUILT[name]


def built_of(terms: list[str]) -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for t in terms:
        built.add_word(t, t)
    built.make_automaton()
    return built


def occurrences(built: ahocorasick.Automaton, text: str) -> list[tuple[int, int, str]]:
    """Start, end and term of every literal occurrence; those of one term do not overlap each other."""
    out, last = [], {}
    if len(built):
        for stop, term in built.iter(text):
            start = stop + 1 - len(term)
            if start >= last.get(term, 0):
                last[term] = stop + 1
                out.append((start, stop + 1, term))
    return out


def chosen(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Earliest first, then longest, none overlapping."""
    out, cursor = [], 0
    for start, end, term in sorted(found, key=lambda m: (m[0], -m[1])):
        if start >= cursor:
            out.append((start, end, term))
            cursor = end
    return out


def linked(docs: DataFrame, terms: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """``docs(doc_id, text)`` with ``links`` (start and end in code points, term): occurrences of ``terms(term)``, earliest, then longest.

    ``gaps`` are the pieces of the text before, between and after its links, ``anchors`` the anchors of the links' terms. A term is any string,
    of several words and marks too; null and empty terms are none. Null text counts as empty. Rows of one id and text have the same links, and come back as often as they came.
    """
    short_batches(docs.sparkSession)
    own = stored(terms.where("term <> ''").select("term").distinct())
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return matches(texts, own) if own.count() <= most else met(texts, own)


def with_links(doc_ids, texts, built: ahocorasick.Automaton) -> dict:
    """Columns ``doc_id, text, links, gaps, anchors`` of some texts."""
    start, end, term, gaps, ends, cuts = [], [], [], [], [0], [0]
    for text in texts.to_pylist():
        cursor = 0
        for a, b, t in chosen(occurrences(built, text)):
            start.append(a)
            end.append(b)
            term.append(t)
            gaps.append(text[cursor:a])
            cursor = b
        gaps.append(text[cursor:])
        ends.append(len(start))
        cuts.append(len(gaps))
    own = pa.array(term, pa.string())
    each = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32()), own], ["start", "end", "term"])
    known = own.dictionary_encode()  # each term's anchor is made once, as ``anchor`` makes it
    anchors = pc.replace_substring_regex(pc.ascii_lower(known.dictionary), "[^a-z0-9]", "-").take(known.indices)
    lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), x) for at, x in ((ends, each), (cuts, pa.array(gaps, pa.string())), (ends, anchors))]
    return {"doc_id": doc_ids, "text": texts, "links": lists[0], "gaps": lists[1], "anchors": lists[2]}


def linked_schema(texts: DataFrame) -> str:
    return f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, text string, links {LINKS}, gaps array<string>, anchors array<string>"


def matches(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``doc_id, text, links, gaps, anchors`` by one automaton of ``terms``, which the caller has bounded."""
    listed = texts.sparkSession.sparkContext.broadcast([r["term"] for r in terms.collect()])
    name = f"{listed.id if hasattr(listed, 'id') else id(listed)}"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = automaton(name, listed.value)
        for batch in batches:
            yield pa.RecordBatch.from_pydict(with_links(batch.column("doc_id"), batch.column("text"), built))

    return texts.mapInArrow(each, linked_schema(texts))


class Windows:
    """Hashes of any windows of one string of bytes."""

    POWER = 0x9E3779B97F4A7C15
    UNDO = pow(POWER, -1, 1 << 64)
    _steps: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def __init__(self, data: bytes):
        self.size = len(data)
        if len(Windows._steps[0]) < self.size + 1:
            Windows._steps = tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(self.size + (self.size >> 2), x, np.uint64)]) for x in (self.POWER, self.UNDO))
        terms = (np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * Windows._steps[0][: self.size]
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))

    def at(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return self.mixed((self.sums[start + length] - self.sums[start]) * Windows._steps[1][start] + np.asarray(length).astype(np.uint64))

    def all(self, length: int, begin: int = 0, most: int | None = None) -> np.ndarray:
        """Those of every place, or of ``most`` places from ``begin`` on, as ``at`` gives them."""
        stop = max(begin, self.size - length + 1)
        stop = stop if most is None else min(stop, begin + most)
        return self.mixed((self.sums[begin + length : stop + length] - self.sums[begin:stop]) * Windows._steps[1][begin:stop] + np.uint64(length))

    @staticmethod
    def mixed(h: np.ndarray) -> np.ndarray:
        for shift in (32, 29):
            h ^= h >> np.uint64(shift)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return h


def candidates(data: bytes, lengths: list[int], firsts: np.ndarray, heads: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Hashes of the windows of the given lengths that pass the tables: all those of terms are among them."""

    def places(parts: Iterable[np.ndarray], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where terms may begin, of all places' slots in a table, and the bits of their lengths; few places need the wide table."""
        at, kinds, some, begin = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], table != 0, 0
        for slots in parts:
            here = np.flatnonzero(some[slots])
            at.append(here + begin)
            kinds.append(table[slots[here]])
            begin += len(slots)
        return np.concatenate(at), np.concatenate(kinds)

    windows, found = Windows(data), []
    short = places([np.frombuffer(data, np.uint8)], firsts)
    long = places((windows.all(HEAD, k, BLOCK) >> np.uint64(64 - HEADS) for k in range(0, windows.size, BLOCK)), heads)
    for n in lengths:
        at, kinds = short if n < HEAD else long
        some = at[(kinds >> np.uint64(n)) & np.uint64(1) != 0]
        h = windows.at(some[some + n <= windows.size], n)
        for shift in PROBES:
            slot = (h >> np.uint64(shift)) & np.uint64(64 * len(bits) - 1)
            h = h[(bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0]
        found.append(np.unique(h))
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def met(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``doc_id, text, links, gaps, anchors``, each chunk of texts by an automaton of the terms whose hashes are those of its windows."""
    spark = texts.sparkSession

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.encode() for t in batch.column("term").to_pylist()]
            size = np.array([len(x) for x in raw], np.int64)
            n, windows = np.minimum(size, LONGEST), Windows(b"".join(raw))
            first = np.cumsum(size) - size
            head = np.where(n < HEAD, [x[0] for x in raw], (windows.at(first, np.minimum(n, HEAD)) >> np.uint64(64 - HEADS)).astype(np.int64))
            yield pa.RecordBatch.from_pydict({"term": batch.column("term"), "n": pa.array(n), "head": pa.array(head), "h": pa.array(windows.at(first, n).view(np.int64))})

    keyed = stored(spread(terms).mapInArrow(hashed, "term string, n long, head long, h long"))
    lengths = sorted(r["n"] for r in keyed.select("n").distinct().collect())
    size = 1 << min(max((16 * keyed.count()).bit_length(), FEWEST_BITS), MOST_BITS)

    def table(rows: DataFrame, slot: Column, bit: Column, slots: int) -> np.ndarray:
        """``slots`` words of 64 bits, whatever the number of rows."""
        got = rows.groupBy(slot.alias("slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))).alias("word")).toArrow()
        out = np.zeros(slots, np.int64)
        out[got.column("slot").to_numpy()] = got.column("word").to_numpy()
        return out.view(np.uint64)

    probed = keyed.select(F.explode(F.array(*[F.shiftrightunsigned("h", k) for k in PROBES])).alias("h"))
    word = F.shiftright(F.col("h").bitwiseAND(F.lit(size - 1)), 6)
    known = [table(keyed.where(few), F.col("head"), F.col("n"), slots) for few, slots in ((F.col("n") < HEAD, 256), (F.col("n") >= HEAD, 1 << HEADS))]
    tables = spark.sparkContext.broadcast((*known, table(probed, word, F.col("h").bitwiseAND(F.lit(63)), size // 64)))

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size, rows = TaskContext.get().partitionId() << 32, [], 0, 0

        def made() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            texts = whole.column("text").combine_chunks()
            found = candidates("\n".join(texts.to_pylist()).encode(), lengths, *tables.value)
            ends = np.full(len(texts) + 1, len(found), np.int32)
            ends[0] = 0
            hashes = pa.ListArray.from_arrays(pa.array(ends), pa.array(found.view(np.int64)))
            return pa.RecordBatch.from_pydict({"chunk": pa.array(np.full(len(texts), number)), "doc_id": whole.column("doc_id").combine_chunks(), "text": texts, "hashes": hashes})

        for batch in batches:
            start = 0
            for k, n in enumerate(pc.binary_length(batch.column("text")).to_pylist()):
                size, rows = size + n, rows + 1
                if size >= CHUNK or rows >= CHUNK_ROWS:
                    held.append(batch.slice(start, k + 1 - start))
                    yield made()
                    number, held, size, rows, start = number + 1, [], 0, 0, k + 1
            if start < len(batch):
                held.append(batch.slice(start))
        if held:
            yield made()

    kind = texts.schema["doc_id"].dataType.simpleString()
    chunks = stored(texts.mapInArrow(chunked, f"chunk long, doc_id {kind}, text string, hashes array<long>"))
    own = chunks.select(F.col("chunk").alias("part"), F.explode("hashes").alias("h")).join(keyed.select("h", "term"), "h").select("part", "term")

    def each(rows: pa.Table, known: pa.Table) -> pa.Table:
        built = built_of(known.column("term").to_pylist())
        return pa.table(with_links(rows.column("doc_id").combine_chunks(), rows.column("text").combine_chunks(), built))

    return chunks.select("chunk", "doc_id", "text").groupBy("chunk").cogroup(own.groupBy("part")).applyInArrow(each, linked_schema(texts))


def anchor(term: Column) -> Column:
    """A term's anchor: ASCII letters in lower case and digits, every other character a dash."""
    letters = F.translate(term, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(letters, "[^a-z0-9]", "-")


def link(term: Column, style: str, mark: Column | None = None) -> Column:
    """A term's link in one of the styles; ``mark`` is its anchor, where that is known already."""
    mark = anchor(term) if mark is None else mark
    if style == "markdown":
        return F.concat(F.lit("["), term, F.lit("](#glossary-"), mark, F.lit(")"))
    if style == "html":
        return F.concat(F.lit('<a href="#glossary-'), mark, F.lit('">'), term, F.lit("</a>"))
    if style == "wiki":
        return F.concat(F.lit("[["), term, F.lit("]]"))
    raise ValueError(f"unknown style {style}")


def rendered(style: str) -> Column:
    """The text of a ``linked`` row with its links written in a style."""
    after = F.transform("links", lambda m, i: F.concat(link(m["term"], style, F.get("anchors", i)), F.get("gaps", i + 1)))
    return F.concat(F.get("gaps", F.lit(0)), F.array_join(after, ""))


def plain_links(text: str, terms: list[str]) -> list[tuple[int, int, str]]:
    """The links by plain scanning, for checks: occurrences of each term from left to right."""
    found = [(m.start(), m.end(), t) for t in terms if t for m in re.finditer(re.escape(t), text)]
    return chosen(found)
