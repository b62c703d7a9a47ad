"""Token ids of whole texts, by the tokenizers library, inside Arrow batches.

Neither tokenizer used here has a token that reaches across a space which follows a
non-space character, from a letter to ASCII punctuation other than an apostrophe, or from a newline to a
letter, so a text's ids are those of its pieces cut at such places. A batch is cut
and dictionary-encoded by Arrow, and only pieces that the worker has not seen lately
go through the tokenizer. A text in which a space follows white space, or which holds the string of one of the
tokenizer's added tokens, goes through the tokenizer whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A space after white space, or the mark itself: what keeps a text from being cut.
SPACE = r"\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}"
UNCUT = rf"[{SPACE}] |\x{{01}}"
#: Letters that stay one letter when normalised and lower-cased.
LETTER = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]"
#: ASCII punctuation but the apostrophe: never in one token with a letter before it.
POINT = r"[!-&(-/:-@\[-`{-~]"
MARK = "\x01"
#: One word of such letters, with or without a space before it.
WORD = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
#: Byte-level alphabet: a byte that is no visible Latin-1 character stands as one of the characters from 256 on.
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
ALPHABET = {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - set(VISIBLE)))}

_CACHES: dict[str, Pieces] = {}


class Pieces:
    """Ids of the pieces that a worker process has met, dropped when they exceed ``limit``."""

    def __init__(self, path: str, limit: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.added = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.folds = "Lowercase" in str(self.tokenizer.normalizer)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() < 2**16 else "<u4")
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.n = self.used = 0
        self.start, self.length, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(8192, self.dtype)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text. One word, with or without a space before it, is one pre-token as it
        stands, so it goes to the merges directly, which saves two thirds of the time."""
        merges, plain = self.tokenizer.model.tokenize, list(map(WORD, texts))
        words = iter(self.shaped([x for x, p in zip(texts, plain, strict=True) if p]))
        rest = iter(self.tokenizer.encode_batch_fast([x for x, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        return [[t.id for t in merges(next(words))] if p else next(rest).ids for p in plain]

    def shaped(self, words: list[str]) -> list[str]:
        """Words as the merges take them: in lower case without their spaces, or with the space as a letter."""
        line = "\n".join(words)
        line = line.replace(" ", "").lower() if self.folds else line
        return line.encode().decode("latin-1").translate(ALPHABET).split(chr(ALPHABET[10]))

    def add(self, ids: list[list[int]]) -> range:
        """Store id lists; their numbers."""
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), self.dtype, int(lengths.sum()))
        for name, n, more in (("start", self.n, len(ids)), ("length", self.n, len(ids)), ("ids", self.used, len(flat))):
            if n + more > len(getattr(self, name)):
                setattr(self, name, np.concatenate((getattr(self, name)[:n], np.zeros(n + 2 * more, getattr(self, name).dtype))))
        self.length[self.n : self.n + len(ids)] = lengths
        self.start[self.n : self.n + len(ids)] = self.used + np.cumsum(lengths) - lengths
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.n += len(ids)
        return range(self.n - len(ids), self.n)

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """The number of each piece, with new ones encoded."""
        get = self.at.get
        found = [get(x, -1) for x in pieces]
        new = list(dict.fromkeys(x for x, n in zip(pieces, found, strict=True) if n < 0))
        if new:
            self.at.update(zip(new, self.add(self.encode(new)), strict=True))
            found = [n if n >= 0 else self.at[x] for x, n in zip(pieces, found, strict=True)]
        return np.array(found, np.int64)

    def batch(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each with ``end_id`` after it, and how many each has."""
        if len(self.at) > self.limit or self.used > 16 * self.limit:
            self.clear()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, f"{UNCUT}|{self.added}" if self.added else UNCUT).to_numpy(zero_copy_only=False)
        cut = pc.if_else(pa.array(whole), "", texts)
        if self.folds:
            cut = pc.ascii_lower(cut)
        cut = pc.replace_substring_regex(cut, rf"({LETTER})({POINT})", rf"\1{MARK}\2")
        cut = pc.replace_substring_regex(cut, rf"([^{SPACE}]\n)(\p{{L}})", rf"\1{MARK}\2")
        lists = pc.split_pattern(pc.replace_substring(cut, " ", f"{MARK} "), MARK)
        offsets = lists.offsets.to_numpy()
        words = lists.flatten().dictionary_encode()
        number = self.numbers(words.dictionary.to_pylist())[words.indices.to_numpy()]
        first = offsets[:-1] - offsets[0]
        for at in np.flatnonzero(whole):
            number[first[at]] = self.add([self.tokenizer.encode(texts[int(at)].as_py(), add_special_tokens=False).ids])[0]
        end = self.add([[end_id]])[0]
        number = np.insert(number, offsets[1:] - offsets[0], end)
        lengths = self.length[number]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        small = np.int32 if max(total, self.used) < 2**31 else np.int64
        at = np.repeat((self.start[number] - (ends - lengths)).astype(small), lengths)
        at += np.arange(total, dtype=small)
        ids = self.ids[at]
        doc_ends = ends[(offsets[1:] - offsets[0]) + np.arange(len(first))]
        return ids, np.diff(doc_ends, prepend=0)


def pieces(path: str) -> Pieces:
    """This worker's pieces for a tokenizer file."""
    if path not in _CACHES:
        _CACHES[path] = Pieces(path)
    return _CACHES[path]


def id_column(ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary value per document from ids that lie one after the other."""
    ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64) * ids.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(ids))]).cast(pa.binary())


def tokenize(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """``docs(doc_id, source, h, text)`` as ``doc_id, source, h, n, ids``.

    ``ids`` holds little-endian unsigned 16-bit ids (32-bit for vocabularies over
    65,536), the end id included; ``n`` is their number. Null text counts as empty.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        pa.default_memory_pool().release_unused()  # what other stages have left in this worker
        for batch in batches:
            if batch.num_rows:
                ids, n = own.batch(batch.column("text"), end_id)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("h"), pa.array(n, pa.int64()), id_column(ids, n)], names=["doc_id", "source", "h", "n", "ids"])

    return docs.select("doc_id", "source", "h", "text").mapInArrow(each, "doc_id long, source string, h long, n long, ids binary")


def keyed(docs: DataFrame, source: bool) -> DataFrame:
    """The columns that ``tokenize`` takes; ``h`` is a hash of id and text."""
    by = F.col("source").cast("string") if source else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), by.alias("source"), F.xxhash64("doc_id", "text").alias("h"), F.col("text").cast("string").alias("text"))
