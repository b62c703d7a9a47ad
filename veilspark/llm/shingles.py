"""Hashes of words and shingles of whole Arrow batches at once.

The texts of a batch lie in one buffer, so a few array operations hash all of their
words; a shingle's hash is a weighted sum of its words' hashes, finished by mixing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed together (a longer text is hashed alone).
SLICE = 1 << 19
#: Bits of a shingle's token; the bits above hold the number of its text in a slice.
TOKEN_BITS = 52
BASE = 0x5851F42D4C957F2D
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
BYTES = np.random.default_rng(7).integers(0, 2**64, 256, np.uint64) * ~WHITE
POWERS = np.multiply.accumulate(np.full(4096, BASE, np.uint64))
PLACES = np.random.default_rng(8).integers(0, 2**64, 64, np.uint64) | np.uint64(1)


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the places where each begins, with the end of the last; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or ends[0] == ends[-1]:
        return np.empty(0, np.uint8), ends - ends[0]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def slices(column: pa.Array, most: int = 1000) -> Iterator[tuple[int, pa.Array]]:
    """Runs of a column's texts of about ``SLICE`` bytes and at most ``most`` texts: ``(first, texts)``."""
    size = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))))
    at = 0
    while at < len(column):
        end = min(max(at + 1, int(np.searchsorted(size, size[at] + SLICE, "right")) - 1), at + most, len(column))
        yield at, column.slice(at, end - at)
        at = end
    pa.default_memory_pool().release_unused()  # workers live on and serve other stages


def word_bounds(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and text number of each word; no word reaches over the end of a text."""
    inside = ~WHITE[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = ends[:-1][ends[:-1] < len(buf)]
    first[at] = inside[at]
    at = ends[1:][ends[1:] > 0] - 1
    last[at] = inside[at]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(ends[1:], start, "right")


def word_hashes(buf: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes; white space counts nothing."""
    if not len(start):
        return np.empty(0, np.uint64)
    place = np.arange(len(buf) - start[0]) - np.repeat(start - start[0], np.diff(start, append=len(buf)))
    with np.errstate(over="ignore"):
        return np.add.reduceat(BYTES[buf[start[0] :]] * POWERS[place & 4095], start - start[0])


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes spread over all bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each shingle of lower-cased words, repeats included; of shorter texts the whole sequence."""
    buf, ends = buffer(column)
    start, _, doc = word_bounds(buf, ends)
    h = word_hashes(LOWER[buf], start)
    n = np.bincount(doc, minlength=len(column))
    with np.errstate(over="ignore"):
        if len(h) >= width:
            whole = doc[: len(doc) - width + 1] == doc[width - 1 :]
            total = sum((h[j : len(h) - width + 1 + j] * PLACES[j] for j in range(1, width)), h[: len(h) - width + 1] * PLACES[0])
            out, of = mixed(total[whole]), doc[: len(doc) - width + 1][whole]
        else:
            out, of = np.empty(0, np.uint64), np.empty(0, np.int64)
        short = np.flatnonzero((n > 0) & (n < width))
        if len(short):
            begin = (np.cumsum(n) - n)[short]
            sums = np.zeros(len(short), np.uint64)
            for j in range(width - 1):
                has = n[short] > j
                sums[has] += h[begin[has] + j] * PLACES[j]
            out, of = np.concatenate((out, mixed(sums + n[short].astype(np.uint64)))), np.concatenate((of, short))
    return of, out


def token_sets(column: pa.Array, width: int, classes: np.ndarray | None = None) -> np.ndarray:
    """Distinct shingles of each text as ascending keys: text number in the bits above ``TOKEN_BITS``, token below.

    ``classes`` (a number from 0 to 15 by the lowest bits of the hash) become the token's
    top four bits, so that tokens of a low class come first in every text.
    """
    of, h = shingle_hashes(column, width)
    token = h >> np.uint64(64 - TOKEN_BITS + 4)
    if classes is not None:
        token |= classes[token & np.uint64(len(classes) - 1)].astype(np.uint64) << np.uint64(TOKEN_BITS - 4)
    keys = np.sort((of.astype(np.uint64) << np.uint64(TOKEN_BITS)) | token)
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


def split(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and tokens of such keys."""
    return (keys >> np.uint64(TOKEN_BITS)).astype(np.int64), (keys & np.uint64(2**TOKEN_BITS - 1)).astype(np.int64)
