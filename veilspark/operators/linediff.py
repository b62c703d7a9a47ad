"""Line differences in space linear in the lines and time linear in lines times edits.

Counted from the end, the furthest point that d edits reach on each diagonal is all that is kept of
a step. The steps are needed again in falling order, while the walk from the beginning uses up its edits; they are computed
forth once to find their number and then segment by segment from a few kept ones, recursively, so
only ``KEPT`` of them are held at each level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

KEPT = 32
FAR = np.iinfo(np.int64).max // 2


def common_before(a: np.ndarray, b: np.ndarray, i: int, j: int) -> int:
    """How many lines before positions i and j are equal."""
    n, size = 0, 64
    while True:
        size = min(size, i - n, j - n)
        if size <= 0:
            return n
        apart = np.flatnonzero(a[i - n - size : i - n] != b[j - n - size : j - n])
        if len(apart):
            return n + size - 1 - int(apart[-1])
        n += size
        size *= 2


def slid(a: np.ndarray, b: np.ndarray, at: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Points on diagonals ``k`` moved back over equal lines: all at once for a few lines, then the longer runs one by one."""
    at = at.copy()
    live = np.flatnonzero((at < FAR) & (at > 0) & (at - k > 0))
    for _ in range(4):
        i = at[live]
        live = live[a[i - 1] == b[i - k[live] - 1]]
        at[live] -= 1
        live = live[(at[live] > 0) & (at[live] - k[live] > 0)]
    for x in live.tolist():
        at[x] -= common_before(a, b, int(at[x]), int(at[x] - k[x]))
    return at


def step(a: np.ndarray, b: np.ndarray, d: int, before: np.ndarray | None) -> np.ndarray:
    """The least i on the diagonals K - d, K - d + 2, ..., K + d (K = len(a) - len(b)) from which d edits lead to the end."""
    k = len(a) - len(b) - d + 2 * np.arange(d + 1)
    if before is None:
        return slid(a, b, np.array([len(a)]), k)
    at = np.full(d + 1, FAR)
    deleted = np.where((before < FAR) & (before > 0), before - 1, FAR)  # a line of the old text more
    at[:-1] = deleted
    inserted = np.where((before < FAR) & (before - k[1:] >= 0), before, FAR)  # a line of the new text more
    at[1:] = np.minimum(at[1:], inserted)
    return slid(a, b, at, k)


def falling(a: np.ndarray, b: np.ndarray, low: int, start: np.ndarray, high: int) -> Iterator[np.ndarray]:
    """The steps from ``high`` down to ``low``, of which ``start`` is given."""
    size = max(1, -(-(high - low) // KEPT))
    marks, now = [(low, start)], start
    for d in range(low + 1, high + 1):
        now = step(a, b, d, now)
        if (d - low) % size == 0:
            marks.append((d, now))
    last = high
    for d, held in reversed(marks):
        if last > d:
            yield from falling(a, b, d + 1, step(a, b, d + 1, held), last) if last - d > 1 else iter([step(a, b, d + 1, held)])
        yield held
        last = d - 1


def line_diff(old: list[str], new: list[str]) -> list[tuple[str, str]]:
    """Operations that turn one list of lines into another over a longest common subsequence; deletions first on ties.

    Lines that only one side has take no part in the search.
    """
    number = {x: k for k, x in enumerate(dict.fromkeys([*old, *new]))}
    a, b = (np.array([number[x] for x in lines], np.int64) for lines in (old, new))
    same = min(len(a), len(b))
    apart = np.flatnonzero(a[:same] != b[:same])
    head = int(apart[0]) if len(apart) else same
    out = [("equal", x) for x in old[:head]]
    a, b, old, new = a[head:], b[head:], old[head:], new[head:]
    in_both = np.zeros(len(number), bool)
    in_both[np.intersect1d(a, b)] = True
    kept_a, kept_b = in_both[a], in_both[b]
    x, y = a[kept_a], b[kept_b]
    n, m, d = len(x), len(y), 0
    first = now = step(x, y, 0, None)
    while not (abs(n - m) <= d and (d - (n - m)) % 2 == 0 and now[(d - (n - m)) // 2] <= 0):
        d += 1
        now = step(x, y, d, now)
    left, steps = d, falling(x, y, 0, first, d)
    next(steps)
    reach = next(steps, None)  # the step of one edit less than are left
    i = j = p = q = 0  # places in all lines, and in those that both sides have
    while i < len(a) and j < len(b):
        if not kept_a[i]:
            out.append(("delete", old[i]))
            i += 1
            continue
        if a[i] == b[j]:
            out.append(("equal", old[i]))
            i, j, p, q = i + 1, j + 1, p + 1, q + 1
            continue
        t = (p + 1 - q - (n - m) + left - 1) // 2
        if 0 <= t < left and reach[t] <= p + 1:
            out.append(("delete", old[i]))
            i, p = i + 1, p + 1
        else:
            out.append(("insert", new[j]))
            j += 1
            if not kept_b[j - 1]:
                continue
            q += 1
        left -= 1
        reach = next(steps, None)
    return [*out, *(("delete", x) for x in old[i:]), *(("insert", x) for x in new[j:])]


def lines_of(text: Column) -> Column:
    """The lines of a text: ends of lines are no part of them, and the last end begins no line."""
    parts = F.split(F.regexp_replace(text, "\r\n", "\n"), "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def line_ops(old: Column, new: Column) -> Column:
    """The operations of ``line_diff`` between two columns of lines as ``array<struct<op, line>>``; null lists count as empty."""

    def each(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for before, after in batches:
            yield pd.Series([line_diff([] if a is None else list(a), [] if b is None else list(b)) for a, b in zip(before, after, strict=True)])

    return F.pandas_udf(each, "array<struct<op:string,line:string>>")(old, new)
