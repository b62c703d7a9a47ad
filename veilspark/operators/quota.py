"""Sliding-window admission: rejected requests leave no trace in the window."""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def admit(times: list[float], held: deque, limit: int, window: float) -> list[tuple[bool, int]]:
    """For times in order: admitted or not, and seconds to wait (at least 1) if not."""
    out = []
    for t in times:
        while held and t - held[0] >= window:
            held.popleft()
        if len(held) < limit:
            held.append(t)
            out.append((True, 0))
        else:
            out.append((False, max(1, int(held[0] + window - t))))
    return out


def waits(times: list[float], held: list[float], limit: int, window: float) -> list[float | None]:
    """For each time None if admitted, else how long until the window that is full has room; ``held``, in order, gets the admitted ones.

    Times need not be in order: one that comes late is admitted if no window that it falls into would hold more than ``limit``,
    which only the ``limit`` admitted times on either side can decide.
    """
    out: list[float | None] = []
    for t in times:
        p = bisect_right(held, t)
        held.insert(p, t)
        full = next((i for i in range(max(0, p - limit), min(p, len(held) - limit - 1) + 1) if held[i + limit] - held[i] < window), None) if limit > 0 else p
        if full is None:
            out.append(None)
        else:
            del held[p]
            out.append(window if limit < 1 else max(0.0, (held[full] if full < p else t) + window - t))
    return out


def rate_limit(requests: DataFrame, limit: int, window: float = 60.0) -> DataFrame:
    """``requests(key, event_id, ts)`` with ``admitted`` and ``retry_after``, per key by (ts, event_id).

    Requests are dealt by key, sorted and read once; of a key only the admitted times of the window
    are held, ``limit`` at most, so a key of any number of requests needs no memory.
    """
    rows = requests.select("key", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).repartition("key").sortWithinPartitions("key", "at", "event_id")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, deque()
        for batch in batches:
            said = []
            for key, at in zip(batch.column("key").to_pylist(), batch.column("at").to_pylist(), strict=True):
                if (key,) != last:
                    last, held = (key,), deque()
                said += admit([at / 1e6], held, limit, window)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("event_id"), pa.array([a for a, _ in said], pa.bool_()), pa.array([r for _, r in said], pa.int64())], names=["key", "event_id", "admitted", "retry_after"])

    return rows.mapInArrow(each, f"key {requests.schema['key'].dataType.simpleString()}, event_id long, admitted boolean, retry_after long")
