"""Admission under a sliding-window limit as a stream: state and timers per tenant.

Needs the RocksDB state store (``PROVIDER`` as ``spark.sql.streaming.stateStore.providerClass``), as every arbitrary state with timers does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.quota import waits

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "tenant string, event_id long, admitted boolean, retry_after long"


class Admission(StatefulProcessor):
    """The admitted times of a tenant that can still matter: those of the last window, and of as long as events may come late.

    Rejected requests leave no trace. A timer clears a tenant once the watermark has passed its last admitted time by a window.
    """

    def __init__(self, limit: int, seconds: float, late_seconds: float):
        self.limit, self.seconds, self.late = limit, seconds, late_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        held = sorted(x[0] for x in self.held.get()) if self.held.exists() else []
        said = waits([t.timestamp() for t in batch["ts"]], held, self.limit, self.seconds)
        seen = max(t.timestamp() for t in batch["ts"])
        behind = max([seen, *held]) - self.late - self.seconds
        kept = [x for x in held if x > behind]
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if kept:
            self.held.put([(x,) for x in kept])
            self.handle.registerTimer(int((kept[-1] + self.seconds) * 1000) + 1)
        else:
            self.held.clear()
        yield pd.DataFrame({"tenant": [key[0]] * len(batch), "event_id": batch["event_id"].to_numpy(), "admitted": [w is None for w in said], "retry_after": [0 if w is None else max(1, int(w)) for w in said]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


def admission(requests: DataFrame, limit: int, seconds: float = 60.0, late: str = "10 minutes") -> DataFrame:
    """The stream ``requests(tenant, event_id, ts)`` with ``admitted`` and ``retry_after`` (whole seconds, at least 1, 0 if admitted).

    At most ``limit`` requests of a tenant are admitted in any ``seconds``. Requests of one batch are taken by (ts, event_id); those more than ``late`` behind the
    newest of earlier batches get no verdict. Null times get none either.
    """
    rows = requests.select(F.col("tenant").cast("string").alias("tenant"), "event_id", F.col("ts").cast("timestamp").alias("ts")).where("ts is not null").withWatermark("ts", late)
    processor = Admission(limit, seconds, float(pd.Timedelta(late).total_seconds()))
    return rows.groupBy("tenant").transformWithStateInPandas(statefulProcessor=processor, outputStructType=OUT, outputMode="Append", timeMode="EventTime")
