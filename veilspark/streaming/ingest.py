"""Streams: incremental redaction and indexing, windowed rates, admission under a rate limit.

The checkpoint folder holds the watermark of an ingestion: a restart reads only files
that no finished batch has read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import spans as S
from ..operators.quota import waits


def documents(spark: SparkSession, path: str, schema: str, files_per_batch: int = 200) -> DataFrame:
    """Parquet files as they arrive below ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def redact_into(stream: DataFrame, out: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text") -> StreamingQuery:
    """Write each document redacted, once per batch and id, to the folder ``out`` and stop when all is read.

    Of rows of one id in a batch the one with the greatest text stays (null least), whatever their order. A batch has a folder of its own that is overwritten if the batch is run again, so a
    lost executor or driver leaves neither gaps nor repeats. Rows with null text are written as empty.
    """

    def each(batch: DataFrame, number: int) -> None:
        text = F.coalesce(F.col(text_col), F.lit(""))
        others = [c for c in batch.columns if c not in (id_col, text_col)]
        one = batch.groupBy(id_col).agg(F.max(F.struct(text_col, *others)).alias("_r")).select(id_col, "_r.*").select(*batch.columns)
        clean = one.withColumn(text_col, S.redact(text, S.detect(text)))
        clean.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str, id_col: str = "doc_id") -> DataFrame:
    """The last version of every document that ``redact_into`` has written."""
    rows = spark.read.parquet(out)
    newest = rows.groupBy(id_col).agg(F.max("batch").alias("batch"))
    return rows.join(newest, [id_col, "batch"]).drop("batch")


def rates(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per window and type with rows up to ``late`` behind still counted; batch or stream."""
    w = F.window("ts", window)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def admitted(events: DataFrame, limit: int, seconds: float = 60.0, late: str = "10 minutes") -> DataFrame:
    """``events(key, event_id, ts)`` with whether each is admitted: at most ``limit`` in any ``seconds``.

    The state of a key is its admitted times within the window and the time that events may come late, and goes
    once the watermark has passed its last event by a window. Events more than
    ``late`` behind the newest of earlier batches get no verdict.
    """
    late_seconds = float(pd.Timedelta(late).total_seconds())

    def each(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        held = sorted(state.get[0]) if state.exists else []
        verdicts = [wait is None for wait in waits([t.timestamp() for t in rows["ts"]], held, limit, seconds)]
        newest = max([*held, *(t.timestamp() for t in rows["ts"])])
        behind = newest - late_seconds - seconds
        state.update(([x for x in held if x > behind],))
        state.setTimeoutTimestamp(int((newest + seconds) * 1000) + 1)
        yield pd.DataFrame({"key": [key[0]] * len(rows), "event_id": rows["event_id"], "admitted": verdicts})

    return events.select("key", "event_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late).groupBy("key").applyInPandasWithState(each, "key long, event_id long, admitted boolean", "held array<double>", "append", GroupStateTimeout.EventTimeTimeout)
