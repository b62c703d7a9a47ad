"""Tables that a query writes once and reads several times, and broadcasts of counted size."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, on a single machine only, below a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if "dir" not in _OWN:
            _OWN["dir"] = tempfile.mkdtemp(prefix="veilspark-core-")
            atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
        base = _OWN["dir"]
    return f"{base.rstrip('/')}/veilspark-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder: computed once, whole whatever executors are lost later."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """With a broadcast hint if it has at most ``rows`` rows, else as it is: a larger table is joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """A table that lies in fewer pieces than there are task slots, dealt to all of them; a larger one is read as it lies, without a shuffle."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


#: Rows and bytes of a batch of long texts that goes to Python.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of more than ``BATCH_ROWS`` rows or ``BATCH_BYTES``, too many for texts taken apart in Python, are made shorter from now on."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        said = spark.conf.get(name)
        if not (said.isdigit() and 0 < int(said) <= most):
            spark.conf.set(name, str(most))
