"""Counters of each micro-batch, observed in the stream and stored by a listener (ST12).

``observed`` adds the counters to the stream's plan, so they are taken while the batch runs, without another pass over
it.  ``BatchMetrics`` listens to the progress of one query and writes one small JSON file for each batch; a batch that is
tried again replaces its file.  Listener calls arrive behind the query; ``close`` waits for the last one.
"""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

NAME = "fillwise_batch"
METRICS = "batch_id BIGINT, delivered BIGINT, malformed BIGINT, late_rows BIGINT, input_rows BIGINT, duration_ms BIGINT, ts STRING"


def observed(stream: DataFrame, corrupt: str | None = None) -> DataFrame:
    """``stream`` with its row count and the count of malformed lines observed per batch."""
    malformed = F.count(F.col(corrupt) if corrupt else F.lit(None).cast("string"))
    return stream.observe(NAME, F.count(F.lit(1)).alias("delivered"), malformed.alias("malformed"))


class BatchMetrics(StreamingQueryListener):
    """Stores the observed counters of one query's batches under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.id: str | None = None
        self.early: list = []                   # events that came before the query's id was known
        self.ended = threading.Event()
        self.failed: Exception | None = None
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        spark.streams.addListener(self)

    def follow(self, query) -> None:
        """Name the query whose batches are stored."""
        self.id = str(query.runId)
        early, self.early = self.early, []
        for call, event in early:
            call(event)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.id is None:
            self.early.append((self.onQueryProgress, event))
            return
        if str(p.runId) != self.id:
            return
        row = p.observedMetrics.get(NAME)
        counts = row.asDict() if row is not None else {}
        line = {"batch_id": p.batchId, "delivered": counts.get("delivered") or 0, "malformed": counts.get("malformed") or 0,
                "late_rows": sum(s.numRowsDroppedByWatermark for s in p.stateOperators),
                "input_rows": p.numInputRows, "duration_ms": p.batchDuration, "ts": p.timestamp}
        try:
            out = self._fs.create(self._path(f"{self.path}/batch-{p.batchId}.json"), True)
            out.write(bytearray((json.dumps(line) + "\n").encode()))
            out.close()
        except Exception as e:                  # raised by close(): a listener's own errors are only logged
            self.failed = e

    def onQueryTerminated(self, event) -> None:
        if self.id is None:
            self.early.append((self.onQueryTerminated, event))
        elif str(event.runId) == self.id:
            self.ended.set()

    def close(self, wait_seconds: float = 60.0) -> None:
        """Wait until the ended query's last event has been handled; raises what storing a batch raised."""
        self.ended.wait(wait_seconds)
        self.spark.streams.removeListener(self)
        if self.failed is not None:
            raise self.failed


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The stored counters, one row per batch."""
    return spark.read.schema(METRICS).json(path)
