"""Progress of running streams as a table: rows, rate and lag of every batch, and the time until nothing is pending."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from kinfold.streaming.store import stored

PROGRESS = "query string, run string, batch long, ts timestamp, rows long, seconds double, behind long"


class ProgressTable(StreamingQueryListener):
    """Keeps a row for each finished batch of the streams it is told of; ``save`` appends them to a table.

    ``behind`` is how many records the sources still hold, where they tell, as brokers do. Rows that were not saved
    when the driver is lost are lost with it; a batch that is run again has a row for each run.
    """

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._root = spark, root
        self._rows: list[tuple] = []
        self._ended: set[str] = set()
        self._change = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        behind = [int(float(s.metrics["maxOffsetsBehindLatest"])) for s in p.sources if "maxOffsetsBehindLatest" in (s.metrics or {})]
        row = (str(p.id), str(p.runId), p.batchId, p.timestamp, p.numInputRows,
               p.durationMs.get("triggerExecution", 0) / 1000, sum(behind) if behind else None)
        with self._change:
            self._rows.append(row)

    def onQueryTerminated(self, event) -> None:
        with self._change:
            self._ended.add(str(event.runId))
            self._change.notify_all()

    def save(self) -> int:
        """Append what has come in since the last time; the number of rows."""
        with self._change:
            rows, self._rows = self._rows, []
        if rows:
            df = self._spark.createDataFrame(rows, PROGRESS.replace("ts timestamp", "ts string"))
            df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(self._root)
        return len(rows)

    def finish(self, query: StreamingQuery, timeout: float = 30) -> None:
        """Wait until ``query`` has ended and all its rows have come in, and save them."""
        query.awaitTermination()
        with self._change:
            self._change.wait_for(lambda: str(query.runId) in self._ended, timeout)
        self.save()


def progress_rows(spark: SparkSession, root: str) -> DataFrame:
    """Saved rows of batches that had any, with their rate."""
    return stored(spark, root, PROGRESS).filter("rows > 0").withColumn("rate", F.try_divide("rows", "seconds"))


def remaining(progress: DataFrame, total: int | None = None) -> DataFrame:
    """``(query, batches, rows, rate, pending, eta_seconds)`` of each stream.

    What is pending is what the sources said last, or of ``total`` records those that have not come in. The rate is that of
    all batches so far; without one there is no time to tell.
    """
    whole = progress.groupBy("query").agg(
        F.count("*").alias("batches"), F.sum("rows").alias("rows"), F.try_divide(F.sum("rows"), F.sum("seconds")).alias("rate"),
        F.max_by("behind", F.struct("ts", "batch")).alias("behind"))
    pending = F.col("behind") if total is None else F.greatest(F.lit(total) - F.col("rows"), F.lit(0))
    return whole.withColumn("pending", pending.cast("long")).drop("behind").withColumn(
        "eta_seconds", F.when(F.col("rate") > 0, F.col("pending") / F.col("rate")))
