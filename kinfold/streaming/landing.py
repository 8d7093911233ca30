"""Landing stream: idempotent append of decoded messages, dead letters beside them."""

from __future__ import annotations

import datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinfold.operators.counters import Counters
from kinfold.operators.typed import exact_kind
from kinfold.session import delete
from kinfold.sources.envelope import decoded
from kinfold.sources.landing import COORDS, new_rows
from kinfold.streaming.store import folder_number, stored, stream_id

#: What a batch counts: records, those it could not read, and new rows of both tables.
COUNTED = ["consumed", "errors", "landed", "dead"]
LANDED = ("topic string, partition int, offset long, ts timestamp, raw_id string, payload string, batch long, day date")
DEAD = "topic string, partition int, offset long, ts timestamp, raw_id string, value binary, batch long, day date"


def landed(spark: SparkSession, root: str) -> DataFrame:
    return stored(spark, f"{root}/landed", LANDED)


def dead(spark: SparkSession, root: str) -> DataFrame:
    return stored(spark, f"{root}/dead", DEAD)


def land_batch(envelopes: DataFrame, batch: int, root: str, stream: str = "") -> None:
    """Land one micro-batch of a stream. Each batch owns its folder, so running it again replaces its own rows only.

    Of several bodies at one coordinate the first stays: of those of earlier batches, of whatever stream,
    then of those of this batch in the order they are read. The same holds for dead letters.
    """
    spark, counted = envelopes.sparkSession, Counters()
    number = folder_number(spark, root, stream, batch)
    rows = decoded(envelopes.withColumn("arrival", F.monotonically_increasing_id()), "arrival")
    rows = rows.withColumn("good", F.col("fields").isNotNull()).drop("fields").persist(StorageLevel.MEMORY_AND_DISK)

    def add(fresh: DataFrame, earlier: DataFrame, name: str) -> None:
        """File statistics prune the earlier rows to the offset range of this batch."""
        known = earlier.filter((F.col("batch") != number) & F.col("offset").between(low, high))
        new = counted.watch(new_rows(fresh, known, "arrival").drop("arrival"), **{name: F.count("*")})
        by_day = new.withColumn("day", F.to_date("ts")).sortWithinPartitions("day", *COORDS)
        by_day.write.mode("overwrite").partitionBy("day").parquet(f"{root}/{name}/batch={number}")
    try:
        spread = rows.agg(F.min("offset").alias("low"), F.max("offset").alias("high"), F.count("*").alias("n"),
                          F.count_if(~F.col("good")).alias("bad")).first()
        low, high = (spread["low"] or 0), (spread["high"] or 0)
        counted.add(consumed=spread["n"], errors=spread["bad"])
        add(rows.filter("good").drop("good", "value"), landed(spark, root), "landed")
        add(rows.filter("not good").drop("good", "payload"), dead(spark, root), "dead")
    finally:
        rows.unpersist()
    counted.save(spark, root, number, *COUNTED)


def expire(spark: SparkSession, root: str, before: datetime.date) -> int:
    """Delete the landed rows and dead letters of all days before ``before``; the number of folders that went.

    Days are partitions, so nothing is read or rewritten. Rows without a time have no day and stay. A record of a day that
    is gone would land again if the topic still held it, as after any expiry.
    """
    gone = 0
    for name, schema in (("landed", LANDED), ("dead", DEAD)):
        days = stored(spark, f"{root}/{name}", schema).filter(F.col("day") < F.lit(before)).select("batch", "day").distinct()
        for row in days.collect():  # one row a folder
            delete(spark, f"{root}/{name}/batch={row['batch']}/day={row['day']}")
            gone += 1
    return gone


def expire_behind(spark: SparkSession, root: str, days: int) -> int:
    """Expire what is more than ``days`` whole days older than the newest landed row."""
    newest = landed(spark, root).agg(F.max("day")).first()[0]
    return 0 if newest is None else expire(spark, root, newest - datetime.timedelta(days=days))


def landing_query(stream: DataFrame, root: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start landing; ``trigger`` as in ``writeStream.trigger`` (default: all available data, then stop)."""
    def land(df: DataFrame, batch: int) -> None:
        land_batch(df, batch, root, stream_id(df.sparkSession))
    return (stream.writeStream.foreachBatch(land)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def kind_counts(stream: DataFrame) -> DataFrame:
    """Running count per exact kind: ``unknown`` for decodable messages of no kind, ``errors`` for the rest."""
    rows = decoded(stream)
    kind = F.when(F.col("fields").isNull(), "errors").otherwise(
        F.coalesce(exact_kind(F.col("fields")), F.lit("unknown")))
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def kind_counts_query(stream: DataFrame, root: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the counts as a small table, rewritten whole per batch (one row per kind)."""
    def save(df: DataFrame, batch: int) -> None:
        number = folder_number(df.sparkSession, f"{root}/kind_counts", stream_id(df.sparkSession), batch)
        df.coalesce(1).write.mode("overwrite").parquet(f"{root}/kind_counts/counts/batch={number}")
    return (kind_counts(stream).writeStream.outputMode("complete").foreachBatch(save)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def latest_kind_counts(spark: SparkSession, root: str) -> DataFrame:
    """Counts as of the batch written last, by whatever stream."""
    rows = stored(spark, f"{root}/kind_counts/counts", "kind string, n long, batch long")
    return rows.filter(F.col("batch") == rows.agg(F.max("batch")).scalar()).select("kind", "n")


def bounded_dedupe(stream: DataFrame, delay: str) -> DataFrame:
    """Duplicates dropped inside the stream with state kept only for ``delay`` of event time."""
    return stream.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(COORDS)
