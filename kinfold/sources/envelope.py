"""Message envelopes: stream and table readers, JSON decoding, dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.fields import JSON_OPTIONS, MAP, decode
from kinfold.session import computed_once

#: Columns of a broker record. ``value`` is the raw body.
ENVELOPE = "topic string, partition int, offset long, timestamp timestamp, value binary"


def kafka_stream(spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None,
                 min_partitions: int | None = None) -> DataFrame:
    """Topic from its earliest offset; offsets are kept by the query's checkpoint.

    ``min_partitions`` splits the offset ranges of a topic with few partitions over more tasks.
    Needs the Kafka connector on the class path.
    """
    reader = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
              .option("subscribe", topic).option("startingOffsets", "earliest"))
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    if min_partitions:
        reader = reader.option("minPartitions", min_partitions)
    return reader.load().select("topic", "partition", "offset", "timestamp", "value")


def file_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The same records from a folder of Parquet files."""
    reader = spark.readStream.schema(ENVELOPE)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def spread(batch: DataFrame) -> DataFrame:
    """Records of a batch over all cores where it comes in fewer parts, as of a topic of few partitions or from one file.

    Reading a message costs far more than moving it.
    """
    cores = batch.sparkSession.sparkContext.defaultParallelism
    if batch.rdd.getNumPartitions() >= cores:
        return batch
    return batch.repartition(cores, "topic", "partition", "offset", "timestamp")


def raw_id() -> Column:
    return F.concat_ws("_", "topic", "partition", "offset")


def decoded(envelopes: DataFrame, *kept: str) -> DataFrame:
    """``topic, partition, offset, ts, raw_id, payload, fields`` and the columns ``kept``.

    ``fields`` is null for bodies that are not one JSON object in valid UTF-8. A timestamp at or
    before the epoch means the broker had none.
    """
    ts = F.when(F.unix_micros("timestamp") > 0, F.col("timestamp"))
    body = F.col("value").cast("string")
    text = envelopes.select("topic", "partition", "offset", ts.alias("ts"), raw_id().alias("raw_id"),
                            F.when(F.is_valid_utf8(body), body).alias("payload"), "value", *kept)
    return computed_once(text, text.columns, fields=decode(F.col("payload")))


def messages(envelopes: DataFrame) -> DataFrame:
    """Good messages only."""
    return good(decoded(envelopes))


def good(rows: DataFrame) -> DataFrame:
    """Those of decoded rows that are messages."""
    return rows.filter(F.col("fields").isNotNull()).drop("value")


def dead_letters(envelopes: DataFrame) -> DataFrame:
    """Bodies that could not be decoded, kept with their coordinates."""
    return decoded(envelopes).filter(F.col("fields").isNull()).drop("payload", "fields")


def strict_fields(payload: Column) -> Column:
    """Decode that fails the job on the first bad body."""
    return F.from_json(payload, MAP, {**JSON_OPTIONS, "mode": "FAILFAST"})


def with_fields(landed: DataFrame) -> DataFrame:
    """Landed rows with their payload decoded again."""
    return computed_once(landed, landed.columns, fields=decode(F.col("payload")))
