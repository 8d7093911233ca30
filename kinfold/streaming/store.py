"""Numbered folders of a stored table that several streams, or one stream started anew, append to.

Micro-batch numbers start at 0 again with every new checkpoint, so they cannot name folders by themselves. A
store keeps a log of which stream and batch each of its own numbers belongs to. A batch that runs again
finds its number there and replaces only its own rows; any other batch gets a new number behind all others.
A store has one writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.session import exists

LOG = "stream string, stream_batch long, number int"


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that need not exist yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def stream_id(spark: SparkSession) -> str:
    """The id of the running query, which its checkpoint keeps; to be called inside ``foreachBatch``."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or ""


def folder_number(spark: SparkSession, root: str, stream: str, batch: int) -> int:
    """The store's own number of a stream's batch, logged before anything is written under it."""
    log = stored(spark, f"{root}/log", LOG)
    own = (F.col("stream") == stream) & (F.col("stream_batch") == batch)
    last, known = log.agg(F.max("number"), F.max(F.when(own, F.col("number")))).first()
    if known is not None:
        return known
    number = 0 if last is None else last + 1
    (spark.createDataFrame([(stream, batch)], "stream string, stream_batch long").coalesce(1)
     .write.mode("overwrite").parquet(f"{root}/log/number={number}"))
    return number
