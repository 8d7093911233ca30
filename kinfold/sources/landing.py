"""Landing table: idempotent append keyed by broker coordinates, processed marks, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COORDS = ["topic", "partition", "offset"]


def _has_coordinates() -> Column:
    return F.col("topic").isNotNull() & F.col("partition").isNotNull() & F.col("offset").isNotNull()


def first_per_coordinate(batch: DataFrame, arrival: str | None = None) -> DataFrame:
    """One row per (topic, partition, offset); the first by ``arrival`` when given.

    Rows without coordinates have no key to collide on: each is a group of its own, and all are kept.
    """
    loose = F.when(~_has_coordinates(), F.monotonically_increasing_id()).alias("loose")
    rest = [c for c in batch.columns if c not in COORDS]
    order = F.monotonically_increasing_id() if arrival is None else F.col(arrival)
    rows = batch.select(*COORDS, loose, F.struct(*rest).alias("row"), order.alias("arrival"))
    first = rows.groupBy(*COORDS, "loose").agg(F.min_by("row", "arrival").alias("row"))
    return first.select(*COORDS, "row.*").select(*batch.columns)


def new_rows(batch: DataFrame, landed: DataFrame, arrival: str | None = None) -> DataFrame:
    """Rows of the batch not landed before; what was stored first stays."""
    return first_per_coordinate(batch, arrival).join(landed.select(*COORDS), COORDS, "left_anti")


def landing_metrics(rows: DataFrame, landed: DataFrame) -> DataFrame:
    """Consumed, inserted, duplicate and error counts of decoded rows, in one pass and one row."""
    per = rows.groupBy(*COORDS).agg(F.count("*").alias("n"), F.count("fields").alias("good"))
    known = landed.select(*COORDS).withColumn("old", F.lit(True))
    new = (F.when(~_has_coordinates(), F.col("good"))
           .when(F.col("old").isNull() & (F.col("good") > 0), 1).otherwise(0))
    sums = per.join(known, COORDS, "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("consumed"), F.coalesce(F.sum(new), F.lit(0)).alias("inserted"),
        F.coalesce(F.sum(F.col("n") - F.col("good")), F.lit(0)).alias("errors"))
    return sums.withColumn("duplicates", F.expr("consumed - inserted - errors"))


def unprocessed(landed: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows whose flag is false or missing."""
    rows = landed.filter(~F.coalesce(F.col("processed"), F.lit(False)))
    return rows if limit is None else rows.limit(limit)


def unprocessed_by_ids(landed: DataFrame, processed_ids: DataFrame) -> DataFrame:
    """The same from a table of processed ids: nothing landed is ever rewritten."""
    return landed.join(processed_ids.select("raw_id"), "raw_id", "left_anti")


def mark_processed(landed: DataFrame, ids: DataFrame) -> DataFrame:
    """Set the flag of the given rows; others keep theirs."""
    done = ids.select("raw_id").distinct().withColumn("done", F.lit(True))
    return (landed.join(done, "raw_id", "left")
            .withColumn("processed", F.coalesce("done", "processed")).drop("done"))


def replay(landed: DataFrame, unset: bool = False) -> DataFrame:
    """Clear the processed flag for a second run: to false where it was true, or drop it."""
    if unset:
        return landed.drop("processed", "processed_at")
    return landed.withColumn("processed", F.when(F.col("processed"), F.lit(False)).otherwise(F.col("processed")))


def retained(landed: DataFrame, cutoff: Column) -> DataFrame:
    """Rows at or after the cutoff."""
    return landed.filter(F.col("ts") >= cutoff)


def latest(landed: DataFrame, n: int) -> DataFrame:
    """Newest rows by (ts, topic, partition, offset)."""
    return landed.orderBy(*[F.desc(c) for c in ("ts", *COORDS)]).limit(n)


def first_rows(landed: DataFrame, n: int) -> DataFrame:
    """Oldest rows by broker coordinates: a top-k, no full sort."""
    return landed.orderBy(*COORDS).limit(n)


def per_key_sample(rows: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    """First ``n`` rows of each key.

    Spark keeps at most ``n`` rows per key and task before the shuffle (window group limit), so a
    heavy key moves ``n`` rows per task only.
    """
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= n)
